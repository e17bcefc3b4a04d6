"""Corpus pipeline over the operators of shoal.llm: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again for the next one. All but the last return the columns of `docs`.
What a stage stages for itself is deleted when the next one begins, as by then
its result has been written.

In every stage a null text counts as empty, repeated rows are decided alike, an
empty table gives no rows, and columns beyond those named keep their values
whatever they are called. Very long texts are whole in one row of one task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from shoal.llm.common import fresh, table
from shoal.llm.latent_leaks import without_leaks
from shoal.llm.pareto_mix import mix
from shoal.llm.piece_lang import UNDECIDED, identify
from shoal.llm.queries import language_model, vocabulary_file
from shoal.llm.rank_vbyte import tokenize
from shoal.llm.simhash_bk import one_of_each
from shoal.session import Scratch, drop_scratch, scratch_path, stage

# A document stays if its language is as likely as not, or better.
LEAST_SCORE = 0.5

# What the stage that ran last has staged.
_staged: list[Scratch] = []

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def owned(step: Stage) -> Stage:
    """A stage that clears the scratch of those before it and owns what it stages itself.

    Nothing is cleared while `docs` is more than a scan, as it may still read from there.
    """
    @wraps(step)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        written = docs._jdf.queryExecution().analyzed().children().isEmpty()
        for last in list(_staged) if written else ():
            _staged.remove(last)
            if last.spark is spark:  # else that session has ended
                last.close()
        _staged.append(Scratch(spark))
        with _staged[-1].open():
            return step(spark, docs, sf_dir)

    return begun



@owned
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without a letter and those whose language stays open.

    Without a single labelled document nothing can be learned, and only texts
    without a letter go.
    """
    model = language_model(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    prefix = fresh("_", [c.removesuffix("lang_pred").removesuffix("score") for c in docs.columns])
    named = identify(docs, model, prefix=prefix)
    kept = named.where((F.col(f"{prefix}lang_pred") != UNDECIDED) & (F.col(f"{prefix}score") >= LEAST_SCORE))
    return kept.select(*docs.columns)


@owned
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of every class of near-duplicates.

    Texts without a word are alike; of rows that share the smallest id one stays.
    """
    return one_of_each(docs)


@owned
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a benchmark passage leaks; a text without words leaks nothing."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


@owned
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents until each source has its share of the words.

    A null source is a source of its own. Rows that share an id are drawn one by
    one; of a tie in the order the id and then the size decide.
    """
    key, times = fresh("row", docs.columns), fresh("copies", docs.columns)
    keyed = stage(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    taken = mix(keyed.select("doc_id", "text", "source", F.col(key).alias("row")), row="row")
    taken = taken.where("copies > 0").select(F.col("row").alias(key), F.col("copies").alias(times))
    copies = F.explode(F.array_repeat(F.lit(0), F.col(times)))
    return keyed.join(taken, key).select(*docs.columns, copies.alias(key)).select(*docs.columns)


@owned
def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in the file format, read back: doc_id, start, n_tokens, ids_crc32.

    Copies of a document follow one another; a text without a word is its end id alone.
    """
    return tokenize(docs, vocabulary_file("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("source_mix", mix_sources),
    ("token_output", write_token_ids),
]

# Learned models, metric trees and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over `documents`."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        path = scratch_path(spark, name)
        kept = step(spark, docs, sf_dir)
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before:
            drop_scratch(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
