"""The operators of this subpackage as queries: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shoal.llm.boosted_pii import pii_digest
from shoal.llm.common import remainder, table
from shoal.llm.context_mix import score_texts
from shoal.llm.entropy_secrets import secret_digest
from shoal.llm.hilbert import hilbert_shards
from shoal.llm.latent_leaks import find_leaks
from shoal.llm.license_text import scan_licenses
from shoal.llm.nn_descent import near_vectors
from shoal.llm.pareto_mix import mix
from shoal.llm.piece_lang import fit, identify, public_pieces
from shoal.llm.rank_index import fim_digest
from shoal.llm.rank_vbyte import tokenize
from shoal.llm.simhash_bk import near_duplicates
from shoal.llm.trie_audit import audit

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op6_entropy_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secret_digest(table(spark, sf, "documents"))


@query
def op7_pareto_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op8_hilbert_shards(spark: SparkSession, sf: str) -> DataFrame:
    placed = hilbert_shards(table(spark, sf, "documents"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


@query
def op10_rank_vbyte(spark: SparkSession, sf: str) -> DataFrame:
    return tokenize(table(spark, sf, "documents"), vocabulary_file("word_bpe_49k.json"))


@query
def op2_simhash_bk(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"))


def language_model(docs: DataFrame):
    """Fit on the labelled documents whose crc32(doc_id) modulo 3 is not 1."""
    pieces, single = public_pieces(vocabulary_file("piece_bpe_32k.model"))
    return fit(docs.where((remainder(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull()), pieces, single)


@query
def op5_piece_lang(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    rows = docs.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return identify(rows, language_model(docs)).drop("text")


@query
def op4_latent_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op1_nn_descent(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors(table(spark, sf, "embeddings"))


@query
def op3_context_mix(spark: SparkSession, sf: str) -> DataFrame:
    return score_texts(table(spark, sf, "documents"), remainder(F.col("doc_id"), 7) == 2)


@query
def op9_license_text(spark: SparkSession, sf: str) -> DataFrame:
    return scan_licenses(table(spark, sf, "documents"))


@query
def op11_boosted_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii_digest(table(spark, sf, "documents"))


@query
def op12_rank_index_fim(spark: SparkSession, sf: str) -> DataFrame:
    return fim_digest(table(spark, sf, "documents"))


@query
def op13_trie_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit(table(spark, sf, "documents"), table(spark, sf, "labels"))
