"""Word-level model inputs for a table of texts and a vocabulary table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from shoal.functions.tokens import (
    MAX_LENGTH,
    UNKNOWN_ID,
    input_ids,
    token_types,
    tokenize_words,
    word_mask,
)
from shoal.operators.lookup import BROADCAST_BYTES, BROADCAST_ROWS, lookup_join
from shoal.session import ship_package, stage


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """`token`, `token_id` of a JSON file whose `vocab` object maps words to ids."""
    whole = spark.read.text(path, wholetext=True)
    vocab = F.try_variant_get(F.parse_json("value"), "$.vocab", "map<string,int>")
    return whole.select(F.explode(vocab).alias("token", "token_id"))


def vocab_lookup(
    words: DataFrame, vocabulary: DataFrame, word_col: str = "word", small: bool | None = None
) -> DataFrame:
    """Add `token_id` for one word per row; unknown words get the unknown id."""
    table = vocabulary.select(F.col("token").alias(word_col), "token_id")
    joined = lookup_join(words, table, [word_col], small=small)
    return joined.withColumn("token_id", F.coalesce("token_id", F.lit(UNKNOWN_ID)))


def encode_tokens(
    df: DataFrame,
    vocabulary: DataFrame,
    *,
    id_col: str = "id",
    text_col: str = "document",
    max_length: int = MAX_LENGTH,
    max_vocabulary: int | None = None,
) -> DataFrame:
    """Add `input_ids`, `attention_mask` and `token_type_ids` of fixed length.

    Words past the cut cannot reach the output and are left out before the
    lookup. A vocabulary within the bound is broadcast and looked up batch by
    batch, without a shuffle. A larger one is joined with the exploded words,
    which are then put back together per row (at most `max_length` each).
    """
    words = df.withColumn("_words", F.slice(tokenize_words(F.col(text_col)), 1, max_length))
    bound = BROADCAST_ROWS if max_vocabulary is None else max_vocabulary
    table = vocabulary.select("token", F.col("token_id").cast("int").alias("token_id"))
    head = table.limit(bound + 1).toArrow()
    if head.num_rows <= bound and head.nbytes <= BROADCAST_BYTES:
        with_ids = _lookup_in_batches(words, head)
    else:
        with_ids = _lookup_by_join(words, vocabulary)
    return (
        with_ids.withColumn("input_ids", input_ids(F.col("_word_ids"), max_length))
        .withColumn("attention_mask", word_mask(F.col("_words"), max_length))
        .withColumn("token_type_ids", token_types(F.col("input_ids")))
        .drop("_words", "_word_ids")
    )


def _lookup_in_batches(words: DataFrame, table: pa.Table) -> DataFrame:
    ship_package(words.sparkSession)
    shared = words.sparkSession.sparkContext.broadcast(
        (table["token"].combine_chunks(), np.append(table["token_id"].to_numpy(), UNKNOWN_ID).astype(np.int32))
    )

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens, token_ids = shared.value
        for lists in batches:
            at = pc.fill_null(pc.index_in(lists.flatten(), value_set=tokens), len(token_ids) - 1)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            values = pa.array(token_ids[at.to_numpy()])
            yield pa.ListArray.from_arrays(pa.array(offsets), values, mask=lists.is_null())

    return words.withColumn("_word_ids", ids_of.asNondeterministic()("_words"))


def _lookup_by_join(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    # ids may repeat or be missing, so every row gets a key, fixed by writing it down
    words = stage(words.withColumn("_row", F.monotonically_increasing_id()), "words")
    exploded = words.select("_row", F.posexplode("_words").alias("_at", "word"))
    found = vocab_lookup(exploded, vocabulary, small=False)
    ordered = F.array_sort(F.collect_list(F.struct("_at", "token_id")))
    per_row = found.groupBy("_row").agg(F.transform(ordered, lambda x: x["token_id"]).alias("_word_ids"))
    none = F.when(F.col("_words").isNotNull(), F.array().cast("array<int>"))
    return words.join(per_row, "_row", "left").withColumn("_word_ids", F.coalesce("_word_ids", none)).drop("_row")
