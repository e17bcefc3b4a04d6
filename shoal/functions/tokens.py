"""Word tokens and their model inputs as column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Token ids of the vocabulary's special words, and the input length.
CLS_ID = 101
SEP_ID = 102
UNKNOWN_ID = 100
PAD_ID = 0
MAX_LENGTH = 512


def tokenize_words(text: Column) -> Column:
    """Lower-case words separated by Unicode white space."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"((?U)\S+)"), 1)


def input_ids(word_ids: Column, max_length: int = MAX_LENGTH) -> Column:
    """Word ids framed by the start and end markers, padded or cut to `max_length`.

    Cutting drops the end marker, as a plain slice does.
    """
    framed = F.concat(
        F.array(F.lit(CLS_ID)),
        word_ids,
        F.array(F.lit(SEP_ID)),
        F.array_repeat(F.lit(PAD_ID), max_length),
    )
    return F.slice(framed, 1, max_length)


def word_mask(words: Column, max_length: int = MAX_LENGTH) -> Column:
    """One for every marker or word, zero for padding, by word count."""
    real = F.least(F.size(words) + F.lit(2), F.lit(max_length))
    mask = F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), F.lit(max_length) - real))
    return F.when(words.isNotNull(), mask)


def attention_mask(ids: Column) -> Column:
    """One for every id other than the padding id."""
    return F.transform(ids, lambda x: F.when(x != PAD_ID, F.lit(1)).otherwise(F.lit(0)))


def token_types(ids: Column) -> Column:
    """All zeros, as long as `ids`."""
    return F.array_repeat(F.lit(0), F.size(ids))
