"""Vector column functions: pooling, distances, feature hashing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shoal.functions.binding import let
from shoal.functions.tokens import tokenize_words

METRICS = ("l2", "cosine", "ip")


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    return metric


def first_token_pool(flat: Column, dim: int) -> Column:
    """First `dim` values of a flattened [1, length, dim] output: the first token's vector."""
    return F.slice(flat, 1, dim)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """Distance of two equally long vectors in double precision.

    `l2` is the sum of squared differences, `ip` is 1 − dot product and `cosine`
    is 1 − cosine similarity, which is 1 where a vector is all zeros.
    """
    check_metric(metric)
    if metric == "l2":
        squares = F.zip_with(
            a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)
        )
        return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)
    if metric == "ip":
        return F.lit(1.0) - dot(a, b)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(1.0)).otherwise(F.lit(1.0) - dot(a, b) / norms)


def format_distance(value: Column) -> Column:
    """Four decimals for display."""
    return F.format_string("%.4f", value)


def hashing_embedding(text: Column, dim: int) -> Column:
    """Unit vector of word counts hashed into `dim` buckets; zeros without words.

    A deterministic stand-in for a model, computed per row without a shuffle.
    A word's bucket is the first 32 bits of its SHA-256 modulo `dim`. Sorting
    the buckets (as odd numbers) together with one even sentinel per bucket turns
    each count into the gap between two neighbouring sentinels.
    """
    buckets = F.transform(
        tokenize_words(text),
        lambda w: F.pmod(
            F.conv(F.substring(F.sha2(w, 256), 1, 8), 16, 10).cast("bigint"), F.lit(dim)
        ).cast("int"),
    )
    ladder = F.sort_array(
        F.concat(
            F.transform(buckets, lambda b: b * 2 + 1),
            F.sequence(F.lit(0), F.lit(2 * dim), F.lit(2)),
        )
    )
    starts = F.filter(
        F.transform(ladder, lambda rung, at: F.when(F.pmod(rung, F.lit(2)) == 0, at)),
        lambda at: at.isNotNull(),
    )
    counts = let(
        starts,
        lambda at: F.zip_with(
            F.slice(at, 2, dim), F.slice(at, 1, dim), lambda hi, lo: (hi - lo - 1).cast("double")
        ),
    )
    return unit_vector(counts).cast("array<float>")


def unit_vector(values: Column) -> Column:
    """The vector divided by its length; a zero vector stays as it is."""
    return let(
        values,
        lambda v: let(
            F.sqrt(dot(v, v)),
            lambda norm: F.transform(
                v, lambda x: F.when(norm == 0, F.lit(0.0)).otherwise(x / norm)
            ),
        ),
    )
