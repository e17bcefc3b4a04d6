"""Mixing sources to target weights by Pareto order sampling. Native: column functions only.

A source's target is reached in two steps. As many whole copies of all its
documents as the target holds are certain. What is left is a sample whose
inclusion odds are lambda / (1 - lambda), lambda being the left-over share of the
source: documents are ranked by their random odds u / (1 - u) divided by the
inclusion odds, and the ranking is cut where the words come nearest to the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shoal.llm.common import WORD
from shoal.operators.lookup import lookup_join
from shoal.operators.ordering import with_position
from shoal.session import stage

# Documents of a source that share one slice of the ranking, about.
SLICE_ROWS = 8192
UNIT = 1 << 52


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(ident: Column, seed: int) -> Column:
    """A whole number below 2**52 made from the id's md5; the same in every run."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """One row per source: key, source_size, source_rows, target.

    Targets are shares of `share` times all words by weight; one above `cap`
    times its source stops there and the excess is reshared by weight until none
    is above. Only sums leave the cluster.
    """
    sources = sized.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    # 'n' (no source) stands before 's...' as text but comes last here.
    sources = sources.withColumn("last", F.col("key") == "n")
    ranked = with_position(sources, ["last", "key"], "rank").drop("last")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = stage(ranked.withColumn("weight", weight), "sources")
    top = F.col("source_size") * F.lit(float(cap))
    full, words, level = F.lit(False), None, 0.0
    at = -1
    while True:
        sums = ranked.agg(
            F.sum("source_size").alias("words"),
            F.sum(F.when(full, top)).alias("fixed"),
            F.sum(F.when(~full, F.col("weight"))).alias("free"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        words = share * float(sums["words"] or 0)
        if sums["n"] == at or not sums["free"]:
            break
        at, level = sums["n"], (words - (sums["fixed"] or 0.0)) / sums["free"]
        full = F.col("weight") * F.lit(level) > top
    target = F.when(full, top).otherwise(F.least(F.col("weight") * F.lit(level), top))
    return ranked.select("key", "source_size", "source_rows", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 7,
    ident: str = "doc_id",
    text: str = "text",
    source: str = "source",
    row: str | None = None,
) -> DataFrame:
    """What the mix takes of each document: ident, size, source_size, target, copies, taken.

    `row` names a column to hand on as well, for instance a row key.

    Sources by code point get the weights in turn, no source (null) last. A null
    text has size 0 and is taken with 0 words. Rows of equal id are ranked by
    size; equal rows are interchangeable. An empty table gives no rows. Other
    columns of `docs` are not read. A source that holds most rows is cut into
    slices of its ranking; only the slice in which the cut falls is sorted.
    """
    key = F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))
    sized = docs.select(
        F.col(ident).alias("ident"), (F.col(row) if row else F.lit(None).cast("long")).alias("row"),
        key.alias("key"), word_count(F.col(text)).alias("size"),
    )
    sized = stage(sized.withColumn("u", uniform(F.col("ident"), seed)), "sized")
    targets = source_targets(sized, weights, share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    slices = F.ceil(F.col("source_rows") / SLICE_ROWS)
    targets = stage(targets.withColumn("whole", whole.cast("long")).withColumn("rest", rest).withColumn("slices", slices), "targets")
    # The odds of the left-over share are one factor for a whole source, so the ranking is by the
    # random odds over the factor of the size. The factor is bounded, so slices of
    # odds / (1 + odds) hold at most twice their share of the rows.
    placed = lookup_join(sized, targets, ["key"])
    by_size = F.when(F.col("source_size") > 0, F.col("size") * F.col("source_rows") / F.col("source_size"))
    factor = F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.coalesce(by_size, F.lit(1.0))))
    random_odds = (F.col("u") + F.lit(0.5)) / (F.lit(float(UNIT)) - F.col("u") - F.lit(0.5))
    placed = placed.withColumn("odds", random_odds / factor)
    share_of = F.col("odds") / (F.col("odds") + F.lit(1.0))
    placed = placed.withColumn("slice", F.least(F.floor(share_of * F.col("slices")), F.col("slices") - 1))
    sums = placed.groupBy("key", "slice").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    running = F.sum("words").over(Window.partitionBy("key").orderBy("slice"))
    cuts = (
        sums.withColumn("reached", running)
        .where(F.col("reached") >= F.col("rest"))
        .groupBy("key")
        .agg(F.min(F.struct("slice", (F.col("reached") - F.col("words")).alias("before"))).alias("cut"))
    )
    placed = lookup_join(placed, stage(cuts, "cuts"), ["key"])
    columns = ["ident", "row", "size", "source_size", "target", "whole"]
    outside = placed.where(F.col("cut").isNull() | (F.col("slice") != F.col("cut.slice"))).select(
        *columns, F.coalesce((F.col("slice") < F.col("cut.slice")).cast("int"), F.lit(0)).alias("more")
    )
    inside = placed.where(F.col("slice") == F.col("cut.slice"))
    order = Window.partitionBy("key").orderBy("odds", "u", "ident", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("cut.before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    inside = inside.withColumn("before", before).select(
        *columns, (F.col("before") + F.col("size") / 2 <= F.col("rest")).cast("int").alias("more")
    )
    copies = F.col("whole") + F.col("more")
    return outside.unionAll(inside).select(
        F.col("ident").alias(ident), "size", "source_size", "target",
        copies.cast("int").alias("copies"), (F.col("size") * copies).alias("taken"), *([F.col("row").alias(row)] if row else []),
    )
