"""Places of pattern matches in texts, as column expressions that stay linear in the matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Array elements that one inner scan appends one by one.
BLOCK = 64
FOUND = "array<struct<start:int,end:int,match:string,before:string,after:string>>"


def running(values: Column, merge: Callable[[Column, Column], Column], zero: int = 0) -> Column:
    """Inclusive running `merge` of an array of ints, in blocks, so that no long array is grown one by one."""
    def scan(some: Column) -> Column:
        begin = F.struct(F.lit(zero).alias("last"), F.array().cast("array<int>").alias("out"))

        def step(acc: Column, value: Column) -> Column:
            now = merge(acc["last"], value)
            return F.struct(now.alias("last"), F.concat(acc["out"], F.array(now)).alias("out"))

        return F.aggregate(some, begin, step, lambda a: a["out"])

    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(BLOCK))
    blocks = F.transform(starts, lambda at: scan(F.slice(values, at, F.lit(BLOCK))))
    # the last value of every block, and from those what comes before a block
    last = F.transform(F.filter(blocks, lambda b: F.size(b) > 0), lambda b: F.element_at(b, -1))
    before = F.concat(F.array(F.lit(zero)), scan(last))
    joined = F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda b, x: F.transform(b, lambda v: merge(x, v)))
    return F.flatten(joined)


def found(text: Column, pattern: str, around: int = 0) -> Column:
    """Matches of `pattern`, leftmost first and not overlapping: start and end in code points, match,
    and up to `around` characters on either side that belong to no match.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def placed(both: Column) -> Column:
        hits, gaps = both["hits"], both["gaps"]
        n = F.size(hits)
        lengths = F.zip_with(hits, F.slice(gaps, F.lit(1), n), lambda h, g: F.length(g) + F.length(h))
        ends = running(lengths, lambda a, b: a + b)
        whole = F.arrays_zip(
            hits.alias("match"), ends.alias("end"), F.slice(gaps, F.lit(1), n).alias("before"), F.slice(gaps, F.lit(2), n).alias("after")
        )
        return F.transform(whole, lambda w: F.struct(
            (w["end"] - F.length(w["match"])).alias("start"), w["end"].alias("end"), w["match"].alias("match"),
            F.right(w["before"], F.lit(around)).alias("before"), F.left(w["after"], F.lit(around)).alias("after"),
        ))

    # a one-element array binds matches and gaps once
    bound = F.element_at(F.transform(F.array(F.struct(hits.alias("hits"), gaps.alias("gaps"))), placed), 1)
    return F.when(text.rlike(pattern), bound).otherwise(F.array().cast(FOUND))


def apart(spans: Column, others: Column) -> Column:
    """The spans (structs with start and end) that touch none of the others; linear but for two sorts."""
    def both(mine: Column, given: Column) -> Column:
        return F.array_sort(F.concat(
            F.transform(given, lambda o: F.struct(o["start"].alias("start"), F.lit(0).alias("mine"), o["end"].alias("end"), F.lit(0).alias("at"))),
            F.transform(mine, lambda s, i: F.struct(s["start"].alias("start"), F.lit(1).alias("mine"), s["end"].alias("end"), (i + 1).alias("at"))),
        ))

    def judged(line: Column) -> Column:
        # the furthest end of an other that starts before, and the nearest start of one that comes after
        reach = running(F.transform(line, lambda p: F.when(p["mine"] == 0, p["end"]).otherwise(0)), lambda a, b: F.greatest(a, b))
        far = 2**31 - 1
        starts = F.transform(F.reverse(line), lambda p: F.when(p["mine"] == 0, p["start"]).otherwise(far))
        ahead = F.reverse(running(starts, lambda a, b: F.least(a, b), far))
        whole = F.arrays_zip(line.alias("p"), reach.alias("reach"), ahead.alias("ahead"))
        clear = F.filter(whole, lambda w: (w["p"]["mine"] == 1) & (w["reach"] <= w["p"]["start"]) & (w["ahead"] >= w["p"]["end"]))
        return F.transform(clear, lambda w: w["p"]["at"])

    def kept(places: Column) -> Column:
        return F.transform(places, lambda at: F.element_at(spans, at))

    line = F.element_at(F.transform(F.array(both(spans, others)), judged), 1)
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), kept(line)).otherwise(spans)
