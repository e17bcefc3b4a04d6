"""Secret scan by patterns and sliding-window Shannon entropy. Native: column functions only.

Three pattern kinds report assignments, access keys and hex digests. Beyond
them, every candidate string (a run of 20 or more key characters) is read by a
window of 20 characters. The window's sum of c * log2(c) over its character
counts is kept up to date as one character leaves and one enters; the entropy
log2(20) - sum / 20 is compared with a bound for the window's character class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shoal.llm.spans import apart, found

# The pattern kinds in their order, and what a match must have.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}+"
ASSIGN_LENGTH = 6
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
# Bits per character from which a window counts: hex digits, digits with letters of both
# cases, FEW_DIGITS or more digits with letters of one case, and other letters.
HEX_BITS, MIXED_BITS, LOWER_BITS, UPPER_BITS, LETTER_BITS = 3.0, 3.8, 3.7, 3.6, 3.9
FEW_DIGITS = 3

# Known not to be secrets: UUIDs, which are blanked in a candidate, and hot spans, widened
# to the separators around them, that are documentation keys, counting sequences or plain
# words and numbers; or that end a published checksum.
UUID = r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9A-Za-z])"
ALLOWED = (
    r"(?:EXAMPLE|SAMPLE|PLACEHOLDER)(?:KEY)?$",
    r"(?i)^(?:0?123456789?0?|9876543210|abcdef(?:ghij(?:klmnopqrstuvwxyz)?)?|\+)+$",
    r"^[/_=-]*(?:(?:[A-Za-z]{1,19}[0-9]{0,2}|[0-9]{1,8})[/_=-]+)+(?:[A-Za-z]{1,19}[0-9]{0,2}|[0-9]{1,8})?$",
)
CHECKSUM = (
    r"(?:^|[/_=-])(?:sha1-[A-Za-z0-9+/]{1,27}|sha256-[A-Za-z0-9+/]{1,43}|sha384-[A-Za-z0-9+/]{1,64}|sha512-[A-Za-z0-9+/]{1,86})=*$"
    r"|(?:^|[/_=-])(?:md5|sha1|sha256|sha384|sha512)[-=_][0-9a-fA-F]{1,128}$"
)


def spans_of(hits: Column, kind: int) -> Column:
    return F.transform(
        hits, lambda h: F.struct(h["start"].alias("start"), F.lit(kind).alias("kind"), (h["start"] + F.length(h["match"])).alias("end"))
    )


def hot_windows(candidate: Column) -> Column:
    """Stretches of an ASCII string covered by windows above their bound: (start, end) in it."""
    kind = "array<struct<start:int,end:int>>"
    chars = F.filter(F.split(candidate, ""), lambda c: c != "")

    def weight(count: Column) -> Column:
        return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))

    def is_in(c: Column, pattern: str) -> Column:
        return F.when(c.rlike(pattern), 1).otherwise(0)

    classes = {"digit": "[0-9]", "upper": "[A-Z]", "lower": "[a-z]", "hexes": "[0-9a-fA-F]"}

    def step(acc: Column, i: Column) -> Column:
        # chars i - WINDOW + 1 .. i are the window that ends at the 1-based place i
        entering = F.element_at(acc["chars"], i)
        leaving = F.when(i > WINDOW, F.element_at(acc["chars"], F.greatest(i - WINDOW, F.lit(1))))
        kept = F.slice(acc["chars"], F.greatest(i - WINDOW + 1, F.lit(1)), F.least(i - 1, F.lit(WINDOW - 1)))

        def in_kept(c: Column) -> Column:
            return F.size(kept) - F.size(F.array_remove(kept, c))

        def after(value: Column, change) -> Column:
            return value + change(entering) - F.coalesce(change(leaving), F.lit(0))

        lost = F.when(leaving.isNotNull(), weight(in_kept(leaving) + 1) - weight(in_kept(leaving))).otherwise(F.lit(0.0))
        counts = {name: after(acc[name], lambda c, p=p: F.when(c.isNotNull(), is_in(c, p))) for name, p in classes.items()}
        total = acc["total"] - lost + weight(in_kept(entering) + 1) - weight(in_kept(entering))
        return F.struct(acc["chars"].alias("chars"), total.alias("total"), *[c.alias(n) for n, c in counts.items()], *[acc[n].alias(n) for n in ("from", "to", "hot")]), i

    def judged(state: Column, i: Column) -> Column:
        bits = F.log2(F.lit(float(WINDOW))) - state["total"] / WINDOW
        hexes = (state["hexes"] == WINDOW) & (state["digit"] > 0) & (state["digit"] < WINDOW) & (bits >= HEX_BITS - 1e-9)
        one_case = F.when(state["lower"] > 0, LOWER_BITS).otherwise(UPPER_BITS)
        one_case = F.when(state["digit"] < FEW_DIGITS, LETTER_BITS).otherwise(one_case)
        two_cases = (state["upper"] > 0) & (state["lower"] > 0)
        least = F.when(two_cases, F.when(state["digit"] > 0, MIXED_BITS).otherwise(LETTER_BITS)).otherwise(one_case)
        mixed = (state["upper"] + state["lower"] > 0) & (bits >= least - 1e-9)
        begin = i - WINDOW
        counts_now = (i >= WINDOW) & (hexes | mixed)
        # the stretch that still grows is kept apart, so that an array is built on only where one ends
        joined = counts_now & (state["to"] >= begin) & (state["to"] >= 0)
        ended = counts_now & ~joined & (state["to"] >= 0)
        last = F.array(F.struct(state["from"].alias("start"), state["to"].alias("end")))
        return F.struct(
            state["chars"].alias("chars"), state["total"].alias("total"), *[state[n].alias(n) for n in classes],
            F.when(counts_now & ~joined, begin).otherwise(state["from"]).alias("from"),
            F.when(counts_now, i).otherwise(state["to"]).alias("to"),
            F.when(ended, F.concat(state["hot"], last)).otherwise(state["hot"]).alias("hot"),
        )

    def both(acc: Column, i: Column) -> Column:
        state, at = step(acc, i)
        # a one-element array binds the new state once
        return F.element_at(F.transform(F.array(state), lambda s: judged(s, at)), 1)

    begin = F.struct(
        chars.alias("chars"), F.lit(0.0).alias("total"), *[F.lit(0).alias(n) for n in classes],
        F.lit(-1).alias("from"), F.lit(-1).alias("to"), F.array().cast(kind).alias("hot"),
    )

    def finished(s: Column) -> Column:
        last = F.array(F.struct(s["from"].alias("start"), s["to"].alias("end")))
        return F.when(s["to"] >= 0, F.concat(s["hot"], last)).otherwise(s["hot"])

    return F.aggregate(F.sequence(F.lit(1), F.length(candidate)), begin, both, finished)


def known(run: Column, hot: Column) -> Column:
    """Whether a hot span of a candidate, widened to the separators around it, is on the allow-list."""
    left = F.regexp_extract(F.substring(run, F.lit(1), hot["start"]), "[^/=_-]*$", 0)
    right = F.regexp_extract(F.substring(run, hot["end"] + 1, F.length(run)), "^[^/=_-]*", 0)
    whole = F.concat(left, F.substring(run, hot["start"] + 1, hot["end"] - hot["start"]), right)
    upto = F.concat(F.substring(run, F.lit(1), hot["end"]), right)
    return whole.rlike("|".join(f"(?:{p})" for p in ALLOWED)) | upto.rlike(CHECKSUM)


def entropy_spans(text: Column) -> Column:
    """Spans of high entropy in candidate strings that are not on the allow-list."""
    # a window can only count with a letter in it
    runs = F.filter(found(text, CANDIDATE), lambda r: r["match"].rlike("[A-Za-z]"))
    spans = F.transform(
        runs,
        lambda r: F.transform(
            F.filter(hot_windows(F.regexp_replace(r["match"], UUID, " " * 36)), lambda h: ~known(r["match"], h)),
            lambda h: F.struct((r["start"] + h["start"]).alias("start"), F.lit(3).alias("kind"), (r["start"] + h["end"]).alias("end")),
        ),
    )
    return F.flatten(spans)


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, by start and then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    parts = F.transform(
        F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(parts, ",")


def scan_secrets(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Secrets of each text: ident, base and added, both arrays of (start, kind, end).

    `kind` numbers KINDS. Places are code points, the end is exclusive. Base
    spans are the pattern kinds' leftmost non-overlapping matches that are long
    enough; added spans have high entropy and touch no base span. A null or
    empty text has none; repeated rows are scanned alike; an empty table gives
    no rows; other columns are not read. The scan is one narrow stage, and its
    work on a very long text grows with the text and its matches.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(
        found(body, ASSIGN), lambda h: F.length(F.regexp_extract(h["match"], ASSIGN, 2)) >= ASSIGN_LENGTH
    )
    base = F.concat(spans_of(assign, 0), spans_of(found(body, ACCESS), 1), spans_of(found(body, HEX), 2))
    scanned = docs.select(F.col(ident).alias("ident"), base.alias("base"), entropy_spans(body).alias("hot"))
    added = apart(F.col("hot"), F.col("base"))
    return scanned.select(F.col("ident").alias(ident), "base", added.alias("added"))


def secret_digest(docs: DataFrame) -> DataFrame:
    """Counts per kind, a digest of the base spans and all spans, one row per document."""
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return scan_secrets(docs).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.concat("base", "added")).alias("spans"),
    )
