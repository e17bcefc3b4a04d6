"""Column functions over JSON text and VARIANT values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from shoal.functions.binding import let

# JSON text patterns (Java regular expressions, possessive so that
# a megabyte-long string cannot exhaust the matcher's stack).
STARTS_AS_OBJECT = r"^\s*\{"
CLOSES_EARLY = r"\}\s*\]"
STRING_LITERAL = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
HUGE_EXPONENT = r"[0-9][eE]\+?[0-9]{3}"
HUGE_MANTISSA = r"[0-9]{200}"
NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"

# The scanner of the ingest format gives up on a line that fills 1 MiB.
LINE_LIMIT_BYTES = 1024 * 1024


def parse_in_array(value: Column) -> Column:
    """The line between brackets, parsed; NULL if that is not valid JSON.

    ``try_parse_json`` ignores whatever follows the first value; between
    brackets trailing text breaks the array instead.
    """
    return F.try_parse_json(F.concat(F.lit("["), value, F.lit("]")))


def sole_object(value: Column, in_array: Column) -> Column:
    """VARIANT object of a line that is exactly one JSON object, else NULL.

    `in_array` is `parse_in_array(value)`. Two leaks are left to close: several
    values (a second element), and a line that closes the array itself. The
    latter cannot also close an object, so lines that look like it are parsed
    a second time inside one. Numbers beyond a 64-bit float are an error, as
    they are for a float64 decoder.
    """
    in_object = F.try_parse_json(F.concat(F.lit('{"r":'), value, F.lit("}")))
    bare = F.regexp_replace(value, STRING_LITERAL, '""')
    overflows = F.exists(
        F.regexp_extract_all(bare, F.lit(NUMBER), 0),
        lambda n: F.abs(n.try_cast("double")) == F.lit(float("inf")),
    )
    maybe_huge = value.rlike(HUGE_EXPONENT) | value.rlike(HUGE_MANTISSA)
    return F.when(
        value.rlike(STARTS_AS_OBJECT)
        & F.try_variant_get(in_array, "$[1]", "variant").isNull()
        & F.when(value.rlike(CLOSES_EARLY), in_object.isNotNull()).otherwise(F.lit(True))
        & F.when(maybe_huge, ~overflows).otherwise(F.lit(True)),
        F.try_variant_get(in_array, "$[0]", "variant"),
    )


def parse_object(value: Column) -> Column:
    """`sole_object` of a line as a single column expression."""
    return let(parse_in_array(value), lambda parsed: sole_object(value, parsed))


def _segment(part: str) -> str | None:
    if "'" not in part:
        return f"['{part}']"
    if '"' not in part:
        return f'["{part}"]'
    return None


def get_nested(variant: Column, path: str, to: str = "variant") -> Column:
    """Value at a dotted path of object keys; NULL where any step is missing.

    Keys are case-sensitive, arrays are never indexed and a key that itself
    holds a dot cannot be reached.
    """
    parts = path.split(".")
    segments = [_segment(p) for p in parts]
    if all(segments):
        return F.try_variant_get(variant, "$" + "".join(segments), to)
    value = variant
    for part in parts:
        value = F.try_element_at(as_map(value), F.lit(part))
    return F.try_variant_get(value, "$", to)


def stringify(variant: Column) -> Column:
    """Text of a scalar; JSON text of an object or array; NULL of JSON null.

    Whole numbers keep their exact digits.
    """
    return F.try_variant_get(variant, "$", "string")


def as_map(variant: Column) -> Column:
    """Top-level keys of an object as MAP<STRING, VARIANT>; NULL otherwise."""
    return variant.try_cast("map<string,variant>")


def metadata_all_except(variant: Column, content_key: str, id_key: str) -> Column:
    """Every top-level key other than the two configured names, as one object.

    The names are compared whole: with ``a.b`` configured, key ``a`` stays.
    """
    kept = F.map_filter(as_map(variant), lambda k, _: ~k.isin(content_key, id_key))
    return F.to_variant_object(kept)


def metadata_selected(variant: Column, keys: Iterable[str]) -> Column:
    """The listed top-level keys that exist (a JSON null counts as existing)."""
    wanted = list(dict.fromkeys(keys))
    if not wanted:
        return F.parse_json(F.lit("{}"))
    kept = F.map_filter(as_map(variant), lambda k, _: k.isin(*wanted))
    return F.to_variant_object(kept)
