"""Fill-in-middle transformation with a piecewise-linear learned index of the cut places.

Every boundary between units of a text (lines, by default) has a rank and an
offset in code points. An index predicts the offset from the rank: the ranks are
covered greedily by straight segments, each as long as one slope keeps all its
offsets within ERROR, and what the line misses is stored for every rank. A cut
at a rank is predicted by its segment and put right by the stored residual, so
it is exact. The index needs no text, so other cuts of the same documents can
be placed from it alone (`boundary_index`, `offset_at`).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from shoal.llm.common import with_workers

# Residuals within this error fit in one signed byte.
ERROR = 127
# Boundaries that the fit looks at first; doubled while a segment goes on.
LOOK = 32
# Texts of one batch that are worked on together, in code points.
CHUNK = 4 << 20


class Sentinels(NamedTuple):
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


class RankIndex(NamedTuple):
    """Segments (first rank, offset there, slope) and the residual of every rank."""

    rank: np.ndarray
    offset: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.rank, ranks, "right") - 1
        return self.offset[at] + np.rint(self.slope[at] * (ranks - self.rank[at])).astype(np.int64)

    def lookup(self, ranks: np.ndarray) -> np.ndarray:
        """Exact offsets of boundaries by rank."""
        return self.predict(ranks) + self.residual[ranks]


def fit_index(offsets: np.ndarray, error: int = ERROR) -> RankIndex:
    """Cover all boundary offsets, in rank order, by segments that err by `error` at most.

    A segment starts on its first boundary. Each further one narrows the range of
    slopes that keep within the error; where none is left, a new segment starts.
    """
    n, first = len(offsets), 0
    starts, slopes = [], []
    while first < n:
        low, high, done, look = -np.inf, np.inf, first + 1, LOOK
        while done < n:
            part = offsets[done : done + look] - offsets[first]
            run = np.arange(done - first, done - first + len(part))
            lows = np.maximum(np.maximum.accumulate((part - error) / run), low)
            highs = np.minimum(np.minimum.accumulate((part + error) / run), high)
            bad = np.flatnonzero(lows > highs)
            fit = int(bad[0]) if len(bad) else len(part)
            if fit:
                low, high = lows[fit - 1], highs[fit - 1]
            done += fit
            if len(bad):
                break
            look *= 2
        starts.append(first)
        slopes.append((low + high) / 2 if done > first + 1 else 0.0)
        first = done
    rank = np.array(starts, np.int64)
    index = RankIndex(rank, offsets[rank], np.array(slopes), np.zeros(0, np.int64))
    residual = offsets - index.predict(np.arange(n))
    return index._replace(residual=residual.astype(np.int8 if error <= 127 else np.int64))


def boundaries(text: str, separator: str = "\n") -> np.ndarray:
    """Offsets in code points of 0, the end of each unit, and so the end of the text."""
    if text.isascii():
        codes = np.frombuffer(text.encode("ascii"), np.uint8)
    else:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero(codes == ord(separator)) + 1
    last = [len(text)] if text and not text.endswith(separator) else []
    return np.concatenate([[0], ends, last]).astype(np.int64)


def _chunks(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + CHUNK, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _check(marks: Sentinels) -> None:
    """Sentinels must be told apart wherever they stand: none overlaps another, or itself."""
    for a in marks:
        for b in marks:
            overlap = any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b))))
            if not a or overlap or (a is not b and a in b):
                raise ValueError(f"sentinels {a!r} and {b!r} can overlap")


def boundary_index(docs: DataFrame, ident: str = "doc_id", text: str = "text", separator: str = "\n") -> DataFrame:
    """The index of each text: ident, n units, segments, and the residual of every rank.

    A null text is the empty text, whose index has the one boundary 0. Each row is
    indexed by itself, so repeated rows and ties give equal indexes; an empty
    table gives no rows; other columns are not read. A very long text is one row
    of one task, with 8 bytes of memory a boundary.
    """
    with_workers(docs)
    kinds = "n long, segments array<struct<rank:long,offset:long,slope:double>>, residuals array<tinyint>"
    schema = T.StructType([T.StructField("ident", docs.schema[ident].dataType), *T.StructType.fromDDL(kinds)])
    segment = pa.struct([("rank", pa.int64()), ("offset", pa.int64()), ("slope", pa.float64())])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, "body"):
                made = [fit_index(boundaries(body, separator)) for body in part.column("body").to_pylist()]
                segments = [[dict(rank=r, offset=o, slope=s) for r, o, s in zip(*(a.tolist() for a in m[:3]))] for m in made]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("ident"),
                        pa.array([len(m.residual) - 1 for m in made], pa.int64()),
                        pa.array(segments, pa.list_(segment)),
                        pa.array([m.residual for m in made], pa.list_(pa.int8())),
                    ],
                    names=schema.names,
                )

    body = F.coalesce(F.col(text), F.lit("")).alias("body")
    return docs.select(F.col(ident).alias("ident"), body).mapInArrow(index, schema).withColumnRenamed("ident", ident)


def offset_at(rank: Column) -> Column:
    """Exact offset of a boundary by rank, from the columns of `boundary_index`."""
    found = F.element_at(F.filter("segments", lambda s: s["rank"] <= rank), -1)
    # bound once, as three fields of it are read
    line = F.transform(F.array(found), lambda s: s["offset"] + F.rint(s["slope"] * (rank - s["rank"])).cast("long"))
    return line[0] + F.element_at("residuals", (rank + 1).cast("int"))


def draws(ident: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document: the first digits of sha256 of `seed:id` (null: `seed:`)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    docs: DataFrame,
    *,
    ident: str = "doc_id",
    text: str = "text",
    separator: str = "\n",
    seed: int = 7,
    rate: int = 100,
    spm_rate: int = 50,
    marks: Sentinels = Sentinels(),
) -> DataFrame:
    """Cut each text in three at unit ends and reorder it for fill-in-middle training.

    Columns: ident, n units, form (psm, spm or plain), prefix_chars, middle_chars
    in code points (null if plain) and output. The cuts are at the ranks h1 and h2
    modulo n + 1, the smaller first; h3 and h4 choose the form: `rate` percent of
    the documents are cut, `spm_rate` percent of those into suffix-prefix-middle.
    A text that is empty, null (taken as empty) or holds a sentinel stays plain.
    The choice depends on id and seed alone: ties and repeated rows are cut alike,
    rows without an id draw as the empty id. An empty table gives no rows; other
    columns are not read. Every row is worked on by itself in one narrow stage; a
    very long text is one row of one task, with 8 bytes of memory a boundary.
    """
    _check(marks)
    with_workers(docs)
    body = F.coalesce(F.col(text), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(ident), seed)
    marked = F.lit(False)
    for mark in marks:
        marked = marked | body.contains(mark)
    form = F.when((body == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    rows = docs.select(F.col(ident).alias("ident"), body.alias("body"), h1.alias("h1"), h2.alias("h2"), form.alias("form"))
    kinds = "n long, form string, prefix_chars long, middle_chars long, output string"
    schema = T.StructType([T.StructField("ident", docs.schema[ident].dataType), *T.StructType.fromDDL(kinds)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, "body"):
                made = []
                for body, h1, h2, form in zip(*(part.column(c).to_pylist() for c in ("body", "h1", "h2", "form"))):
                    offsets = boundaries(body, separator)
                    n = len(offsets) - 1
                    if form == "plain":
                        made.append((n, form, None, None, body))
                        continue
                    ranks = np.sort(np.array([h1 % (n + 1), h2 % (n + 1)]))
                    a, b = fit_index(offsets).lookup(ranks).tolist()
                    head, middle, tail = marks.prefix + body[:a], marks.middle + body[a:b], marks.suffix + body[b:]
                    made.append((n, form, a, b - a, head + tail + middle if form == "psm" else tail + head + middle))
                columns = [pa.array(c, kind) for c, kind in zip(zip(*made), types)]
                yield pa.RecordBatch.from_arrays([part.column("ident"), *columns], names=schema.names)

    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return rows.mapInArrow(cut, schema).withColumnRenamed("ident", ident)


def restored(output: Column, form: Column, marks: Sentinels = Sentinels()) -> Column:
    """The text that an output of `fill_in_middle` was made of."""
    def between(first: str, second: str | None) -> Column:
        begin = F.locate(first, output) + len(first)
        end = F.locate(second, output) if second else F.length(output) + 1
        return F.substring(output, begin, end - begin)

    p, s, m = marks
    return (
        F.when(form == "psm", F.concat(between(p, s), between(m, None), between(s, m)))
        .when(form == "spm", F.concat(between(p, m), between(m, None), between(s, p)))
        .otherwise(output)
    )


def fim_digest(docs: DataFrame) -> DataFrame:
    """One row per document: the cut, and digests of its output and of the text rebuilt from it."""
    def digest(value: Column) -> Column:
        return F.sha2(value.cast("binary"), 256)

    made = fill_in_middle(docs)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
