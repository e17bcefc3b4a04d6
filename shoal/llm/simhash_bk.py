"""SimHash near-duplicates found with BK-trees.

Fingerprints within RADIUS differing bits agree on at least one of RADIUS + 1
blocks of their bits. All fingerprints that share a block form a shard. The tree
of a shard has children keyed by their Hamming distance to the parent, and a
search follows only the edges whose distance is within the radius of its own.
A large shard is cut into parts: the tree of each part is copied to every other
part of its shard, which searches it, so no task holds more than two parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from shoal.llm.common import components, fresh, groups, with_workers
from shoal.session import stage

RADIUS = 3
SHINGLE = 3
# Fingerprints of a shard part; larger shards are cut.
PART_ROWS = 1024
# Shingles hashed at a time, whatever the length of a text.
SLICE = 1 << 15


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of a text's word shingles, each counted as often as it occurs."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return digest(b" ".join(words), 42)
    n = len(words) - SHINGLE + 1
    ones = np.zeros(64, np.int64)
    for begin in range(0, n, SLICE):
        some = words[begin : begin + SLICE + SHINGLE - 1]
        hashes = [digest(b" ".join(s), 42) for s in zip(*(some[i:] for i in range(SHINGLE)))]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """ident, fingerprint as a signed long."""
    with_workers(docs)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column("ident"), pa.array(prints)], ["ident", "fingerprint"])

    rows = docs.select(F.col(ident).cast("long").alias("ident"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(hashed, "ident long, fingerprint long")


class BKTree:
    """Metric tree of integers under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at = 0
        while self.values:
            distance = (self.values[at] ^ value).bit_count()
            if not distance:
                return
            child = self.children[at].get(distance)
            if child is None:
                self.children[at][distance] = len(self.values)
                break
            at = child
        self.values.append(value)
        self.children.append({})

    def search(self, value: int, radius: int) -> list[int]:
        found, open_nodes = [], [0] if self.values else []
        while open_nodes:
            at = open_nodes.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(self.values[at])
            for edge, child in self.children[at].items():
                if distance - radius <= edge <= distance + radius:
                    open_nodes.append(child)
        return found


def _spanning_links(tree_values: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """Links within the radius between tree and queries, thinned to a spanning forest."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    tree = BKTree()
    for value in tree_values:
        tree.add(value)
    links = []
    for value in queries or tree_values:
        for other in tree.search(value, radius):
            a, b = top(value), top(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((value, other))
    return links


def fingerprint_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect just the distinct fingerprints within `radius` bits.

    `prints` has one column, fingerprint, without repeats. Of the links inside a
    shard part a spanning forest is kept: components stay the same.
    """
    with_workers(prints)
    blocks = radius + 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    fp = F.col("fingerprint")
    keys = F.array(*[
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.shiftleft(fp, 64 - hi), 64 - hi + lo).alias("bits"))
        for i, (lo, hi) in enumerate(zip(edges, edges[1:]))
    ])
    placed = prints.select(fp, F.explode(keys).alias("key")).select("fingerprint", "key.block", "key.bits")
    sizes = placed.groupBy("block", "bits").count().where("count > 1")
    sizes = sizes.select("block", "bits", F.ceil(F.col("count") / PART_ROWS).cast("int").alias("parts"))
    placed = placed.join(sizes, ["block", "bits"])
    own = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
    # part p searches the trees of parts 0..p; its own tree goes to parts p + 1.. as well
    others = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda o: F.struct(F.least(o, "part").alias("tree"), F.greatest(o, "part").alias("searcher"), (o >= F.col("part")).alias("in_tree")),
    )
    dealt = placed.withColumn("part", own).select("block", "bits", "fingerprint", F.explode(others).alias("to"))
    keys = ["block", "bits", "tree", "searcher"]
    dealt = dealt.select("block", "bits", "to.tree", "to.searcher", "to.in_tree", "fingerprint")
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []
        for _, parts in groups(batches, keys):
            rows = pa.Table.from_batches(parts)
            values = rows.column("fingerprint").to_numpy().astype("<i8").view("<u8").tolist()
            in_tree = rows.column("in_tree").to_pylist()
            tree = [v for v, t in zip(values, in_tree) if t]
            held.extend(_spanning_links(tree, [v for v, t in zip(values, in_tree) if not t], radius))
            if len(held) >= 10_000:
                yield _pairs(held)
                held = []
        yield _pairs(held)

    return dealt.mapInArrow(search, "a long, b long").distinct()


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = np.array(links, "<u8").reshape(-1, 2).view("<i8")
    return pa.RecordBatch.from_arrays([pa.array(columns[:, 0]), pa.array(columns[:, 1])], ["a", "b"])


def fingerprint_classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fingerprint, root: the class of each fingerprint that links with another one."""
    links = fingerprint_links(prints.select("fingerprint").distinct(), radius)
    return components(links, "a", "b").withColumnsRenamed({"id": "fingerprint"})


def near_duplicates(docs: DataFrame, radius: int = RADIUS, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """ident, fingerprint (16 hex digits), component_id: the smallest id reachable by links.

    A null text, an empty text and one of white space have fingerprint zero and
    link with each other. Rows of equal id give one row each. Null ids are never
    the smallest; a component of null ids alone has none. An empty table gives
    no rows, other columns are not read. Copies share one fingerprint, so they
    add nothing to the search.
    """
    prints = stage(fingerprints(docs, ident, text), "fingerprints")
    least = prints.groupBy("fingerprint").agg(F.min("ident").alias("least"))
    least = stage(least, "least")
    classes = fingerprint_classes(least, radius)
    rooted = least.join(classes, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(smallest, "root").select("fingerprint", "component_id")
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return prints.join(by_print, "fingerprint").select(
        F.col("ident").alias(ident), digits.alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, radius: int = RADIUS, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each class of near-duplicates: the smallest id, all columns as they are.

    Rows of one class and equal id count as one document, and any one of them
    stays. A null id is kept only if its class has no other id.
    """
    with_workers(docs)
    columns = docs.columns
    mark = fresh("fingerprint", columns)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(columns.index(text)).cast(pa.binary()).to_pylist()
            prints = pa.array(np.array([fingerprint(t) for t in texts], "<u8").view("<i8"))
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], names=[*columns, mark])

    marked = stage(docs.mapInArrow(hashed, T.StructType([*docs.schema.fields, T.StructField(mark, T.LongType())])), "marked")
    prints = marked.select(F.col(mark).alias("fingerprint"), F.col(ident).alias("ident"))
    order = F.struct(F.col("ident").isNull().alias("none"), "ident", "fingerprint")
    least = stage(prints.groupBy("fingerprint").agg(F.min(order).alias("least")), "least")
    classes = fingerprint_classes(least, radius)
    rooted = least.join(classes, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    kept = rooted.groupBy("root").agg(F.min("least").alias("least"))
    kept = kept.select(F.col("least.ident").alias("_kept_id"), F.col("least.fingerprint").alias("_kept_print"))
    # ids are unique but for repeated rows, so the second step finds little to do
    same = marked[mark].eqNullSafe(kept["_kept_print"]) & marked[ident].eqNullSafe(kept["_kept_id"])
    return marked.join(kept, same, "left_semi").dropDuplicates([ident, mark]).drop(mark)
