"""Embedding near-duplicates by NN-descent.

A neighbour graph starts from small random leaves and random groups and is
refined: the neighbours of a vector, forward and backward, are compared with
each other, and every vector keeps its best ones. A vector whose whole list is
above the threshold is saturated; the members of its class are compared in
blocks with those of every block of the label that the angles between block
centres cannot rule out. Labels of few vectors are compared whole in such
blocks. Recall is audited against brute force on a bounded query sample per
size of label; below the bound, leaves are added, and in the end it is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shoal.llm.common import components, groups, with_workers
from shoal.session import stage

NEIGHBOURS = 8
# Vectors compared with each other in one leaf of the first graph.
LEAF = 128
TREES = 4
MOST_ROUNDS = 6
# Rounds end when the links grow by less than this share and the audit is passed.
SETTLED = 0.002
# Vectors of a block in the enlarged comparison, and block centres that are compared at once.
BLOCK = 256
TILE = 2048
# Labels of at most this many different vectors are compared whole.
WHOLE = 1024
# Vectors of a random group in the first graph.
RANDOM = 16
# Audited vectors per size of label, and as many if none of the first has a link.
AUDIT_QUERIES = 500
MORE_QUERIES = 4000
RECALL = 0.95


@dataclass
class Audit:
    """Audited vectors that have links by brute force, and the sum of the shares of them that were found."""

    expected: int
    found: float

    @property
    def recall(self) -> float:
        """1 where no audited vector has a link: there was nothing to miss."""
        return self.found / self.expected if self.expected else 1.0


def comparable(vectors: DataFrame, ident: str, embedding: str, label: str) -> DataFrame:
    """id, label, v of the vectors that can link: finite, not zero, with a label and an id."""
    rows = vectors.select(F.col(ident).cast("long").alias("id"), F.col(label).alias("label"), F.col(embedding).alias("v"))
    rows = rows.where("id is not null and label is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad).where(F.exists("v", lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal width as rows of unit length in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)  # the squares below stay in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


EDGE = "src long, dst long, sim double"


def _edges(src, dst, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(sim, pa.float64())], ["src", "dst", "sim"])


def _best(ids: np.ndarray, sims: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best `k` partners of each row of a similarity matrix, above the row's floor."""
    np.fill_diagonal(sims, -2.0)
    n = len(ids)
    k = min(k, n - 1)
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < n - 1 else np.argsort(-sims, axis=1)[:, :k]
    rows = np.repeat(np.arange(n), k)
    at = at.ravel()
    got = sims[rows, at]
    keep = got > (floor[rows] if floor is not None else -2.0)
    return ids[rows[keep]], ids[at[keep]], got[keep]


def sized(unit: DataFrame) -> DataFrame:
    """`unit` with the width of its vectors, the vectors of that width in its label, and the depth of its leaves."""
    wide = unit.withColumn("size", F.size("v"))
    total = wide.groupBy("label", "size").agg(F.count("*").alias("total"), F.min("id").alias("least"))
    bits = F.least(F.lit(60), F.greatest(F.lit(0), F.ceil(F.log2(F.col("total") / (LEAF / 2))))).cast("int")
    return wide.join(total, ["label", "size"]).withColumn("bits", bits)


def first_graph(unit: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Edges between vectors that share a leaf or a random group of their label.

    Leaves are signs of random projections, as many as the label's own size
    asks for, cut to LEAF rows by a hash. The random groups give edges to
    vectors that are alone in their leaves.
    """
    with_workers(unit)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.filter(pc.equal(b.column("size"), n)) for b in batches for n in pc.unique(b.column("size")).to_pylist()):
            x, bits = matrix(batch.column("v")), batch.column("bits").to_numpy()
            most = int(bits.max())
            mine = (np.int64(1) << bits.astype(np.int64)) - 1
            for tree in range(TREES):
                planes = np.random.default_rng(1000 * (seed + 1) + tree).standard_normal((60, x.shape[1]))[:most].T
                leaf = (x @ planes > 0).astype(np.int64) @ (1 << np.arange(most, dtype=np.int64)) & mine
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label"), batch.column("size"), pa.array(np.full(len(x), tree), pa.int32()), pa.array(leaf), batch.column("id"), batch.column("v")],
                    ["label", "size", "tree", "leaf", "id", "v"],
                )

    kind = dict(unit.dtypes)["label"]
    placed = unit.select("label", "size", "bits", "id", "v").mapInArrow(
        leaves, f"label {kind}, size int, tree int, leaf long, id long, v {dict(unit.dtypes)['v']}"
    )
    group = F.pmod(F.xxhash64("id", F.lit(seed)), F.ceil(F.col("total") / RANDOM))
    placed = placed.unionAll(unit.select("label", "size", F.lit(TREES).alias("tree"), group.alias("leaf"), "id", "v"))
    placed = stage(placed, "leaves")
    full = placed.groupBy("label", "size", "tree", "leaf").count().withColumn("parts", F.ceil(F.col("count") / LEAF).cast("int"))
    placed = placed.join(full.drop("count"), ["label", "size", "tree", "leaf"])
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id", "tree"), F.col("parts")).cast("int"))
    keys = ["label", "size", "tree", "leaf", "part"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in groups(batches, keys):
            rows = pa.Table.from_batches(parts)
            if rows.num_rows > 1:
                x = matrix(rows.column("v"))
                yield _edges(*_best(rows.column("id").to_numpy(), x @ x.T, k))

    dealt = placed.select(*keys, "id", "v").repartition(*keys).sortWithinPartitions(*keys)
    return top_edges(dealt.mapInArrow(compare, EDGE), k)


def top_edges(edges: DataFrame, k: int) -> DataFrame:
    """The best `k` edges of each source, each once."""
    order = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return edges.groupBy("src", "dst").agg(F.max("sim").alias("sim")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def refine(graph: DataFrame, unit: DataFrame, k: int) -> DataFrame:
    """One round: neighbours of each vector, forward and backward, meet and may become neighbours."""
    # backward lists keep their best 2k; what that leaves out meets in other lists
    order = Window.partitionBy("dst").orderBy(F.desc("sim"), "src")
    back = graph.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2 * k)
    floor = graph.groupBy("src").agg(F.min("sim").alias("floor"), F.count("*").alias("n"))
    floor = floor.select(F.col("src").alias("id"), F.when(F.col("n") >= k, F.col("floor")).otherwise(-2.0).alias("floor"))
    members = (
        graph.select(F.col("src").alias("hub"), F.col("dst").alias("id"))
        .unionAll(back.select(F.col("dst").alias("hub"), F.col("src").alias("id")))
        .unionAll(graph.select(F.col("src").alias("hub"), F.col("src").alias("id")))
        .distinct()
    )
    known = unit.select("id", "v").join(floor, "id", "left").fillna(-2.0, ["floor"])
    dealt = members.join(known, "id").repartition("hub").sortWithinPartitions("hub")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for _, parts in groups(batches, ["hub"]):
            rows = pa.Table.from_batches(parts)
            if rows.num_rows > 1:
                x = matrix(rows.column("v"))
                held.append(_best(rows.column("id").to_numpy(), x @ x.T, k, rows.column("floor").to_numpy()))
                if len(held) >= 2000:
                    yield _edges(*map(np.concatenate, zip(*held)))
                    held = []
        if held:
            yield _edges(*map(np.concatenate, zip(*held)))

    found = dealt.select("hub", "id", "v", "floor").mapInArrow(meet, EDGE)
    return top_edges(graph.unionAll(found), k)


def saturated(links: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """Vectors (id) whose whole list is above the threshold."""
    return links.groupBy("src").count().where(F.col("count") >= k).select(F.col("src").alias("id"))


def descend(
    unit: DataFrame, threshold: float, k: int = NEIGHBOURS, rounds: int = MOST_ROUNDS
) -> tuple[DataFrame, DataFrame, list[Audit]]:
    """Links per vector (id, n), edges (src, dst) that connect the same vectors, and the audit of each size of label.

    At least two rounds are made; more as long as links appear or the audit
    finds too few of the true links, each of them from new leaves. It is an
    error if the last audit fails.
    """
    truth = true_links(unit, threshold)
    graph = stage(first_graph(unit, k), "graph")
    before = -1
    for turn in range(rounds):
        graph = stage(refine(graph, unit, k), "graph")
        near = graph.where(F.col("sim") >= threshold)
        n = near.count()
        if turn == rounds - 1 or turn and n - before <= SETTLED * n:
            both = near.select("src", "dst").unionAll(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
            degree, edges = gathered(unit, stage(both, "links"), threshold)
            audits = audit(truth, degree)
            if all(a.recall >= RECALL for a in audits):
                return degree, edges, audits
            if turn < rounds - 1:
                graph = stage(top_edges(graph.unionAll(first_graph(unit, k, turn + 1)), k), "graph")
        before = n
    raise RuntimeError(f"NN-descent found too few of the true links: recall {min(a.recall for a in audits):.3f} after {rounds} rounds")


def gathered(unit: DataFrame, links: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links per vector and edges that connect the same vectors, with the classes of saturated vectors enlarged."""
    classes = stage(components(links, "src", "dst"), "classes")
    dense = classes.join(saturated(links), "id", "left_semi").select("root").distinct()
    members = stage(classes.join(dense, "root", "left_semi").select("id", "root"), "members")
    counts, spanning = enlarged_links(unit, members, threshold)
    copies = unit.select(F.col("id").alias("dst"), "copies")
    sparse = links.join(members.select(F.col("id").alias("src")), "src", "left_anti").join(copies, "dst")
    # a member's links with vectors of no enlarged class do not exist: they would be in its class
    degree = sparse.groupBy("src").agg(F.sum("copies").alias("n")).select(F.col("src").alias("id"), "n").unionAll(counts)
    return stage(degree, "degree"), links.unionAll(spanning)


def block_pairs(blocks: DataFrame, threshold: float) -> DataFrame:
    """Pairs of blocks (root, part, to_root, to_part), each once and with itself, that may hold a link.

    A block lies within an angle of its centre. If two centres are further apart
    than both angles and the threshold's together, no vectors of theirs link.
    """

    def centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (label, wide, root, part), found in groups(batches, ["label", "size", "root", "part"]):
            x = matrix(pa.Table.from_batches(found).column("v"))
            mean = x.mean(axis=0)
            centre = mean / norm if (norm := np.sqrt(mean @ mean)) > 1e-6 else x[0]
            radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
            yield pa.RecordBatch.from_arrays(
                [pa.array([label], kind_of), pa.array([wide], pa.int32()), pa.array([root]), pa.array([part], pa.int32()), pa.array([centre.tolist()]), pa.array([radius])],
                ["label", "size", "root", "part", "v", "radius"],
            )

    kind = dict(blocks.dtypes)["label"]
    kind_of = to_arrow_type(blocks.schema["label"].dataType)
    keys = ["label", "size", "root", "part"]
    dealt = blocks.select(*keys, "v").repartition(*keys).sortWithinPartitions(*keys)
    found = stage(dealt.mapInArrow(centres, f"label {kind}, size int, root long, part int, v array<double>, radius double"), "centres")
    tiles = found.groupBy("label", "size").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tiled = found.join(tiles, ["label", "size"]).withColumn("tile", F.pmod(F.xxhash64("root", "part"), F.col("tiles")).cast("int"))
    to = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(o, "tile").alias("a"), F.greatest(o, "tile").alias("b")))
    tiled = tiled.withColumn("to", F.explode(to)).select("label", "size", "to.a", "to.b", "tile", "root", "part", "v", "radius")
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, a, b), found in groups(batches, ["label", "size", "a", "b"]):
            table = pa.Table.from_batches(found)
            c, radius, tile = matrix(table.column("v")), table.column("radius").to_numpy(), table.column("tile").to_numpy()
            may = np.triu(np.arccos(np.clip(c @ c.T, -1, 1)) <= radius[:, None] + radius[None, :] + reach)
            if a != b:
                may &= tile[:, None] != tile[None, :]
            else:
                np.fill_diagonal(may, True)
            i, j = np.nonzero(may)
            root, part = table.column("root").to_numpy(), table.column("part").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(root[i]), pa.array(part[i]), pa.array(root[j]), pa.array(part[j])], ["root", "part", "to_root", "to_part"])

    keys = ["label", "size", "a", "b"]
    dealt = tiled.repartition(*keys).sortWithinPartitions(*keys)
    return stage(dealt.mapInArrow(meet, "root long, part int, to_root long, to_part int"), "pairs")


def enlarged_links(unit: DataFrame, classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links of all members of the given classes (id, root) among each other, in blocks.

    Returns the number of links per vector and a few links that connect the same
    vectors. A class is cut into blocks; each pair of blocks of a label, of one
    class or of two, that may hold a link is compared in one group, so no task
    holds more than two blocks.
    """
    with_workers(unit)
    sizes = classes.groupBy("root").count()
    parts = sizes.select("root", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    rows = classes.join(parts, "root").join(unit.select("id", "label", "size", "v", "copies"), "id")
    rows = stage(rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts"), "blocks")
    pairs = block_pairs(rows, threshold)
    keys = ["a", "ap", "b", "bp"]
    named = pairs.select(F.col("root").alias("a"), F.col("part").alias("ap"), F.col("to_root").alias("b"), F.col("to_part").alias("bp"))
    asked = named.select(*keys, F.lit(0).alias("side"), F.col("a").alias("root"), F.col("ap").alias("part")).unionAll(
        named.where("a != b or ap != bp").select(*keys, F.lit(1).alias("side"), F.col("b").alias("root"), F.col("bp").alias("part"))
    )
    dealt = rows.select("root", "part", "id", "v", "copies").join(asked, ["root", "part"]).select(*keys, "side", "id", "v", "copies")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (a, ap, b, bp), found in groups(batches, keys):
            table = pa.Table.from_batches(found)
            ids, side, x = table.column("id").to_numpy(), table.column("side").to_numpy(), matrix(table.column("v"))
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            if (a, ap) != (b, bp):
                near &= side[:, None] != side[None, :]
            n = near @ table.column("copies").to_numpy()
            has = np.flatnonzero(n)
            if len(has):
                links = _forest(near)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[has]), pa.array(n[has].astype(np.int64)), pa.array([None] * len(has), pa.int64())], ["id", "n", "other"]
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[[i for i, _ in links]]), pa.array(np.zeros(len(links), np.int64)), pa.array(ids[[j for _, j in links]])], ["id", "n", "other"]
                )

    compared = stage(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "id long, n long, other long"), "enlarged")
    counts = compared.where("other is null").groupBy("id").agg(F.sum("n").alias("n"))
    return counts, compared.where("other is not null").select(F.col("id").alias("src"), F.col("other").alias("dst"))


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of a symmetric boolean matrix."""
    seen = np.zeros(len(near), bool)
    links = []
    for start in range(len(near)):
        if seen[start]:
            continue
        seen[start] = True
        open_rows = [start]
        while open_rows:
            row = open_rows.pop()
            new = np.flatnonzero(near[row] & ~seen)
            seen[new] = True
            links.extend((row, int(i)) for i in new)
            open_rows.extend(new.tolist())
    return links


def sampled(unit: DataFrame, sizes: dict[int, int], queries: int) -> pa.Table:
    """About `queries` vectors of each size of label (bits), chosen by a hash."""
    unit = unit.where(F.col("bits").isin(list(sizes)))
    share = F.element_at(F.create_map(*[F.lit(x) for b, n in sizes.items() for x in (b, min(1.0, 2 * queries / n))]), F.col("bits"))
    some = unit.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30) < share)
    order = Window.partitionBy("bits").orderBy(F.xxhash64("id"), "id")
    some = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= queries)
    return some.select("id", F.col("label").cast("string").alias("label"), "bits", "v").toArrow()


def true_links(unit: DataFrame, threshold: float) -> DataFrame:
    """bits, src, n: the links that sampled vectors have by brute force in their label, in one pass.

    A size of label of whose sample no vector has a link is sampled once more in larger number.
    """
    spark = with_workers(unit)

    def scanned(sample: pa.Table) -> DataFrame:
        held = spark.sparkContext.broadcast(
            (sample.column("id").to_numpy(), np.array(sample.column("label").to_pylist(), object), sample.column("bits").to_numpy(), sample.column("v").to_pylist())
        )

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, labels, bits, vectors = held.value
            by: dict[tuple, list[int]] = {}
            for i, (label, v) in enumerate(zip(labels, vectors)):
                by.setdefault((label, len(v)), []).append(i)
            asked = {key: matrix(pa.array([vectors[i] for i in at], pa.list_(pa.float64()))) for key, at in by.items()}
            n = np.zeros(len(ids), np.int64)
            for batch in batches:
                mine = np.array(batch.column("label").to_pylist(), object)
                wide = batch.column("v").value_lengths().to_numpy()
                for (label, width), at in by.items():
                    rows = np.flatnonzero((mine == label) & (wide == width))
                    if len(rows):
                        x = matrix(batch.column("v").take(pa.array(rows)))
                        near = asked[label, width] @ x.T >= threshold
                        near &= ids[at][:, None] != batch.column("id").to_numpy()[rows][None, :]
                        n[at] += near @ batch.column("copies").to_numpy()[rows]
            has = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(bits[has], pa.int32()), pa.array(ids[has]), pa.array(n[has])], ["bits", "src", "n"])

        rows = unit.select("id", F.col("label").cast("string").alias("label"), "v", "copies")
        found = rows.mapInArrow(scan, "bits int, src long, n long")
        return stage(found.groupBy("bits", "src").agg(F.sum("n").alias("n")), "audit")

    sizes = {r["bits"]: r["count"] for r in unit.groupBy("bits").count().collect()}
    truth = scanned(sampled(unit, sizes, AUDIT_QUERIES))
    met = {r["bits"] for r in truth.select("bits").distinct().collect()}
    if bare := {b: n for b, n in sizes.items() if b not in met and n > AUDIT_QUERIES}:
        truth = truth.unionAll(scanned(sampled(unit, bare, MORE_QUERIES)))
    return truth


def audit(truth: DataFrame, degree: DataFrame) -> list[Audit]:
    """The share of their true links that the sampled vectors have, for each size of label.

    Every link has been computed, so a vector has no links but true ones.
    """
    met = truth.join(degree.select(F.col("id").alias("src"), F.col("n").alias("got")), "src", "left")
    share = F.least(F.lit(1.0), F.coalesce("got", F.lit(0)) / F.col("n"))
    return [Audit(r["expected"], r["found"]) for r in met.groupBy("bits").agg(F.count("*").alias("expected"), F.sum(share).alias("found")).collect()]


def near_vectors(
    vectors: DataFrame, threshold: float = 0.98, ident: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """ident, n_links, component_id, kept for every row of `vectors`.

    Vectors of one label link at a cosine of `threshold` or more, in double
    precision. A vector or label that is null, a zero vector and one with null
    or non-finite components link with nothing. Vectors of different width never
    link. Equal vectors are compared once and counted as often as they occur.
    Ids are taken to be unique; rows of one id link with each other like any
    two vectors and share its result. A null id links with nothing. Lists hold
    NEIGHBOURS vectors; where all of a list is above the threshold, the whole
    class is compared in blocks with all that its label holds of such classes,
    so no link is lost to the length of a list. Labels of up to WHOLE different
    vectors are compared whole.
    """
    with_workers(vectors)
    rows = stage(comparable(vectors, ident, embedding, label), "vectors")
    unit = stage(rows.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "unit")
    unit = stage(sized(unit), "sized")
    small, large = unit.where(F.col("total") <= WHOLE), unit.where(F.col("total") > WHOLE)
    degree, edges = enlarged_links(small, small.select("id", F.col("least").alias("root")), threshold)
    if large.limit(1).count():
        more, others, _ = descend(large, threshold)
        degree, edges = degree.unionAll(more), edges.unionAll(others)
    classes = components(edges, "src", "dst")
    one = (
        unit.select("id", "copies").join(degree, "id", "left").join(classes, "id", "left")
        .select(F.col("id").alias("first"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "id").alias("root"))
    )
    # rows that are equal to another one take its result
    twins = unit.where("copies > 1").select("label", "v", F.col("id").alias("twin"))
    named = rows.join(twins, ["label", "v"], "left").select("id", F.coalesce("twin", "id").alias("first"))
    found = named.join(one, "first").select(F.col("id").alias("_id"), F.col("n").alias("_n"), F.col("root").alias("_root")).distinct()
    asked = vectors.select(F.col(ident).cast("long").alias("_asked"))
    root = F.coalesce("_root", "_asked")
    return asked.join(found, F.col("_asked") == F.col("_id"), "left").select(
        F.col("_asked").alias(ident), F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"),
        root.alias("component_id"), (root == F.col("_asked")).alias("kept"),
    )
