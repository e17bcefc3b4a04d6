"""Filter interaction audit over masks of failing filters, with exact duplicates found by radix tries.

Every document gets a mask: one bit per text filter that it fails, and one if a
smaller id holds an identical text anywhere in the table. All effects of any
order of the filters follow from the counts of the masks.

Duplicates: each task inserts whole texts into compressed tries whose terminals
hold the smallest id. A document that meets a smaller id there is a duplicate
for certain and leaves without its text; what is left, one row per distinct text
of the task, is dealt out by an adaptive prefix: as long a prefix of the text as
it takes until few enough bytes share it. Tries of each prefix then settle the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from shoal.llm.common import with_workers
from shoal.session import stage

UPPER = bytes(range(ord("A"), ord("Z") + 1))
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#$%&*|"

# A filter: whether a text (UTF-8), given with its words, fails.
TextFilter = Callable[[bytes, list[bytes]], bool]


def short(body: bytes, words: list[bytes]) -> bool:
    return len(words) < 200


def repetitive(body: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < 50 * len(words)


def shouting(body: bytes, words: list[bytes]) -> bool:
    upper = len(body) - len(body.translate(None, UPPER))
    return 100 * upper > 3 * len(body.translate(None, CONTINUATION))


def symbols(body: bytes, words: list[bytes]) -> bool:
    return len(body.translate(None, SYMBOLS)) < len(body)


#: Letters of the text filters; DUPLICATE is the letter of the table-wide one.
FILTERS: dict[str, TextFilter] = {"A": short, "B": repetitive, "C": shouting, "D": symbols}
DUPLICATE = "E"

# Bytes of text that the tries of a task hold before they are emptied.
HELD_BYTES = 32 << 20
# Lengths of prefixes: 16 bytes, four times as long at each level, until the whole text is covered.
FIRST_PREFIX, LEVELS = 16, 14
# Rows of a batch that leaves a task, and bytes of text in it.
ROWS_OUT, BYTES_OUT = 4096, 8 << 20


class Node:
    """An edge label and what lies below it; `held` is [least id, counts by payload] of a text that ends here."""

    __slots__ = ("label", "children", "held")

    def __init__(self, label: bytes) -> None:
        self.label, self.children, self.held = label, {}, None


def shared_length(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two texts."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """A compressed trie of texts with the smallest id at each terminal."""

    def __init__(self) -> None:
        self.root, self.bytes = Node(b""), 0

    def terminal(self, text: bytes) -> Node:
        node, at, n = self.root, 0, len(text)
        while at < n:
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.bytes += n - at + 300  # the text that is new, and a node
                return child
            label = child.label
            if not text.startswith(label, at):
                k = shared_length(label, text[at : at + len(label)])
                fork = node.children[text[at]] = Node(label[:k])
                child.label = label[k:]
                fork.children[child.label[0]] = child
                child = fork
                self.bytes += 300
            node, at = child, at + len(child.label)
        return node

    def insert(self, text: bytes, ident, payload: tuple, n: int) -> list[tuple]:
        """Put in n rows of a text; returns rows (id, payload, n) that a smaller id rules out.

        A null id is larger than all others and no smaller than itself.
        """
        node = self.terminal(text)
        held = node.held
        if held is None or _before(ident, held[0]):
            node.held = [ident, {payload: n}]
            return [] if held is None else [(held[0], p, c) for p, c in held[1].items()]
        if ident == held[0]:
            held[1][payload] = held[1].get(payload, 0) + n
            return []
        return [(ident, payload, n)]

    def terminals(self) -> Iterator[tuple[bytes, object, dict]]:
        """(text, least id, its counts by payload) in the texts' order."""
        pending = [(self.root, b"")]
        while pending:
            node, before = pending.pop()
            text = before + node.label
            if node.held is not None:
                yield text, *node.held
            pending.extend((node.children[c], text) for c in sorted(node.children, reverse=True))


def _before(a, b) -> bool:
    return a is not None and (b is None or a < b)


class _Out:
    """Rows gathered into batches."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: tuple, size: int = 0) -> None:
        self.rows.append(row)
        self.bytes += size

    def full(self) -> bool:
        return len(self.rows) >= ROWS_OUT or self.bytes >= BYTES_OUT

    def batch(self) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)]
        self.rows, self.bytes = [], 0
        return pa.RecordBatch.from_arrays(columns, schema=self.schema)


def _screen(tests: list[TextFilter], duplicate: int, schema: pa.Schema):
    """Masks of a task's documents; its certain duplicates, and one row per distinct text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = Trie(), _Out(schema)

        def emptied() -> Iterator[pa.RecordBatch]:
            for text, ident, counts in trie.terminals():
                for (part, mask), n in counts.items():
                    out.add((ident, part, mask, n, text), len(text))
                if out.full():
                    yield out.batch()

        for batch in batches:
            for ident, part, body in zip(*(batch.column(c).to_pylist() for c in ("ident", "part", "body"))):
                words = body.split()  # of bytes: at ASCII white space only
                mask = sum(1 << k for k, test in enumerate(tests) if test(body, words))
                for loser, payload, n in trie.insert(body, ident, (part, mask), 1):
                    out.add((loser, payload[0], payload[1] | duplicate, n, None))
                if trie.bytes > HELD_BYTES:
                    yield from emptied()
                    trie = Trie()
                if out.full():
                    yield out.batch()
        yield from emptied()
        if out.rows:
            yield out.batch()

    return run


def _settle(duplicate: int, schema: pa.Schema):
    """Tries of each prefix of a partition that is sorted by prefix: final masks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out, current = Trie(), _Out(schema), None

        def emptied() -> Iterator[pa.RecordBatch]:
            for _, ident, counts in trie.terminals():
                for (part, mask), n in counts.items():
                    out.add((ident, part, mask, n))
                if out.full():
                    yield out.batch()

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("ident", "part", "mask", "n", "body", "head", "prefix"))
            for ident, part, mask, n, body, *prefix in zip(*columns):
                if prefix != current:
                    yield from emptied()
                    trie, current = Trie(), prefix
                for loser, payload, count in trie.insert(body, ident, (part, mask), n):
                    out.add((loser, payload[0], payload[1] | duplicate, count))
                if out.full():
                    yield out.batch()
        yield from emptied()
        if out.rows:
            yield out.batch()

    return run


def with_prefix_hashes(rows: DataFrame, body: str = "body") -> DataFrame:
    """Add the hashes of a text's prefixes, the last of which covers it whole, and its bytes."""
    lengths = F.array(*[F.lit(FIRST_PREFIX << 2 * k) for k in range(LEVELS)])
    size = F.octet_length(body)
    needed = F.filter(lengths, lambda n: (n == FIRST_PREFIX) | (F.shiftright(n, 2) < size))
    hashes = F.transform(needed, lambda n: F.xxhash64(F.substring(F.col(body), F.lit(1), n)))
    return rows.withColumns({"hashes": F.when(F.col(body).isNotNull(), hashes), "bytes": size.cast("long")})


def with_adaptive_prefix(kept: DataFrame, body: str = "body") -> DataFrame:
    """Replace the hashes by (head, prefix): as long a prefix as it takes to part the bytes evenly.

    `kept` is a written table with the columns of `with_prefix_hashes`. Level by
    level, prefixes that hold more bytes than a quarter of a partition's share are
    lengthened; there are at most 4 x partitions of them a level, which bounds
    what is broadcast. A text that is covered whole is not split further; its rows
    are one per distinct text and task, however many copies there are.
    """
    partitions = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max((kept.agg(F.sum("bytes")).first()[0] or 0) // (4 * partitions), 1)
    dealt = kept.withColumn("depth", F.lit(0))
    crowded = kept.select("hashes", "bytes")
    for level in range(LEVELS - 1):
        here, longer = F.get("hashes", F.lit(level)), F.size("hashes") > level + 1
        weights = crowded.groupBy(here.alias("heavy")).agg(F.sum("bytes").alias("weight"), F.max(longer).alias("longer"))
        heavy = stage(weights.where((F.col("weight") > share) & F.col("longer")).select("heavy"), "heavy")
        if heavy.isEmpty():
            break
        # hashes only, written down so that a level reads no more than what is still crowded
        crowded = stage(crowded.where(longer).join(F.broadcast(heavy), here == F.col("heavy"), "left_semi"), "crowded")
        dealt = dealt.join(F.broadcast(heavy), (here == F.col("heavy")) & longer, "left")
        dealt = dealt.withColumn("depth", F.when(F.col("heavy").isNotNull(), level + 1).otherwise(F.col("depth"))).drop("heavy")
    others = [c for c in kept.columns if c not in ("hashes", "bytes")]
    head = F.substring(F.col(body), 1, FIRST_PREFIX)
    return dealt.select(*others, head.alias("head"), F.element_at("hashes", F.col("depth") + 1).alias("prefix"))


def masks(
    docs: DataFrame, tests: list[TextFilter], part: Column, ident: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows (ident, part, mask, n): bit k for tests[k], the next bit for a smaller id with an identical text."""
    with_workers(docs)
    duplicate = 1 << len(tests)
    kind = docs.schema[ident].dataType
    rows = docs.select(F.col(ident).alias("ident"), part.alias("part"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    settled = T.StructType([T.StructField("ident", kind), *T.StructType.fromDDL("part string, mask int, n long")])
    screened = T.StructType([*settled, T.StructField("body", T.BinaryType())])
    arrow = pa.schema([("ident", to_arrow_type(kind)), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())])
    run = _screen(tests, duplicate, arrow.append(pa.field("body", pa.binary())))
    first = stage(with_prefix_hashes(rows.mapInArrow(run, screened)), "screened")
    dealt = with_adaptive_prefix(first.where("body IS NOT NULL"))
    dealt = dealt.repartitionByRange("head", "prefix").sortWithinPartitions("head", "prefix")
    last = dealt.mapInArrow(_settle(duplicate, arrow), settled)
    return last.unionByName(first.where("body IS NULL").drop("body", "hashes", "bytes"))


def orders(letters: str) -> Column:
    """All orders of the filters as an array of (filter_order, step, bit of its filter, bits of those before)."""
    steps = []
    for order in permutations(letters):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            steps.append(F.struct(
                F.lit("".join(order)).alias("filter_order"), F.lit(step).alias("step"), F.lit(bit).alias("own"), F.lit(before).alias("before")
            ))
            before |= bit
    return F.array(*steps)


def audit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    part: str = "lang",
    ident: str = "doc_id",
    text: str = "text",
    filters: dict[str, TextFilter] | None = None,
) -> DataFrame:
    """Effects of each filter in every order of them, by part: one row per part, filter_order and step.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley as
    counts of documents; shapley is a filter's removed, summed over all orders.
    A null text is the empty text, empty texts are identical; a null part is the
    empty string. Rows are documents: repeated ones count each, and ties of an id
    are no smaller than each other; a null id is larger than all others. A document
    is good (toxic) if any row of `labels` says so. An empty table gives no rows;
    other columns are not read. A very long text is one row of one task.
    """
    filters = FILTERS if filters is None else filters
    letters = "".join(filters) + DUPLICATE
    marked = masks(docs, list(filters.values()), F.coalesce(F.col(part).cast("string"), F.lit("")), ident, text)
    said = labels.where(F.col(ident).isNotNull()).groupBy(F.col(ident).alias("ident")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad")
    )
    marked = marked.groupBy("ident", "part", "mask").agg(F.sum("n").alias("n")).join(said, "ident", "left")
    counts = marked.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("bad", F.lit(0))).alias("bad"),
    )
    spread = counts.select("*", F.inline(orders(letters)))
    fails, earlier = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0

    def total(condition: Column, of: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(of)).otherwise(0)).cast("long")

    effects = spread.groupBy("part", "filter_order", "step", "own").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"), total(fails & ~earlier, "good").alias("good_lost"),
        total(fails & ~earlier, "bad").alias("toxic_lost"),
    )
    return effects.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")
