"""Benchmark decontamination by latent semantic retrieval.

Benchmark passages and windows of documents are TF-IDF vectors over the
passages' terms, projected to the leading singular directions. A randomised SVD
finds those: tasks multiply all their windows with a thin random matrix and the
sums are orthogonalised. Windows close to a passage by cosine are candidates; the
longest common subsequence of words and, for paraphrases, a check of the
passage's answer decide.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from shoal.llm.common import with_workers
from shoal.session import Scratch, stage

# Passages searched in one pass over the documents; more take further passes.
BLOCK_ITEMS = 1024
RANK = 96
POWER_STEPS = 2
# Weight of a passage in the fit against a window of the corpus.
PASSAGE_WEIGHT = 8.0
# Terms in more than this share of the documents weigh nothing, unless a passage would
# lose more than this part of its length by that.
COMMON, LOSS = 0.1, 0.3
# The windows of more documents than this weigh together as those of so many, so
# that passages keep their say in the latent space. All windows take part in its fit.
FIT_DOCS = 2000
# Term occurrences that are multiplied at once.
PART = 1 << 14
# Terms whose sums travel together, and groups of tasks that are added up first.
SLICE, GROUPS = 256, 32
# A window is a candidate at this cosine, if it holds this share of the passage.
MIN_COSINE, MIN_SHARE = 0.25, 0.5
# Share of a passage's words in common order that decides alone, and with its answer.
SURE, LIKELY = 0.8, 0.6
ANSWER_WORDS = 4
SHORTEST = 16
BATCH_WORDS = 150_000
EDGES = re.compile(rb"^[^0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff]+$")
REMEMBERED = 500_000


def plain(word: bytes) -> bytes:
    """A lower-case word without the ASCII punctuation around it."""
    return EDGES.sub(b"", word)


def words_of(text: bytes | None) -> list[bytes]:
    return [w for w in map(plain, (text or b"").lower().split()) if w]


class Numbers(dict):
    """Term number of a word as it stands in a text; 0 for other words, -1 for bare punctuation."""

    def __init__(self, terms: dict[bytes, int]) -> None:
        self.terms = terms

    def __missing__(self, word: bytes) -> int:
        bare = plain(word)
        n = self.terms.get(bare, 0) if bare else -1
        if len(self) < REMEMBERED:
            self[word] = n
        return n

    def __reduce__(self):
        return Numbers, (self.terms,)


@dataclass
class Block:
    """Some passages and what the search for them needs."""

    idents: list
    items: list[list[int]]  # term numbers, from 1; 0 is any other word
    terms: dict[bytes, int]
    latent: np.ndarray = field(default=None)  # one row per term, row 0 is zero
    own: np.ndarray = field(default=None)  # latent vector of each passage
    heavy: np.ndarray = field(default=None)  # whether a term has a weight

    def __post_init__(self) -> None:
        self.known = Numbers(self.terms)

    def numbers(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        out = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return out[out >= 0]

    def scales(self) -> dict[int, list[int]]:
        """Passages by the power of two that holds them."""
        by: dict[int, list[int]] = defaultdict(list)
        for i, item in enumerate(self.items):
            by[max(SHORTEST, 1 << (len(item) - 1).bit_length())].append(i)
        return by


def blocks_of(benchmark: DataFrame, ident: str, text: str) -> Iterator[Block]:
    """Passages in blocks of a fixed size, by id; those without a word are left out."""
    rows = benchmark.select(F.col(ident).alias("i"), F.col(text).cast("binary").alias("t")).orderBy("i", "t")
    idents, bodies = [], []

    def block() -> Block:
        terms: dict[bytes, int] = {}
        items = [[terms.setdefault(w, len(terms) + 1) for w in body] for body in bodies]
        return Block(list(idents), items, terms)

    for row in rows.toLocalIterator():
        body = words_of(row["t"])
        if body:
            idents.append(row["i"])
            bodies.append(body)
        if len(idents) == BLOCK_ITEMS:
            yield block()
            idents, bodies = [], []
    if idents:
        yield block()


def numbered(docs: DataFrame, block: Block, ident: str, text: str) -> DataFrame:
    """ident and the term numbers of its text's words as little-endian unsigned 32-bit integers."""
    texts = docs.select(F.col(ident).cast("long").alias("ident"), F.col(text).cast("binary").alias("text"))
    shared = texts.sparkSession.sparkContext.broadcast(block)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for whole in batches:
            for begin in range(0, whole.num_rows, 1024):
                batch = whole.slice(begin, 1024)
                ids = [b.numbers(t).astype("<u4").tobytes() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("ident"), pa.array(ids, pa.binary())], ["ident", "ids"])

    return texts.mapInArrow(number, "ident long, ids binary")


def term_weights(coded: DataFrame, block: Block) -> np.ndarray:
    """Inverse document frequency of the block's terms over all documents; entry 0 is 0."""
    terms = len(block.terms) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, seen = 0, np.zeros(terms, np.int64)
        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                seen[np.frombuffer(ids, "<u4")] += 1  # once, however often a term occurs
                rows += 1
        seen[0] = rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(seen))), pa.array(seen)], ["term", "n"])

    sums = coded.select("ids").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    n = np.zeros(terms)
    got = sums.orderBy("term").toArrow()  # one row per term of the block
    n[got.column("term").to_numpy()] = got.column("n").to_numpy()
    weights = np.log((n[0] + 1) / (n + 1)) + 0.1
    weights[0] = 0.0
    rare = np.where(n > COMMON * n[0], 0.0, weights)
    for item in block.items:
        if np.linalg.norm(rare[item]) < (1 - LOSS) * np.linalg.norm(weights[item]):
            rare[item] = weights[item]
    return rare


def row_product(bags: list[np.ndarray], size: int, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Sum over rows a of a (a . basis); a row is `size` term numbers of a bag, scaled to length one."""
    out = np.zeros_like(basis)
    if not bags:
        return out
    per = np.array([-(-len(bag) // size) for bag in bags])
    ids = np.concatenate(bags)
    lengths = np.array([len(bag) for bag in bags])
    within = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row = np.repeat(np.cumsum(per) - per, lengths) + within // size
    value = weights[ids]
    heavy = np.flatnonzero(value > 0)
    ids, row, value = ids[heavy], row[heavy], value[heavy]
    norms = np.sqrt(np.bincount(row, weights=value * value))
    value = (value / norms[row]).astype(basis.dtype)[:, None]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    cuts = np.searchsorted(starts, np.arange(0, len(ids), PART))  # parts of whole rows
    cuts = np.append(starts[np.unique(cuts[cuts < len(starts)])], len(ids))
    for lo, hi in zip(cuts, cuts[1:]):
        some, scale = ids[lo:hi], value[lo:hi]
        begins = np.flatnonzero(np.r_[True, row[lo + 1 : hi] != row[lo : hi - 1]])
        held = np.diff(np.append(begins, hi - lo))
        longest = np.argsort(-held, kind="stable")  # rows with more terms first, then term by term
        begins, held = begins[longest], held[longest]
        dots = np.zeros((len(begins), basis.shape[1]), basis.dtype)
        term = np.empty_like(dots)
        for at in range(int(held[0])):
            m = int(np.searchsorted(-held, -at, side="left"))
            place = begins[:m] + at
            np.take(basis, some[place], axis=0, out=term[:m], mode="clip")
            term[:m] *= scale[place]
            dots[:m] += term[:m]
        of = np.empty(hi - lo, np.int64)
        of[np.arange(hi - lo) - np.repeat(np.cumsum(held) - held, held) + np.repeat(begins, held)] = np.repeat(np.arange(len(held)), held)
        order = np.argsort(some, kind="stable")
        by = some[order]
        runs = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
        back = np.take(dots, of[order], axis=0)
        back *= scale[order]
        out[by[runs]] += np.add.reduceat(back, runs, axis=0)
    return out


def latent_space(coded: DataFrame, block: Block, weights: np.ndarray, seed: int = 17) -> np.ndarray:
    """Leading right singular vectors of the TF-IDF rows of all windows and passages, one row per term."""
    context = coded.sparkSession.sparkContext
    terms = len(block.terms) + 1
    wide = min(RANK + 16, terms)
    share = min(1.0, FIT_DOCS / max(1, coded.count()))
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, wide)))[0]
    items = [np.array(item) for item in block.items]

    def add(key, table):
        table = table.sort_by("task")  # so that reruns agree
        total = sum(np.frombuffer(raw) for raw in table.column("sum").to_pylist())
        return pa.table({"at": table.column("at")[:1], "task": table.column("task")[:1], "sum": pa.array([total.tobytes()], pa.binary())})

    for _ in range(POWER_STEPS):
        sent = context.broadcast((weights, basis.astype(np.float32)))

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, basis = sent.value
            out = np.zeros(basis.shape)
            for batch in batches:
                for begin in range(0, batch.num_rows, 1024):
                    bags = [np.frombuffer(ids, "<u4") for ids in batch.column("ids").slice(begin, 1024).to_pylist()]
                    out += row_product(bags, 2 * SHORTEST, weights, basis)
            task = TaskContext.get().partitionId()
            for at in range(0, len(out), SLICE):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at]), pa.array([task]), pa.array([task % GROUPS]), pa.array([out[at : at + SLICE].tobytes()], pa.binary())],
                    ["at", "task", "part", "sum"],
                )

        kind = "at long, task long, sum binary"
        sums = coded.select("ids").mapInArrow(multiply, "at long, task long, part long, sum binary")
        sums = sums.groupBy("at", "part").applyInArrow(add, kind).groupBy("at").applyInArrow(add, kind)
        image = PASSAGE_WEIGHT**2 * row_product(items, max(map(len, items)), weights, basis)
        for row in sums.toLocalIterator():  # one row per SLICE terms of the block
            image[row["at"] : row["at"] + SLICE] += share * np.frombuffer(row["sum"]).reshape(-1, wide)
        sent.unpersist()
        basis, _ = np.linalg.qr(image)
    small = np.linalg.svd(image.T @ basis)[0] if wide else np.zeros((0, 0))
    return (basis @ small)[:, :RANK]


def fit(coded: DataFrame, block: Block) -> Block:
    """Fill in the latent vectors of the block's terms and passages from all numbered texts."""
    weights = term_weights(coded, block)
    block.latent = (latent_space(coded, block, weights) * weights[:, None]).astype(np.float32)
    block.heavy = weights > 0
    block.own = np.stack([block.latent[item].sum(axis=0) for item in block.items])
    return block


def prepare(docs: DataFrame, block: Block, text: str = "text") -> Block:
    """`fit` to documents whose numbers nothing else needs."""
    with Scratch(docs.sparkSession):
        texts = docs.select(F.lit(0).alias("ident"), F.col(text).alias("text"))
        return fit(stage(numbered(texts, block, "ident", "text"), "numbers"), block)


def common_length(item: list[int], window: list[int]) -> int:
    """Length of the longest common subsequence, one machine-word operation per window word."""
    places: dict[int, int] = defaultdict(int)
    for i, term in enumerate(item):
        places[term] |= 1 << i
    full = (1 << len(item)) - 1
    row = full
    for term in window:
        hit = places.get(term, 0) if term else 0
        if hit:
            both = row & hit
            row = (row + both | row - both) & full
    return len(item) - row.bit_count()


def _answered(item: list[int], window: list[int]) -> bool:
    """Whether the passage's last words stand in the window as they are."""
    answer = item[-ANSWER_WORDS:]
    return any(window[i : i + len(answer)] == answer for i in range(len(window) - len(answer) + 1))


def judge(item: list[int], window: list[int]) -> tuple[int, bool] | None:
    """(common words, answer there) if the window leaks the passage."""
    n = common_length(item, window)
    if n < LIKELY * len(item) or n < 3:
        return None
    answer = _answered(item, window)
    return (n, answer) if n >= SURE * len(item) or answer else None


def search(numbers: list[np.ndarray], block: Block) -> Iterator[tuple[int, int, int, bool, int, int]]:
    """(row, passage, common words, answer, first and last word) of each leak, the best per row and passage."""
    scales = block.scales()
    begin = 0
    while begin < len(numbers):
        end, words = begin, 0
        while end < len(numbers) and (end == begin or words + len(numbers[end]) <= BATCH_WORDS):
            words += len(numbers[end])
            end += 1
        best: dict[tuple[int, int], tuple] = {}
        part = numbers[begin:end]
        longest = max(scales, default=SHORTEST)
        rows, first, sums = _step_sums(part, block, longest)
        for size in sorted(scales):
            items = scales[size]
            for row, item, at in _candidates(rows, first, sums, block, size, items):
                ids = numbers[begin + row]
                lo, hi = max(0, at * size // 2), min(len(ids), at * size // 2 + size + size // 2)
                leak = judge(block.items[item], ids[lo:hi].tolist())
                if leak and leak > best.get((row, item), ((0, False),))[0]:
                    best[row, item] = (leak, lo, hi)
        for (row, item), ((n, answer), lo, hi) in sorted(best.items()):
            yield begin + row, item, n, answer, lo, hi
        begin = end


FINEST = SHORTEST // 2


def _step_sums(numbers: list[np.ndarray], block: Block, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text of each step, first step of each text, and the sum of latent vectors per step of FINEST words.

    Every text fills a whole number of the longest steps, so that coarser steps
    are sums of finer ones and never cross a text.
    """
    coarse = longest // 2
    counts = np.array([max(1, -(-len(n) // coarse)) * (coarse // FINEST) for n in numbers])
    padded = np.zeros(int(counts.sum()) * FINEST, np.int64)
    first = np.cumsum(counts) - counts
    for n, f in zip(numbers, first):
        padded[f * FINEST : f * FINEST + len(n)] = n
    sums = np.zeros((int(counts.sum()), block.latent.shape[1]), np.float32)
    hit = np.flatnonzero(block.heavy[padded])
    for lo in range(0, len(hit), BATCH_WORDS):
        some = hit[lo : lo + BATCH_WORDS]
        of = some // FINEST
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        sums[of[starts]] += np.add.reduceat(block.latent[padded[some]], starts, axis=0)
    return np.repeat(np.arange(len(numbers)), counts), first, sums


def _candidates(
    rows: np.ndarray, first: np.ndarray, sums: np.ndarray, block: Block, size: int, items: list[int]
) -> Iterator[tuple[int, int, int]]:
    """(row, passage, step) of windows near a passage: size * 1.5 words, half a size apart."""
    fold = size // 2 // FINEST
    own = block.own[items]
    length = np.linalg.norm(own, axis=1)
    own = own / np.maximum(length, 1e-9)[:, None]
    steps = sums.reshape(-1, fold, sums.shape[1]).sum(axis=1) if fold > 1 else sums
    row_of = rows[::fold]
    for lo in range(0, len(row_of), BATCH_WORDS // 8):
        hi = min(len(row_of), lo + BATCH_WORDS // 8)
        window = steps[lo:hi].copy()
        for ahead in (1, 2):
            near = min(len(row_of), hi + ahead)
            same = (row_of[lo + ahead : near] == row_of[lo : near - ahead])[:, None]
            window[: len(same)] += steps[lo + ahead : near] * same
        dots = window @ own.T
        norm = np.linalg.norm(window, axis=1)
        close = (dots >= MIN_SHARE * length) & (dots >= MIN_COSINE * np.maximum(norm, 1e-9)[:, None])
        for w, i in zip(*np.nonzero(close)):
            row = int(row_of[lo + w])
            yield row, items[int(i)], int(lo + w - first[row] // fold)


KIND = "item_id long, common_words int, item_words int, answered boolean, first_word int, last_word int"


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per document and leaked passage: ident and the columns of KIND.

    A passage leaks if 0.8 of its words stand in a window in order, or 0.6 and
    its last words unbroken. Words are compared in lower case without the
    punctuation around them. Whole texts of all rows are searched for all
    passages. Null and empty texts and passages leak nothing, repeated rows
    give repeated results, equal passages each have their own rows; empty tables
    give no rows; other columns are not read.
    """
    spark = with_workers(docs)
    kind = f"`{ident}` long, {KIND}"
    out = None
    for block in blocks_of(benchmark, item, item_text):
        coded = stage(numbered(docs, block, ident, text), "numbers")
        shared = spark.sparkContext.broadcast(fit(coded, block))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            b = shared.value
            for whole in batches:
                for begin in range(0, whole.num_rows, 1024):
                    batch = whole.slice(begin, 1024)
                    idents = batch.column("ident").to_pylist()
                    numbers = [np.frombuffer(ids, "<u4").astype(np.int64) for ids in batch.column("ids").to_pylist()]
                    found = [(idents[r], b.idents[i], n, len(b.items[i]), answer, lo, hi) for r, i, n, answer, lo, hi in search(numbers, b)]
                    yield _leak_rows(found, ident)

        hits = coded.mapInArrow(scan, kind)
        out = hits if out is None else out.unionAll(hits)
    return out if out is not None else spark.createDataFrame([], kind)


def _leak_rows(found: list[tuple], ident: str) -> pa.RecordBatch:
    names = [ident, "item_id", "common_words", "item_words", "answered", "first_word", "last_word"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs` in which no passage leaks, all columns as they are, without a join."""
    spark = with_workers(docs)
    columns = docs.columns
    for block in blocks_of(benchmark, item, item_text):
        shared = spark.sparkContext.broadcast(prepare(docs, block, text))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for begin in range(0, whole.num_rows, 1024):
                    batch = whole.slice(begin, 1024)
                    texts = batch.column(columns.index(text)).cast(pa.binary()).to_pylist()
                    leaks = {row for row, *_ in search([shared.value.numbers(t) for t in texts], shared.value)}
                    yield batch.filter(pa.array([i not in leaks for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
