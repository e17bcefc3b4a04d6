"""Language-model scores by online logistic context mixing over whole texts.

A text is its lower-cased words and an end mark. A word is coded by the bits of
its place in a Huffman tree of the frequent words; any other word by an escape
and the bits of its bytes and a closing space, or, where the text has spelled it
before, by another escape and a number among the words spelled so far. Six hashed contexts of what came before, also of earlier
words, predict every bit. Their slots hold how often a 0 and a 1 followed in the
training texts; the predictions, stretched to logits, are mixed by weights that
a gate selects, and an adaptive map refines the result. Weights and map are
trained online; while a text is scored, its own offsets to the weights follow
what it has shown so far.

Beside the bits, texts are cut into chunks where the hash of two words says so.
A chunk that other training texts hold, too, may be named as a whole instead of
coded by its bits, and so may one that the text itself has had before, whichever
is likelier for each different chunk. Chunk counts meet by joins, so that this
part grows with the corpus without a bound.

What a training text has taught is taken out where it is scored itself: each bit
leaves its own count, each chunk all its occurrences in the text. Its score is
thus close to that of a text the model has not seen.

Spark's tasks run all this as Java (ContextMix.java, begun by Passes); Stream
and Mixer state it in numpy and are what the tests hold the Java code against.
"""

from __future__ import annotations

import heapq
import math
import tempfile
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shoal.llm.common import with_workers
from shoal.llm.jvm import java_object, map_rows
from shoal.session import stage

# The end of a text as a word: no word holds a line feed.
END = b"\n"
CONTEXTS = 6
# Inputs whose sureness gates the weights.
GATES = (2, 4)
# Words with a code of their own at most, the longest and the rarest of them; the others are spelled.
HOT_WORDS = 1 << 18
HOT_BYTES = 32
LEAST = 8
# The most frequent words, the last of which is a context: it tells language and register.
COMMON = 256
# Slots: a power of two near the training tokens over 8, within these bounds (two bytes a slot).
SLOT_BITS = (18, 24)
SLICE = 1 << 15
# Tasks that count slots at most; each sends its table once.
TABLE_TASKS = 2048
RATE = 0.02
# Step of a text's own offsets, and the bits that slow it down at first.
OWN_RATE, OWN_SLOW = 0.3, 100.0
KNOTS = 24
LIMIT = 8.0
# Tokens that are worked on together; contexts and offsets begin anew after so many tokens of a text.
TOGETHER = 1 << 16
SEGMENT = 1 << 17
# Symbols whose bits are worked on at once: fewer cost more calls, more leave the cache.
PART = 16384
# Symbols after which the weights move while they are trained.
STEP = 4096
# A chunk ends after one in so many pairs of words.
CHUNK = 16

_ONE = np.uint64(1)
_MIX_A, _MIX_B, _MIX_C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def tokens_of(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def mixed_hash(*parts: np.ndarray | int) -> np.ndarray:
    """64-bit hashes of columns of numbers."""
    h = np.zeros(1, np.uint64)
    for part in parts:
        h = (h + np.asarray(part, np.uint64) + _MIX_A) * _MIX_B
        h ^= h >> np.uint64(29)
        h *= _MIX_C
        h ^= h >> np.uint64(32)
    return h


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n_train, n: how often each token occurs in training texts and in all, from (text, held_out)."""
    # tasks have summed up what they read; the sums of a word meet once
    counts = map_rows(texts.select("text", "held_out"), java_object(texts.sparkSession, "ContextMix").begin("words", 0, None, None), "word binary, n_train long, n long")
    return counts.repartition("word").groupBy("word").agg(F.sum("n_train").alias("n_train"), F.sum("n").alias("n"))


def least_count(words: DataFrame, most: int) -> int:
    """Least count `n` such that no more than `most` words have it."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    many = 0
    cut = None
    for row in words.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("level")).collect():
        many += row["words"]
        if many > most:
            break
        cut = row["least"]
    return cut if cut is not None else 1 << 62


class Book:
    """Codes of the frequent words, in descending order of their count; then those of a new and of a repeated other word."""

    def __init__(self, counts: dict[bytes, int], escaped: int) -> None:
        counts = {**counts, END: max(1, counts.get(END, 0))}
        self.words = sorted(counts, key=lambda w: (-counts[w], w))
        self.counts = np.array([counts[w] for w in self.words], np.int64)
        self.codes, self.lengths = huffman([*self.counts.tolist(), max(1, escaped // 2), max(1, escaped // 2)])
        self.index: dict[bytes, int] | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "index": None}  # made again where it is needed

    def places(self, words: list[bytes]) -> np.ndarray:
        if self.index is None:
            self.index = {w: i for i, w in enumerate(self.words)}
        get, other = self.index.get, len(self.words)
        return np.array([get(w, other) for w in words], np.int64)


def huffman(counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Prefix codes and their lengths."""
    heap = [(n, i) for i, n in enumerate(counts)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    top = len(counts)
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i], parent[j] = (top, 0), (top, 1)
        heapq.heappush(heap, (a + b, top))
        top += 1
    codes, lengths = np.zeros(top, np.uint64), np.zeros(top, np.int64)
    for node in range(top - 2, -1, -1):
        above, bit = parent[node]
        codes[node] = int(codes[above]) << 1 | bit
        lengths[node] = lengths[above] + 1
    return codes[: len(counts)], lengths[: len(counts)]


class Stream:
    """The symbols of some segments: codes, lengths and context hashes of words and of spelled bytes.

    `token` is the token that a symbol belongs to, `block` the step in which a
    segment's offsets are the same; blocks double in length.
    """

    def __init__(self, book: Book, segments: list[list[bytes]]) -> None:
        flat = [w for s in segments for w in s]
        sizes = np.array([len(s) for s in segments])
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.segment = np.repeat(np.arange(len(segments)), sizes)
        self.place = book.places(flat)
        n = len(flat)
        within = np.arange(n) - self.starts[self.segment]
        rare = np.flatnonzero(self.place == len(book.words))
        names = self.place.astype(np.uint64) + _ONE
        names[rare] = np.array([zlib.crc32(flat[i]) for i in rare], np.uint64) | np.uint64(1 << 33)
        # later occurrences of a spelled word in a segment are numbers among the words spelled before
        _, first = np.unique(np.stack([self.segment[rare].astype(np.uint64), names[rare]]), axis=1, return_index=True)
        new = np.zeros(n + 1, np.int64)
        new[rare[first] + 1] = 1
        symbol, spelt = self.place + 0, np.cumsum(new)
        again = rare[new[rare + 1] == 0]
        symbol[again] += 1
        self.numbers = np.zeros(n)
        self.numbers[again] = -np.log10(spelt[again] - spelt[self.starts[self.segment[again]]])
        rare = np.sort(rare[first])
        before = []
        for back in (1, 2, 3):
            shifted = np.zeros(n, np.uint64)
            shifted[back:] = names[:-back]
            shifted[within < back] = 0
            before.append(shifted)
        one, two, three = before
        seen = np.maximum.accumulate(np.where(self.place < min(COMMON, len(book.words)), np.arange(n), -1))
        recent = np.concatenate([[-1], seen[:-1]])
        recent = np.where(recent >= self.starts[self.segment], names[recent], 0).astype(np.uint64)
        words = [np.full(n, mixed_hash(1)[0]), mixed_hash(2, recent), mixed_hash(3, one), mixed_hash(4, two), mixed_hash(5, one, two), mixed_hash(6, one, two, three)]

        spelled = np.frombuffer(b"".join([flat[i] + b" " for i in rare]), np.uint8).astype(np.uint64)
        lengths = np.array([len(flat[i]) + 1 for i in rare], np.int64)
        begins = np.concatenate([[0], np.cumsum(lengths)])[: len(rare)].astype(np.int64)
        of = np.repeat(np.arange(len(rare)), lengths)
        at = np.arange(len(spelled)) - begins[of] if len(rare) else np.zeros(0, np.int64)
        last = []
        for back in (1, 2, 3):
            shifted = np.zeros(len(spelled), np.uint64)
            shifted[back:] = spelled[:-back] + _ONE
            shifted[at < back] = 0
            last.append(shifted)
        prefix = running_hash(spelled, begins, of, at)
        previous, common = one[rare][of], recent[rare][of]
        letters = [
            mixed_hash(11, last[0], np.minimum(at, 7)), mixed_hash(12, last[0], last[1]), mixed_hash(13, *last), mixed_hash(14, common, last[0], last[1]),
            mixed_hash(15, prefix), mixed_hash(16, prefix, previous),
        ]
        self.token = np.concatenate([np.arange(n), rare[of]])
        self.spelled = np.arange(len(self.token)) >= n
        self.codes = np.concatenate([book.codes[symbol], spelled])
        self.lengths = np.concatenate([book.lengths[symbol], np.full(len(spelled), 8)])
        self.contexts = np.stack([np.concatenate([a, b]) for a, b in zip(words, letters)])
        self.block = np.maximum(0, np.floor(np.log2(np.maximum(1, within))).astype(np.int64) - 5)[self.token]

        pair = mixed_hash(21, names, one)
        ends = pair % np.uint64(CHUNK) == 0
        ends[self.starts + sizes - 1] = True
        self.chunks = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1])  # first token of each chunk
        sizes = np.diff(np.append(self.chunks, n))
        of = np.repeat(np.arange(len(self.chunks)), sizes)
        powers = np.cumprod(np.full(int(sizes.max()), _MIX_A))
        self.keys = mixed_hash(22, np.add.reduceat(mixed_hash(names) * powers[np.arange(n) - self.chunks[of]], self.chunks), sizes).view(np.int64)

    def blocks(self) -> Iterator[list[np.ndarray]]:
        """Symbols of each block in turn, longer codes first, in parts that stay in a core's cache."""
        order = np.lexsort((-self.lengths, self.block))
        cuts = np.flatnonzero(np.diff(self.block[order])) + 1
        for block in np.split(order, cuts):
            yield np.array_split(block, -(-len(block) // PART))

    def bits(self, some: np.ndarray, shift: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(depth, symbols of `some` that reach it, slots of their contexts, bits); longer codes stand first."""
        codes, lengths, contexts = self.codes[some], self.lengths[some], self.contexts[:, some]
        shorter = -lengths
        for depth in range(int(lengths[0])):
            m = int(np.searchsorted(shorter, -depth, side="left"))
            left = (lengths[:m] - depth).astype(np.uint64)
            node = (codes[:m] >> left) | np.uint64(1 << depth)
            bit = ((codes[:m] >> (left - _ONE)) & _ONE).view(np.int64)
            slots = contexts[:, :m] + node * _MIX_B
            slots *= _MIX_A
            slots >>= np.uint64(shift)
            yield depth, m, slots.view(np.int64), bit


def running_hash(values: np.ndarray, begins: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the values before each one in its run."""
    if not len(values):
        return values
    terms = (values + _ONE) * np.cumprod(np.full(int(at.max()) + 1, _MIX_A))[at]
    sums = np.cumsum(terms) - terms
    return sums - sums[begins][of]


def segments_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[list[list[bytes]], list[tuple]]]:
    """Segments of about TOGETHER tokens at a time, and (row, is its last segment, *columns) of each."""
    segments, about, many, row = [], [], 0, 0
    for batch in batches:
        for body, *values in zip(*[batch.column(c).to_pylist() for c in ("text", *columns)]):
            tokens = tokens_of(body)
            for begin in range(0, len(tokens), SEGMENT):
                part = tokens[begin : begin + SEGMENT]
                segments.append(part)
                about.append((row, begin + SEGMENT >= len(tokens), *values))
                many += len(part)
                if many >= TOGETHER:
                    yield segments, about
                    segments, about, many = [], [], 0
            row += 1
    if segments:
        yield segments, about


class Passes:
    """The passes over all bits as Java code in Spark's tasks: what Stream and Mixer say, without a Python worker."""

    limits = (TOGETHER, SEGMENT, PART, STEP, CHUNK, COMMON, SLICE)

    def __init__(self, spark: SparkSession, book: Book, base: np.ndarray | None = None, seen: np.ndarray | None = None) -> None:
        self.spark = spark
        n = len(book.words) + 1
        base, seen = np.zeros(n) if base is None else base, np.zeros(n, bool) if seen is None else seen
        begins = np.concatenate([[0], np.cumsum([len(w) for w in book.words])]).astype("<i4")
        parts = [np.array([len(book.words)], "<i4"), book.codes.astype("<u8"), book.lengths.astype("<i4"), base.astype("<f8"), begins, seen.astype(np.int8)]
        self.book = self.handed(b"".join([p.tobytes() for p in parts] + book.words), "bookOf")

    def handed(self, content: bytes, kind: str, *more: int):
        """A broadcast of the JVM, made by way of a file: large values are slow through the gateway."""
        with tempfile.NamedTemporaryFile(prefix="shoal-") as file:
            file.write(content)
            file.flush()
            return getattr(java_object(self.spark, "ContextMix"), kind)(self.spark.sparkContext._jsc, file.name, *more)

    def model(self, mixer: Mixer):
        parts = [mixer.slots.astype("<u2"), mixer.weights.astype("<f4"), mixer.map.astype("<f4"), mixer.logits.astype("<f4"), mixer.sure.astype(np.int8)]
        return self.handed(b"".join(p.tobytes() for p in parts), "modelOf", 64 - mixer.shift)

    def run(self, texts: DataFrame, mode: str, bits: int, schema: str, model=None) -> DataFrame:
        task = java_object(self.spark, "ContextMix").begin(mode, bits, self.book, model)
        task = task.limits(*self.limits).rates(RATE, OWN_RATE, OWN_SLOW)
        return map_rows(texts, task, schema)


def count_slots(texts: DataFrame, passes: Passes, bits: int, tokens: int) -> Iterator[tuple[int, np.ndarray]]:
    """(slice, packed counts) of all slots that hold anything, from the training texts."""

    def total(table: pa.Table) -> np.ndarray:
        out: np.ndarray | int = 0
        width = min(2 << bits, SLICE)
        for raw in table.column("counts"):
            raw = raw.as_buffer()
            out = out + np.frombuffer(raw, {2: np.uint16, 4: np.uint32, 8: np.int64}[len(raw) // width]).astype(np.int64)
        return out

    def some(key, table):
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": [total(table).tobytes()]})

    def every(key, table):
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "packed": [pack(total(table)).tobytes()]})

    # a task reads at least about twice the slots it sends, so that tables stay below the input
    tasks = max(8, min(TABLE_TASKS, tokens >> (bits + 1)))
    parts = passes.run(texts.coalesce(tasks), "count", bits, "slice int, part int, counts binary")
    if tasks > 32:
        parts = parts.groupBy("slice", "part").applyInArrow(some, "slice int, counts binary")
    for row in parts.select("slice", "counts").groupBy("slice").applyInArrow(every, "slice int, packed binary").toLocalIterator():
        yield row["slice"], np.frombuffer(row["packed"], np.uint16)


EXACT = 127


def pack(counts: np.ndarray) -> np.ndarray:
    """Counts of 0 and 1 of each slot in a byte each: exact up to EXACT, by eighths of octaves beyond."""
    pairs = counts.reshape(-1, 2).astype(float)
    pairs = pairs * np.minimum(1.0, 2.0**22 / np.maximum(1.0, pairs.max(axis=1)))[:, None]
    levels = np.where(pairs <= EXACT, np.ceil(pairs), EXACT + np.rint(8 * np.log2(np.maximum(1.0, pairs) / EXACT)))
    levels = np.minimum(levels, 255).astype(np.uint16)
    return levels[:, 0] | levels[:, 1] << 8


def unpacked() -> tuple[np.ndarray, np.ndarray]:
    """Logit and sureness (0 to 7) by packed counts: as they are, less a 0, less a 1."""
    level = np.arange(256)
    value = np.where(level <= EXACT, level, EXACT * 2.0 ** ((level - EXACT) / 8))
    less = np.where((level > 0) & (level <= EXACT), value - 1, value)
    logits, sure = [], []
    for zeros, ones in ((value, value), (less, value), (value, less)):
        n0, n1 = np.tile(zeros, 256), np.repeat(ones, 256)
        logits.append(np.clip(np.log((n1 + 0.4) / (n0 + 0.4)), -LIMIT, LIMIT))
        sure.append(np.minimum(7, np.ceil(np.log2(n0 + n1 + 1))))
    return np.concatenate(logits).astype(np.float32), np.concatenate(sure).astype(np.int16)


_ROWS = (np.arange(CONTEXTS, dtype=np.int16) * 1024)[:, None]


class Mixer:
    """Packed slots with the gated weights and the adaptive map that refine them."""

    def __init__(self, slots: np.ndarray) -> None:
        self.slots = slots
        self.shift = 64 - int(math.log2(len(slots)))
        self.weights = np.full((CONTEXTS, 1024), 0.3, np.float32)  # by symbol kind, two gates, sureness
        self.map = np.tile(1 / (1 + np.exp(-np.linspace(-LIMIT, LIMIT, KNOTS + 1))), (64, 1)).astype(np.float32)
        self.logits, self.sure = unpacked()

    def inputs(self, slots: np.ndarray, bit: np.ndarray, taught: np.ndarray, spelled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits and places among all weights (6 x symbols); `taught` bits have their own count taken out."""
        # one type for all rows: casts amid the sums cost more than they do
        packed = np.take(self.slots, slots).astype(np.int64)
        packed += taught * (1 + bit) << 16
        sure = np.take(self.sure, packed)
        gate = spelled.astype(np.int16) * 512 + sure[GATES[0]] * 64 + sure[GATES[1]] * 8
        sure += gate
        sure += _ROWS
        return np.take(self.logits, packed), sure.astype(np.int64)

    def placed(self, logit: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The map's cell and fraction."""
        place = (logit + np.float32(LIMIT)) * np.float32(KNOTS / (2 * LIMIT))
        cell = np.minimum(place.astype(np.int32), KNOTS - 1)
        return cell + row * (KNOTS + 1), place - cell.astype(np.float32)

    def refined(self, logit: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final probability of a 1, and that of the mixer."""
        cell, part = self.placed(logit, row)
        low, high = np.take(self.map, cell), np.take(self.map, cell + 1)
        p = 1 / (1 + np.exp(-logit))
        return np.clip(0.5 * (p + low + (high - low) * part), 1e-5, 1 - 1e-5), p

    def weighed(self, x: np.ndarray, at: np.ndarray, own: np.ndarray | float = 0.0) -> np.ndarray:
        weights = np.take(self.weights, at)
        weights += own
        return np.clip(np.einsum("km,km->m", x, weights), -LIMIT, LIMIT)

    def learn(self, texts: Iterator[Stream]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One online pass over training texts: how often each weight was used, and the map's bits and ones."""
        squares, used = np.ones_like(self.weights), np.zeros(self.weights.size)
        total, ones = np.zeros(self.map.size), np.zeros(self.map.size)
        for stream in texts:
            for block in stream.blocks():
                for part in (p for some in block for p in np.array_split(some, -(-len(some) // STEP))):
                    spelled = stream.spelled[part].astype(np.int64)
                    for depth, m, slots, bit in stream.bits(part, self.shift):
                        x, at = self.inputs(slots, bit, np.ones(m, np.int64), spelled[:m])
                        logit = self.weighed(x, at)
                        cell, fraction = self.placed(logit, spelled[:m] * 32 + min(depth, 31))
                        error, at = bit - 1 / (1 + np.exp(-logit)), at.ravel()
                        step = np.bincount(at, weights=(x * error).ravel(), minlength=used.size).reshape(squares.shape)
                        used += np.bincount(at, minlength=used.size)
                        squares += step * step
                        self.weights += RATE * step / np.sqrt(squares)
                        cell = cell + (fraction > 0.5)
                        total += np.bincount(cell, minlength=self.map.size)
                        ones += np.bincount(cell, weights=bit, minlength=self.map.size)
        return used.reshape(squares.shape), total, ones

    def costs(self, stream: Stream, taught: np.ndarray) -> np.ndarray:
        """log10 of each token's probability; `taught` says of each segment whether it was learned from."""
        out = np.zeros(len(stream.token))
        own = np.zeros((CONTEXTS, len(taught)), np.float32)
        for block in stream.blocks():
            steps, bits = np.zeros(own.size), np.zeros(len(taught))
            for some in block:
                segment = stream.segment[stream.token[some]]
                spelled, learned = stream.spelled[some].astype(np.int64), taught[segment].astype(np.int64)
                offsets, lanes = own[:, segment], segment + (np.arange(CONTEXTS) * len(taught))[:, None]
                chance, moved = np.ones(len(some)), np.zeros((CONTEXTS, len(some)))
                for depth, m, slots, bit in stream.bits(some, self.shift):
                    x, at = self.inputs(slots, bit, learned[:m], spelled[:m])
                    logit = self.weighed(x, at, offsets[:, :m])
                    final, p = self.refined(logit, spelled[:m] * 32 + min(depth, 31))
                    chance[:m] *= np.where(bit == 1, final, 1 - final)
                    if depth % 32 == 31:  # 32 bits stay far above the smallest number
                        out[some] += np.log(chance)
                        chance[:] = 1.0
                    x *= bit.astype(np.float32) - p
                    moved[:, :m] += x
                out[some] += np.log(chance)
                steps += np.bincount(lanes.ravel(), weights=moved.ravel(), minlength=own.size)
                bits += np.bincount(segment, weights=stream.lengths[some], minlength=len(taught))
            own += OWN_RATE * steps.reshape(own.shape) / (bits + OWN_SLOW)
        return np.bincount(stream.token, weights=out, minlength=len(stream.place)) / math.log(10) + stream.numbers


def fit(texts: DataFrame, book, tokens: int) -> Mixer:
    """Slots, weights and map from all training `texts`, with the codes of a broadcast `book`.

    Each task trains weights of its own, online; they are averaged by how often
    a task used them.
    """
    passes = Passes(texts.sparkSession, book.value)
    bits = min(max(int(math.log2(max(2, tokens))) - 3, SLOT_BITS[0]), SLOT_BITS[1])
    packed = np.zeros(1 << bits, np.uint16)
    for at, part in count_slots(texts, passes, bits, tokens):  # two bytes a slot
        packed[at * SLICE // 2 : at * SLICE // 2 + len(part)] = part
    mixer = Mixer(packed)
    start = passes.model(mixer)

    def add(key, table):
        sums = sum(np.frombuffer(raw, float) for raw in table.column("sums").to_pylist())
        return pa.table({"sums": [sums.tobytes()]})

    trained = passes.run(texts, "learn", bits, "part int, sums binary", start)
    parts = [np.frombuffer(r["sums"], float) for r in trained.groupBy("part").applyInArrow(add, "sums binary").collect()]
    if parts:
        size, cells = mixer.weights.size, mixer.map.size
        weights, used, total, ones = np.split(sum(parts), [size, 2 * size, 2 * size + cells])
        weights = np.where(used > 0, weights / np.maximum(used, 1), mixer.weights.ravel())
        mixer.weights = weights.reshape(mixer.weights.shape).astype(np.float32)
        mixer.map = ((ones + 20 * mixer.map.ravel()) / (total + 20)).reshape(mixer.map.shape).astype(np.float32)
    start.destroy(), passes.book.destroy()
    return mixer


# A row for each segment, then for each of its different chunks and for each of its words without a code.
LOOKED = (
    "part int, row long, held_out boolean, ident {}, last boolean, n_tokens long, n_bytes long, n_known long, base double,"
    " key long, cost double, again long, coded double, named double, word binary, times long"
)


def different_chunks(keys: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each different chunk of a segment: its key, the cost of its first occurrence, how often it comes
    again, and what that costs by its bits and by a number among the chunks before."""
    different, first, of = np.unique(keys, return_index=True, return_inverse=True)
    new = np.zeros(len(keys))
    new[first] = 1
    before = np.maximum(1, np.cumsum(new) - new)
    rest = 1 - new
    add = lambda values: np.bincount(of, weights=values * rest, minlength=len(different))
    return different, costs[first], add(rest).astype(np.int64), add(costs), add(-np.log10(before))


def whole_chunks(chunks: DataFrame) -> DataFrame:
    """Score of each (part, row) from its chunks (part, row, taught, key, cost, again, coded, named).

    A chunk is named with the probability of its occurrences in other training
    texts among all chunks of training texts, or coded at `cost`; its repeats in
    the text cost `named` or `coded`. Keys that make up a thousandth of all
    rows, a thousand at most, are broadcast; the others meet by a shuffle.
    """
    own = F.when(F.col("taught"), F.col("again") + 1).otherwise(0)
    counts = stage(chunks.groupBy("key").agg(F.sum(own).alias("n"), F.count("*").alias("times")).where("times > 1 and n > 0"), "chunks")
    sums = chunks.agg(F.sum(own), F.sum(F.when(F.col("taught"), F.col("again"))), F.count("*")).first()
    trained, repeats, many = int(sums[0] or 0), int(sums[1] or 0), int(sums[2])
    copies = int(counts.agg(F.sum("n")).first()[0] or 0)
    # how often a chunk is named by another text, by its own, or coded
    ways = np.array([copies, repeats, trained - min(trained, copies + repeats)]) + 1.0
    by_other, by_own, fresh = np.log10(ways / ways.sum()).tolist()
    hot = counts.where(F.col("times") * 1000 > many).select("key", F.col("n").alias("n_hot"))
    marked = chunks.join(F.broadcast(hot), "key", "left")
    others = marked.where(F.col("n_hot").isNull()).drop("n_hot").join(counts.where(F.col("times") * 1000 <= many).select("key", "n"), "key", "left")
    both = others.unionByName(marked.where(F.col("n_hot").isNotNull()).withColumnRenamed("n_hot", "n"))
    left = F.coalesce("n", F.lit(0)) - own
    whole = F.when(left > 0, F.log10(left.cast("double")) + (by_other - math.log10(max(1, trained))))
    repeated = F.greatest(F.col("coded") + F.col("again") * fresh, F.col("named") + F.col("again") * by_own)
    return both.groupBy("part", "row").agg(F.sum(F.greatest(F.col("cost") + fresh, whole) + repeated).alias("score"))


def score_texts(docs: DataFrame, held_out: Column, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of every text: ident, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Rows with `held_out` teach nothing. base_score is the smoothed unigram score;
    score is the model's log10 probability of the text; bits_per_byte spreads it
    over the bytes of the modelled text. A null text is empty and consists of the
    end mark; a null `held_out` counts as true. Repeated rows are scored and
    counted each, and each profits from the other; an empty table gives no rows;
    other columns are not read. Of words that are equally frequent the smaller
    has the earlier code. A very long text is one row of one task; its contexts
    begin anew every SEGMENT tokens, so memory beyond its tokens is bounded.
    """
    spark = with_workers(docs)
    texts = docs.select(
        F.col(ident).alias("ident"), F.col(text).cast("binary").alias("text"), F.coalesce(held_out, F.lit(True)).alias("held_out")
    )
    words = stage(word_counts(texts), "words")
    known = words.where("n_train > 0")
    sums = known.agg(F.sum("n_train"), F.count("*")).first()
    tokens, kinds = int(sums[0] or 0), int(sums[1])
    least = max(LEAST, least_count(known.select(F.col("n_train").alias("n")), HOT_WORDS))
    hot = (F.col("n_train") >= least) & (F.octet_length("word") <= HOT_BYTES)
    table = known.where(hot).select("word", "n_train").toArrow()  # HOT_WORDS words of HOT_BYTES at most
    counts = dict(zip(table.column("word").to_pylist(), table.column("n_train").to_pylist()))
    book = spark.sparkContext.broadcast(Book(counts, tokens - sum(counts.values())))
    mixer = fit(texts.where("not held_out").select("text"), book, tokens)
    log_all, own = math.log10(tokens + kinds + 1), book.value
    if not tokens:
        own.counts[own.words.index(END)] = 0
    passes = Passes(spark, own, np.append(np.log10(own.counts + 1.0) - log_all, 0.0), np.append(own.counts > 0, False))

    kind = dict(texts.dtypes)["ident"]
    looked = stage(passes.run(texts, "score", 64 - mixer.shift, LOOKED.format(kind), passes.model(mixer)), "looked")
    chunks = looked.where("key is not null").select("part", "row", (~F.col("held_out")).alias("taught"), "key", "cost", "again", "coded", "named")
    pairs = looked.where("word is not null").select("part", "row", "word", "times")
    rare = words.where(~hot | (F.col("n_train") == 0)).select(
        "word", (F.col("n_train") > 0).cast("long").alias("known"), (F.log10(F.col("n_train") + 1.0) - log_all).alias("base")
    )
    added = pairs.join(rare, "word").groupBy("part", "row").agg(
        F.sum(F.col("times") * F.col("known")).alias("more_known"), F.sum(F.col("times") * F.col("base")).alias("more_base")
    )
    # a text of several segments has several rows
    sums = looked.where("n_tokens is not null").groupBy("part", "row").agg(
        F.first("ident").alias("ident"), F.first("held_out").alias("held_out"),
        *[F.sum(c).alias(c) for c in ("n_tokens", "n_bytes", "n_known", "base")],
    )
    return sums.join(added, ["part", "row"], "left").join(whole_chunks(chunks), ["part", "row"]).select(
        F.col("ident").alias(ident), "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score",
        (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )
