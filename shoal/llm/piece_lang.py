"""Language identification by unigram pieces with the segmentation summed out.

Each language has a probability for every piece of a fixed public vocabulary. A
word's probability is the sum over all its segmentations into pieces, found by
the forward algorithm; a text's is the product over its words. The probabilities
are fit by expectation-maximisation over the word counts of labelled texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shoal.llm.common import with_workers
from shoal.session import stage

# Labelled documents per language that the fit reads, about (chosen by a hash of
# text, so the choice does not follow the order of rows). Prediction reads all.
FIT_DOCS = 1500
ROUNDS = 3
SMOOTH = 0.05
# Words of a text beyond this many do not sharpen the score further.
SHARP_WORDS = 20
REMEMBERED = 600_000
# Words up to this length are scored side by side.
SIDE_BY_SIDE = 48
LETTERS = re.compile(r"[^\W\d_]+")
SPACE = "▁"
UNDECIDED = "und"


@dataclass
class Model:
    """Piece probabilities: `probs[piece]` has one entry per language, words scaled by BASE."""

    key: str
    languages: list[str]
    pieces: dict[str, int]
    byte_pieces: list[int]
    probs: np.ndarray


def public_pieces(path: str) -> tuple[dict[str, int], list[int]]:
    """Pieces of a sentencepiece file with their numbers, and the pieces for single bytes."""
    from sentencepiece import SentencePieceProcessor

    vocabulary = SentencePieceProcessor(model_file=path)
    pieces, single = {}, [0] * 256
    for i in range(vocabulary.get_piece_size()):
        if vocabulary.is_byte(i):
            single[int(vocabulary.id_to_piece(i)[3:-1], 16)] = i
        elif not (vocabulary.is_control(i) or vocabulary.is_unknown(i) or vocabulary.is_unused(i)):
            pieces[vocabulary.id_to_piece(i)] = i
    return pieces, single


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return LETTERS.findall(text.lower()) if text else []


def forward(word: str, model_pieces: dict, single: list[int], longest: int, probs: list) -> list[float]:
    """Natural log of the word's probability in each language."""
    word = SPACE + word
    n, k = len(word), len(probs[0])
    alpha = [[0.0] * k for _ in range(n + 1)]
    alpha[0] = [1.0] * k
    scale = [0.0] * k
    get = model_pieces.get
    for start in range(n):
        row = alpha[start]
        # what lies before is final; keep the numbers in range for long words
        if start % 16 == 15:
            for lang in range(k):
                top = max(a[lang] for a in alpha[start : start + longest + 1]) or 1.0
                scale[lang] += math.log(top)
                for a in alpha[start : start + longest + 1]:
                    a[lang] /= top
        for end in range(start + 1, min(n, start + longest) + 1):
            piece = get(word[start:end])
            if piece is not None:
                p, to = probs[piece], alpha[end]
                for lang in range(k):
                    to[lang] += row[lang] * p[lang]
        if start:
            p = [1.0] * k
            for b in word[start].encode():
                q = probs[single[b]]
                p = [x * y for x, y in zip(p, q)]
            to = alpha[start + 1]
            for lang in range(k):
                to[lang] += row[lang] * p[lang]
    return [math.log(a or 1e-300) + s for a, s in zip(alpha[n], scale)]


class Pieces:
    """The vocabulary by a 64-bit rolling hash of its pieces, for many words at a time."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, model: Model) -> None:
        names = list(model.pieces)
        with np.errstate(over="ignore"):
            keys = []
            for name in names:
                h = np.uint64(0)
                for c in name:
                    h = h * self.BASE + np.uint64(ord(c))
                keys.append(h)
        keys = np.array(keys, np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([model.pieces[n] for n in names], np.int64)[order]
        self.longest = max(map(len, names), default=1)
        self.model, self.rows = model, model.probs.tolist()

    def scores(self, words: list[str]) -> np.ndarray:
        """What `forward` gives, one row per word; words of one length are worked on together."""
        out = np.zeros((len(words), len(self.model.languages)))
        by: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by.setdefault(len(word), []).append(i)
        for length, at in by.items():
            if length > SIDE_BY_SIDE:
                for i in at:
                    out[i] = forward(words[i], self.model.pieces, self.model.byte_pieces, self.longest, self.rows)
            for begin in range(0, len(at), 8192) if length <= SIDE_BY_SIDE else ():
                some = at[begin : begin + 8192]
                out[some] = self._together([words[i] for i in some], length)
        return out

    def _together(self, words: list[str], length: int) -> np.ndarray:
        m, n, probs = len(words), length + 1, self.model.probs
        points = np.full((n, m), ord(SPACE), np.uint64)
        points[1:] = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(m, length).T
        chars, place = np.unique(points[1:], return_inverse=True)
        place = place.reshape(length, m)
        single = np.array([np.prod([probs[self.model.byte_pieces[b]] for b in chr(int(c)).encode()], axis=0) for c in chars])
        alpha = np.zeros((n + 1, m, probs.shape[1]))
        alpha[0] = 1.0
        scale = np.zeros((m, probs.shape[1]))
        for start in range(n):
            if start % 16 == 15:
                ahead = alpha[start : start + self.longest + 1]
                top = np.where(ahead.max(axis=0) > 0, ahead.max(axis=0), 1.0)
                scale += np.log(top)
                ahead /= top
            row, key = alpha[start], np.zeros(m, np.uint64)
            for end in range(start + 1, min(n, start + self.longest) + 1):
                key = key * self.BASE + points[end - 1]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = np.flatnonzero(self.keys[at] == key)
                if len(hit):
                    alpha[end, hit] += row[hit] * probs[self.ids[at[hit]]]
            if start:
                alpha[start + 1] += row * single[place[start - 1]]
        return np.log(np.maximum(alpha[n], 1e-300)) + scale


def expected_pieces(word: str, pieces: dict, single: list[int], longest: int, probs: list[float], count: float) -> list[tuple[int, float]]:
    """Expected uses of pieces in `count` occurrences of a short word in one language (forward-backward)."""
    word = SPACE + word
    n = len(word)
    edges = []
    get = pieces.get
    for start in range(n):
        for end in range(start + 1, min(n, start + longest) + 1):
            piece = get(word[start:end])
            if piece is not None:
                edges.append((start, end, (piece,), probs[piece]))
        if start:
            ids = tuple([single[b] for b in word[start].encode()])
            edges.append((start, start + 1, ids, math.prod([probs[i] for i in ids])))
    alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
    alpha[0] = beta[n] = 1.0
    for start, end, _, p in edges:
        alpha[end] += alpha[start] * p
    for start, end, _, p in reversed(edges):
        beta[start] += p * beta[end]
    weight = count / (alpha[n] or 1e-300)
    return [(i, alpha[start] * p * beta[end] * weight) for start, end, ids, p in edges for i in ids]


# Words longer than this are left out of the fit, where their products would underflow.
FIT_LENGTH = 40


def fit(labelled: DataFrame, pieces: dict[str, int], single: list[int], lang: str = "lang", text: str = "text") -> Model:
    """Piece probabilities per language from labelled rows; null labels and texts teach nothing.

    Reads about FIT_DOCS texts of each language. Expectations are computed in
    tasks over the different words and added up by Spark; only the sums, one per
    language and piece of the vocabulary, reach the driver.
    """
    with_workers(labelled)
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().toLocalIterator()}
    languages = sorted(sizes)
    shares = [(x, float(min(1.0, FIT_DOCS / sizes[x]))) for x in languages]
    size = max(pieces.values(), default=0) + 1
    size = max(size, max(single) + 1)
    if not languages:
        return Model("none", [], pieces, single, np.zeros((size, 0)))
    share = F.create_map(*[F.lit(v) for pair in shares for v in pair])[F.col("lang")]
    unit = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.where(unit < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for label, body in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                seen.setdefault(label, Counter()).update(w for w in words_of(body) if len(w) <= FIT_LENGTH)
            flat = [(label, w, n) for label, c in seen.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"]
            )

    counts = chosen.mapInArrow(count, "lang string, word string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    place = {x: i for i, x in enumerate(languages)}
    counts = stage(counts, "words")
    k, longest = len(languages), max(map(len, pieces))
    probs = np.full((size, k), 1.0 / size)
    for _ in range(ROUNDS):
        shared = counts.sparkSession.sparkContext.broadcast(probs)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_language = shared.value.T.tolist()
            used = [[0.0] * size for _ in range(k)]
            for batch in batches:
                for word, label, n in zip(*(batch.column(c).to_pylist() for c in ("word", "lang", "n"))):
                    at = place[label]
                    mine = used[at]
                    for piece, share in expected_pieces(word, pieces, single, longest, by_language[at], n):
                        mine[piece] += share
            used = np.array(used).T
            at, of = np.nonzero(used)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(of), pa.array(used[at, of])], ["piece", "lang", "n"])

        sums = counts.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        got = sums.orderBy("piece", "lang").toArrow()  # at most vocabulary x languages rows
        probs = np.full((size, k), SMOOTH)
        probs[got.column("piece").to_numpy(), got.column("lang").to_numpy()] += got.column("n").to_numpy()
        probs /= probs.sum(axis=0)
    key = f"{counts.sparkSession.sparkContext.applicationId}-{hash(probs.tobytes())}"
    return Model(key, languages, pieces, single, probs)


_seen: dict[str, list] = {}


def _rows(cache: list, words: set[str]) -> tuple[np.ndarray, dict[str, int]]:
    """Scores of words by place, and the place of each; what does not fit is forgotten first."""
    pieces, known, rows = cache
    new = [w for w in words if w not in known]
    if len(known) + len(new) > REMEMBERED:
        known, rows, new = {}, rows[:0], list(words)
    if new:
        rows = np.concatenate([rows, pieces.scores(new)])
        known.update(zip(new, range(len(known), len(known) + len(new))))
        cache[1:] = [known, rows]
    return rows, known


def identify(docs: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """All columns of `docs` and `lang_pred`, `score` (0 to 1), from the whole text alone.

    A null text or one without a letter, or any text under a model without
    languages, is 'und' with score 0. The score is the posterior of the best
    language under equal priors, sharpened by at most SHARP_WORDS words; ties go
    to the language that sorts first. `prefix` is put before the two new names;
    a column of `docs` with the same name is an error. A long text is read in
    one piece, an empty table gives no rows.
    """
    with_workers(docs)
    names = [f"{prefix}lang_pred", f"{prefix}score"]
    if clash := set(names) & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already; choose a prefix")
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)
    columns = docs.columns

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if m.key not in _seen:
            _seen.clear()
            _seen[m.key] = [Pieces(m), {}, np.zeros((0, len(m.languages)))]
        cache = _seen[m.key]
        for whole in batches:
            for begin in range(0, whole.num_rows, 1024):
                batch = whole.slice(begin, 1024)
                texts = [words_of(body) if m.languages else [] for body in batch.column(columns.index(text)).to_pylist()]
                rows, known = _rows(cache, set().union(*texts))
                labels, scores = [], []
                for words in texts:
                    if not words:
                        labels.append(UNDECIDED)
                        scores.append(0.0)
                        continue
                    total = rows[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(axis=0)
                    best = int(np.argmax(total))
                    sharp = (total - total[best]) * min(1.0, SHARP_WORDS / len(words))
                    labels.append(m.languages[best])
                    scores.append(float(1.0 / np.exp(sharp).sum()))
                arrays = [*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(predict, f"{fields}, `{names[0]}` string, `{names[1]}` double")
