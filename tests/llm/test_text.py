"""Language models, language identification, leaks, licences, token output and the pipeline."""

from __future__ import annotations

import collections
import math
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shoal.llm import context_mix, latent_leaks, queries, rank_vbyte
from shoal.llm.common import remainder
from shoal.llm.context_mix import score_texts
from shoal.llm.latent_leaks import common_length, find_leaks, judge, without_leaks, words_of
from shoal.llm import license_text
from shoal.llm.license_text import scan_licenses
from shoal.llm.piece_lang import Model, Pieces, expected_pieces, fit, forward, identify, public_pieces

TABLES = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="test tables are not here")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet").repartition(4)


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


@needs_tables
def test_base_scores_and_model(spark, small, edge_docs):
    docs = small.unionByName(edge_docs.select(*small.columns).withColumn("doc_id", F.col("doc_id") + 100_000))
    got = {r["doc_id"]: r for r in score_texts(docs, remainder(F.col("doc_id"), 7) == 2).collect()}
    rows = docs.collect()
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    counts = collections.Counter(t for r in rows if not held(r["doc_id"]) for t in tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        if r["doc_id"] is None:
            continue
        own, words = got[r["doc_id"]], tokens(r["text"])
        assert own["held_out"] == held(r["doc_id"]) and own["train_tokens"] == n and own["n_tokens"] == len(words)
        assert own["n_known"] == sum(counts[w] > 0 for w in words)
        assert own["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        assert own["score"] < 0
    apart = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in apart) > 1.2 * sum(r["base_score"] for r in apart)  # the tables are tiny here


def test_scores_empty(no_docs):
    assert score_texts(no_docs, F.lit(False)).count() == 0


def test_every_training_text_trains_the_weights(spark):
    texts = spark.createDataFrame([(f"some words of text {i} come again and again {i % 3}".encode(),) for i in range(60)], "text binary")
    texts = texts.where(F.pmod(F.xxhash64("text"), F.lit(8)) != 0).repartition(3)
    counts = collections.Counter(t for r in texts.collect() for t in tokens(r["text"].decode()))
    book = spark.sparkContext.broadcast(context_mix.Book({w: n for w, n in counts.items() if n > 1}, sum(n == 1 for n in counts.values())))
    mixer = context_mix.fit(texts, book, sum(counts.values()))
    assert (mixer.weights != np.float32(0.3)).any()
    start = context_mix.Mixer(mixer.slots)
    assert np.abs(mixer.map - start.map).max() > 0.01


def segmentations(word, pieces, single, probs):
    """Sum over all ways to cut a word, by recursion."""
    if not word:
        return 1.0
    total = 0.0
    for end in range(1, len(word) + 1):
        if word[:end] in pieces:
            total += probs[pieces[word[:end]]] * segmentations(word[end:], pieces, single, probs)
    if word[0] != "▁":
        total += math.prod(probs[single[b]] for b in word[0].encode()) * segmentations(word[1:], pieces, single, probs)
    return total


def test_forward_sums_all_segmentations():
    pieces = {"▁": 256, "a": 257, "b": 258, "ab": 259, "▁a": 260, "ba": 261, "aba": 262}
    single = list(range(256))
    probs = np.random.default_rng(0).random(263)
    for word in ("a", "abab", "bé", "abaabaabaabaabaabab"):
        got = forward(word, pieces, single, 3, [[p, 2 * p] for p in probs])
        assert got[0] == pytest.approx(math.log(segmentations("▁" + word, pieces, single, probs)))
    model = Model("k", ["x", "y"], pieces, single, np.stack([probs, 2 * probs], axis=1))
    words = ["a", "abab", "bé", "b" * 60, "ab" * 22, "é漢𝒳a"]
    want = [forward(w, pieces, single, 3, model.probs.tolist()) for w in words]
    assert np.allclose(Pieces(model).scores(words), want)
    used = expected_pieces("abab", pieces, single, 3, probs.tolist(), 2.0)
    letters = {260: 1, 257: 1, 258: 1, 259: 2, 261: 2, 262: 3, 97: 1, 98: 1}
    assert sum(n * letters.get(i, 0) for i, n in used) == pytest.approx(2.0 * 4)


@needs_tables
def test_languages(spark, small, edge_docs, no_docs):
    docs = small.select("doc_id", "text", "lang")
    model = queries.language_model(docs)
    got = identify(docs, model).where(remainder(F.col("doc_id"), 3) == 1)
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()
    odd = {r["doc_id"]: r for r in identify(edge_docs, model).collect()}
    assert {odd[i]["lang_pred"] for i in (3, 4, 5, 8)} == {"und"} and odd[7]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in odd.values())
    assert identify(no_docs, model).count() == 0
    with pytest.raises(ValueError):
        identify(docs.withColumn("score", F.lit(1)), model)
    pieces, single = public_pieces(queries.vocabulary_file("piece_bpe_32k.model"))
    nothing = fit(no_docs, pieces, single)
    assert identify(docs.limit(3), nothing).select("lang_pred").distinct().collect()[0][0] == "und"


def test_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(1, 6, 12).tolist(), rng.integers(0, 6, 30).tolist()
        row = [0] * (len(b) + 1)
        for x in a:
            row = _lcs_row(row, x, b)
        assert common_length(a, b) == row[-1]
    assert judge([1, 2, 3, 4, 5], [9, 1, 2, 3, 4, 5]) == (5, True)
    assert judge([1, 2, 3, 4, 5], [1, 2, 9, 9, 9]) is None


def _lcs_row(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
    return out


PASSAGES = [
    "Which metal is liquid at room temperature and was once used in thermometers answer mercury of course",
    "The treaty that ended the long war between both kingdoms was signed in the spring of that year near the river",
]


def test_leaks(spark, edge_docs, no_docs):
    filler = [" ".join(f"w{(i * 37 + j * 11) % 503}" for j in range(80)) for i in range(60)]
    changed = PASSAGES[0].split()
    changed[3], changed[9] = "often", "sometimes"
    texts = {
        1: f"{filler[0]} {PASSAGES[0].upper()}!! {filler[1]}",
        2: f"{filler[2]} {' '.join(changed)} {filler[3]}",
        3: f"{filler[4]} {' '.join(PASSAGES[1].split()[:6])} {filler[5]}",  # a short overlap is no leak
        4: PASSAGES[1],
    }
    texts |= {100 + i: t for i, t in enumerate(filler)}
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame([(7, PASSAGES[0]), (8, PASSAGES[1]), (9, None), (10, ""), (11, PASSAGES[1])], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, bench).collect()}
    assert found == {(1, 7), (2, 7), (4, 8), (4, 11)}
    assert {r["doc_id"] for r in without_leaks(docs, bench).collect()} == set(texts) - {1, 2, 4}
    assert without_leaks(edge_docs, bench).count() == edge_docs.count()
    assert find_leaks(no_docs, bench).count() == 0 and find_leaks(docs, bench.limit(0)).count() == 0


def test_latent_space_takes_in_every_document(spark, monkeypatch):
    """As by outer products of all windows, also of more documents than weigh as they are."""
    monkeypatch.setattr(latent_leaks, "FIT_DOCS", 5)
    monkeypatch.setattr(latent_leaks, "RANK", 4)
    monkeypatch.setattr(latent_leaks, "SLICE", 16, raising=False)
    monkeypatch.setattr(latent_leaks, "PART", 20, raising=False)
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(50)])
    texts = [" ".join(rng.choice(words, 70)) + " filler" * (i % 3) for i in range(40)] + ["", None]
    bench = spark.createDataFrame([(i, " ".join(words[i * 10 : i * 10 + 10])) for i in range(4)], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    (block,) = latent_leaks.blocks_of(bench, "item_id", "text")
    latent_leaks.prepare(docs, block)

    numbers = [block.numbers((t or "").encode()) for t in texts]
    n = np.array([len(texts)] + [sum(t in x for x in numbers) for t in range(1, len(block.terms) + 1)])
    weights = np.log((n[0] + 1) / (n + 1)) + 0.1
    weights[0] = 0.0  # every passage would lose all of its terms, which are common here

    def outer(rows):
        total = np.zeros((len(n), len(n)))
        for row in rows:
            a = np.zeros(len(n))
            np.add.at(a, row, weights[row])
            length = np.linalg.norm(weights[row])
            total += np.outer(a, a) / (length * length or 1.0)
        return total

    wide, size = 20, 2 * latent_leaks.SHORTEST
    windows = [x[i : i + size] for x in numbers for i in range(0, len(x), size)]
    whole = outer(windows) * 5 / len(texts) + latent_leaks.PASSAGE_WEIGHT**2 * outer([np.array(i) for i in block.items])
    basis = np.linalg.qr(np.random.default_rng(17).standard_normal((len(n), wide)))[0]
    for _ in range(latent_leaks.POWER_STEPS):
        image = whole @ basis
        basis = np.linalg.qr(image)[0]
    want = (basis @ np.linalg.svd(image.T @ basis)[0])[:, :4] * weights[:, None]
    assert np.abs(block.latent @ block.latent.T - want @ want.T).max() < 1e-3 * np.abs(want @ want.T).max()


@needs_tables
def test_leaks_against_exact_search(spark, small):
    bench = spark.read.parquet(f"{TABLES}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in find_leaks(small, bench).collect()}
    want = set()
    for d in small.collect():
        words = b" %s " % b" ".join(words_of(d["text"].encode()))
        want |= {(d["doc_id"], b["item_id"]) for b in bench.collect() if b" %s " % b" ".join(words_of(b["text"].encode())) in words}
    assert want and found == want


def test_licences(spark, edge_docs, no_docs):
    texts = {
        1: "Some words.\nReleased under the MIT License.\nMore words.",
        2: "This work is licensed under the GNU General Public License, version 2.",
        3: "A driver must carry a license. The license of the restaurant was renewed.",
        4: "éé intro text that goes on for a while. Licensed under the Apache License, Version 2.0. And then the story continues as before.",
        5: "Licensed under CC BY-NC 3.0.\nLicensed under CC BY 4.0.",
    }
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r["families"] for r in scan_licenses(docs).collect()}
    assert got == {1: "MIT", 2: "GPL", 3: "", 4: "Apache-2.0", 5: "CC-BY,CC-BY-NC"}
    assert scan_licenses(edge_docs).where("n_paragraphs > 0").count() == 0
    assert scan_licenses(no_docs).count() == 0


@pytest.fixture(scope="module")
def licence_model():
    return license_text.fit(["a line of plain text about ships", "the harbour was closed in winter"])


GPL_NOTICE = (
    "This program is free software: you can redistribute it and/or modify\n"
    "it under the terms of the GNU General Public License as published by\n"
    "the Free Software Foundation, either version 3 of the License."
)


@pytest.mark.parametrize("text, families", [
    ("Licensed under the Apache License, Version 2.0. Released under the MIT License.", {"Apache-2.0", "MIT"}),
    ("Released under the MIT License. Licensed under the Apache License, Version 2.0.", {"Apache-2.0", "MIT"}),
    ("Released under the\nMIT License.", {"MIT"}),
    (GPL_NOTICE, {"GPL"}),
    (GPL_NOTICE.replace("General", "Affero General"), {"AGPL"}),
    ("Eclipse Public License, version 2.0", set()),
    ("Licensed under the Eclipse Public License, version 2.0.", set()),
    ("SPDX-License-Identifier: EUPL-1.2", set()),
    ("SPDX-License-Identifier: Apache-2.0", {"Apache-2.0"}),
    ("Licensed under the Apache License, Version 1.1.", set()),
    ("Licensed under the Foo License, Version 2.0.", set()),
    ("Released under the\n\nMIT License.", set()),
])
def test_licence_families(licence_model, text, families):
    assert {s[0] for s in licence_model.spans(text)} == families
    assert {s[0] for s in licence_model.spans("Ships left the harbour.\n\n" + text + "\n\nThe end.")} == families


def test_licence_spans_against_all_passages(licence_model):
    rng = np.random.default_rng(4)
    plain = ["The ship left the harbour.", "A driver must carry a license.", "Nothing else\nwas seen.", "It rained."]
    notices = [t for texts in license_text.TEMPLATES.values() for t in texts]
    for _ in range(25):
        parts = [str(rng.choice(notices if rng.random() < 0.4 else plain)) for _ in range(6)]
        text = "".join(p + str(rng.choice([" ", "\n", "\n\n"])) for p in parts)
        want = []
        for at, end in license_text.paragraphs(text):
            assert "\n\n" not in text[at:end]
            hits = {(h[0], a, b) for a, b in license_text.passages(text, at, end) if (h := licence_model.predict(text[a:b]))}
            pure = [h for h in hits if not any(o[0] != h[0] and h[1] <= o[1] and o[2] <= h[2] and o[1:] != h[1:] for o in hits)]
            for h in sorted(pure, key=lambda s: (s[1], -s[2])):
                if all(o[0] != h[0] or o[2] <= h[1] for o in want):
                    want.append(h)
        got = licence_model.spans(text)
        assert [s[1:] for s in got] == sorted(s[1:] for s in want) and {s[0] for s in got} == {s[0] for s in want}


def test_coding_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 3, 4, 5, 1000):
        numbers = rng.integers(0, 1 << 32, n).astype(np.uint32) >> rng.integers(0, 32, n).astype(np.uint32)
        control, data = rank_vbyte.pack(numbers)
        assert len(control) == -(-n // 4)
        assert (rank_vbyte.unpack(control, data, n) == numbers).all()


def plain_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary_file("word_bpe_49k.json"))
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_words_encode_like_the_text():
    rng = np.random.default_rng(6)
    letters = list("abSTtLl1 '\n.<|é́İſK  Σ7ß漢,-") + ["<|endoftext|>", "'re", "'LL"]
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 14)))) for _ in range(1500)]
    path = queries.vocabulary_file("word_bpe_49k.json")
    got = rank_vbyte.token_bytes([t.encode() for t in texts], path)
    assert [np.frombuffer(g, rank_vbyte.id_type(path)).tolist() for g in got] == plain_ids(texts)


class CountedTokenizer:
    """A tokenizer that keeps what it is asked to encode."""

    def __init__(self, tokenizer):
        self.tokenizer, self.asked = tokenizer, []

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch_fast(self, texts, **options):
        self.asked += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_new_words_are_encoded_together(monkeypatch):
    rng = np.random.default_rng(9)
    letters = list("abcdeXYÉéß")
    words = ["".join(rng.choice(letters, 9)) + end for end in ("", ".", "'LL", "0") for _ in range(500)] + ["漢字", "İx", "<|endoftext|>", "0", "00"]
    texts = [" ".join(rng.permutation(words)), None, "", " \t", "\n a 0 0 A\r\n", *words]
    path = queries.vocabulary_file("word_bpe_49k.json")
    counted = CountedTokenizer(rank_vbyte._tokenizer(path)[0])
    monkeypatch.setitem(rank_vbyte._tokenizers, path, (counted, {}))
    batch = pa.array([None if t is None else t.encode() for t in ["left out", *texts]], pa.binary()).slice(1)
    got = [np.frombuffer(g, rank_vbyte.id_type(path)).tolist() for g in rank_vbyte.token_bytes(batch.to_pylist(), path)]
    assert got == plain_ids(texts)
    assert len(counted.asked) < 50  # 2,000 different words of new pieces
    assert rank_vbyte.token_ids(batch, path).to_pylist() == rank_vbyte.token_bytes(batch.to_pylist(), path)
    monkeypatch.setattr(rank_vbyte, "REMEMBERED", 100)
    monkeypatch.setitem(rank_vbyte._tokenizers, path, (counted, {}))
    assert rank_vbyte.token_ids(batch, path).to_pylist() == rank_vbyte.token_bytes(batch.to_pylist(), path)
    assert rank_vbyte.token_bytes([], path) == []


def test_tokens_of_edges(edge_docs, no_docs):
    got = rank_vbyte.tokenize(edge_docs, queries.vocabulary_file("word_bpe_49k.json")).orderBy("start").collect()
    rows = edge_docs.collect()
    ids = plain_ids([r["text"] for r in rows])
    assert sum(r["n_tokens"] for r in got) == sum(map(len, ids))
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, i in zip(rows, ids))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["doc_id"] for r in got if r["doc_id"] is not None] == sorted(r["doc_id"] for r in got if r["doc_id"] is not None)
    assert rank_vbyte.tokenize(no_docs, queries.vocabulary_file("word_bpe_49k.json")).count() == 0


@needs_tables
def test_pipeline_stages(spark, edge_docs):
    """Each stage against what its operator says of the same rows; columns stay."""
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    extra = edge_docs.select(*docs.columns).withColumn("doc_id", F.col("doc_id") + 10_000)
    docs = docs.unionByName(extra)
    columns = docs.columns
    named = corpus_pipeline.identify_language(spark, docs, TABLES)
    assert named.columns == columns
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in named.collect()} >= {10_003, 10_004, 10_005, 10_008}
    single = corpus_pipeline.drop_near_duplicates(spark, named, TABLES)
    classes = {r["component_id"] for r in queries.near_duplicates(named).collect()}
    assert {r["doc_id"] for r in single.collect()} == classes and single.count() == len(classes)
    clean = corpus_pipeline.decontaminate(spark, single, TABLES)
    leaks = {r["doc_id"] for r in find_leaks(single, spark.read.parquet(f"{TABLES}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in clean.collect()} == classes - leaks
    mixed = corpus_pipeline.mix_sources(spark, clean, TABLES)
    assert mixed.columns == columns
    copies = collections.Counter(r["doc_id"] for r in mixed.collect())
    taken = {r["doc_id"]: r["copies"] for r in queries.mix(clean).collect()}
    assert copies == {i: n for i, n in taken.items() if n}
    final = corpus_pipeline.write_token_ids(spark, mixed, TABLES).collect()
    assert collections.Counter(r["doc_id"] for r in final) == copies
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "simhash_near_dedup", "benchmark_decontamination", "source_mix", "token_output"
    ]


def bit_by_bit(mixer, book, tokens, taught):
    """log10 of each token's probability: one bit after the other, each context hashed anew."""
    mask = (1 << 64) - 1
    a, b = int(context_mix._MIX_A), int(context_mix._MIX_B)
    hashed = lambda *parts: int(context_mix.mixed_hash(*[np.array([p & mask], np.uint64) for p in parts])[0])
    index = {w: i for i, w in enumerate(book.words)}
    name = lambda w: index[w] + 1 if w in index else zlib.crc32(w) | 1 << 33
    symbols, numbers, spelt = [], [0.0] * len(tokens), []
    for t, w in enumerate(tokens):
        one, two, three = [name(tokens[t - k]) if t >= k else 0 for k in (1, 2, 3)]
        recent = next((name(v) for v in reversed(tokens[:t]) if index.get(v, 1 << 40) < context_mix.COMMON), 0)
        contexts = [hashed(1), hashed(2, recent), hashed(3, one), hashed(4, two), hashed(5, one, two), hashed(6, one, two, three)]
        symbol = index.get(w, len(book.words) + (w in spelt))
        symbols.append((t, 0, int(book.codes[symbol]), int(book.lengths[symbol]), contexts))
        if w in spelt:
            numbers[t] = -math.log10(len(spelt))
        elif w not in index:
            spelt.append(w)
            prefix, letters = 0, [0, 0, 0]
            for at, c in enumerate(w + b" "):
                l1, l2, l3 = letters
                contexts = [
                    hashed(11, l1, min(at, 7)), hashed(12, l1, l2), hashed(13, l1, l2, l3), hashed(14, recent, l1, l2), hashed(15, prefix),
                    hashed(16, prefix, one),
                ]
                symbols.append((t, 1, c, 8, contexts))
                prefix = (prefix + (c + 1) * pow(a, at + 1, 1 << 64)) & mask
                letters = [c + 1, l1, l2]
    out, own = list(numbers), np.zeros(context_mix.CONTEXTS)
    block = lambda t: max(0, int(math.log2(max(1, t))) - 5)
    for now in range(block(len(tokens)) + 1):
        steps, bits = np.zeros(context_mix.CONTEXTS), 0
        for t, spelled, code, length, contexts in symbols:
            for depth in range(length if block(t) == now else 0):
                node = code >> (length - depth) | 1 << depth
                bit = code >> (length - depth - 1) & 1
                slots = [(((c + node * b) & mask) * a & mask) >> mixer.shift for c in contexts]
                packed = [int(mixer.slots[s]) + ((1 + bit) << 16 if taught else 0) for s in slots]
                x, sure = [float(mixer.logits[p]) for p in packed], [int(mixer.sure[p]) for p in packed]
                gate = (spelled * 8 + sure[2]) * 8 + sure[4]
                logit = sum(x[k] * (mixer.weights[k][gate * 8 + sure[k]] + own[k]) for k in range(context_mix.CONTEXTS))
                logit = min(context_mix.LIMIT, max(-context_mix.LIMIT, logit))
                row = mixer.map[spelled * 32 + min(depth, 31)]
                place = (logit + context_mix.LIMIT) * context_mix.KNOTS / (2 * context_mix.LIMIT)
                cell = min(int(place), context_mix.KNOTS - 1)
                p = 1 / (1 + math.exp(-logit))
                final = 0.5 * p + 0.5 * (row[cell] * (cell + 1 - place) + row[cell + 1] * (place - cell))
                final = min(1 - 1e-5, max(1e-5, final))
                out[t] += math.log10(final if bit else 1 - final)
                steps += np.array(x) * (bit - p)
                bits += 1
        own += context_mix.OWN_RATE * steps / (bits + context_mix.OWN_SLOW)
    return out


def test_mixing_bit_by_bit():
    rng = np.random.default_rng(4)
    words = [f"w{i}é" for i in range(40)] + ["the", "of", "x" * 50]
    texts = [[*(words[i].encode() for i in rng.integers(0, len(words), n)), b"\n"] for n in (0, 1, 70, 300)]
    book = context_mix.Book({w.encode(): i + 1 for i, w in enumerate(words[:30])}, 200)
    counts = np.zeros(2 << 16, np.int64)
    stream = context_mix.Stream(book, texts)
    for _, _, slots, bit in stream.bits(np.argsort(-stream.lengths, kind="stable"), 48):
        np.add.at(counts, (slots * 2 + bit).ravel(), 1)
    mixer = context_mix.Mixer(context_mix.pack(counts))
    mixer.weights = rng.uniform(0.1, 0.5, mixer.weights.shape).astype(np.float32)
    taught = np.array([True, False, True, False])
    got = np.split(mixer.costs(stream, taught), stream.starts[1:])
    for text, held, own in zip(texts, taught, got):
        assert np.allclose(own, bit_by_bit(mixer, book, text, held), rtol=1e-3, atol=1e-3)
    # a code is complete: the words and the two escapes share all of it
    assert sum(2.0 ** -book.lengths) == pytest.approx(1.0)
    whole = context_mix.pack(np.array([0, 1, 127, 128, 1 << 30, 1 << 28]))
    logits, _ = context_mix.unpacked()
    assert logits[whole[2]] == pytest.approx(math.log(0.25), abs=0.1) and logits[whole[0]] == pytest.approx(math.log(1.4 / 0.4))
    assert logits[int(whole[0]) + (2 << 16)] == 0  # its own count taken out


def test_learning_bit_by_bit(monkeypatch):
    monkeypatch.setattr(context_mix, "STEP", 64)
    rng = np.random.default_rng(5)
    words = [f"w{i}".encode() for i in range(40)]
    texts = [[*(words[i] for i in rng.integers(0, 40, n)), b"\n"] for n in (30, 200)]
    stream = context_mix.Stream(context_mix.Book({w: i + 1 for i, w in enumerate(words[:30])}, 200), texts)
    counts = np.zeros(2 << 16, np.int64)
    for _, _, slots, bit in stream.bits(np.argsort(-stream.lengths, kind="stable"), 48):
        np.add.at(counts, (slots * 2 + bit).ravel(), 1)
    mixer = context_mix.Mixer(context_mix.pack(counts))
    shape = mixer.weights.shape
    weights, squares, used = np.full(shape, 0.3), np.ones(shape), np.zeros(shape)
    bits = ones = 0
    for part in (p for block in stream.blocks() for some in block for p in np.array_split(some, -(-len(some) // 64))):
        for _, m, slots, bit in stream.bits(part, 48):
            step = np.zeros(shape)
            for i in range(m):
                packed = [int(mixer.slots[s]) + (1 + int(bit[i]) << 16) for s in slots[:, i]]
                x, sure = mixer.logits[packed].astype(float), mixer.sure[packed].astype(int)
                at = (int(stream.spelled[part[i]]) * 8 + sure[2]) * 64 + sure[4] * 8 + sure
                logit = sum(x[k] * weights[k, at[k]] for k in range(context_mix.CONTEXTS))
                p = 1 / (1 + math.exp(-min(context_mix.LIMIT, max(-context_mix.LIMIT, logit))))
                for k in range(context_mix.CONTEXTS):
                    step[k, at[k]] += x[k] * (bit[i] - p)
                    used[k, at[k]] += 1
                bits, ones = bits + 1, ones + int(bit[i])
            squares += step * step
            weights += context_mix.RATE * step / np.sqrt(squares)
    got_used, got_total, got_ones = mixer.learn(iter([stream]))
    assert (got_used == used).all() and got_total.sum() == bits and got_ones.sum() == ones
    assert np.allclose(mixer.weights, weights, atol=1e-4) and np.abs(weights - 0.3).max() > 0.01


def test_passes_are_those_of_stream_and_mixer(spark, monkeypatch):
    monkeypatch.setattr(context_mix, "TOGETHER", 300)
    monkeypatch.setattr(context_mix, "SEGMENT", 150)
    monkeypatch.setattr(context_mix, "PART", 100)
    monkeypatch.setattr(context_mix, "STEP", 64)
    rng = np.random.default_rng(6)
    words = [f"W{i}é" for i in range(60)] + ["x" * 50, "the"]
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), n)) for n in (0, 1, 149, 150, 400)] + [None, " \t\x0b the\x00 THE\r\n"]
    rows = [(i, None if t is None else t.encode(), bool(i % 3 == 1)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "ident long, text binary, held_out boolean").coalesce(1)
    counts = {w.lower().encode(): i + 1 for i, w in enumerate(words[:35])}
    book = context_mix.Book(counts, 200)
    passes = context_mix.Passes(spark, book, np.arange(len(book.words) + 1.0), np.arange(len(book.words) + 1) % 2 == 0)
    passes.limits = (300, 150, 100, 64, *passes.limits[4:])
    batch = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.binary())], ["text"])
    about = [(a, s) for segments, some in context_mix.segments_of([batch]) for s, a in zip(segments, some)]
    streams = [context_mix.Stream(book, segments) for segments, _ in context_mix.segments_of([batch])]
    assert len(streams) > 1 and [a[0] for a, _ in about].count(4) == 3

    got = {r["word"]: (r["n_train"], r["n"]) for r in context_mix.word_counts(docs).collect()}
    both, train = collections.Counter(), collections.Counter()
    for _, text, held in rows:
        both.update(context_mix.tokens_of(text))
        train.update([] if held else context_mix.tokens_of(text))
    assert got == {w: (train[w], n) for w, n in both.items()}

    counts = np.zeros(2 << 16, np.int64)
    for stream in streams:
        for _, _, slots, bit in stream.bits(np.argsort(-stream.lengths, kind="stable"), 48):
            np.add.at(counts, (slots * 2 + bit).ravel(), 1)
    packed = np.zeros(1 << 16, np.uint16)
    for at, part in context_mix.count_slots(docs.select("text"), passes, 16, 1000):
        packed[at * context_mix.SLICE // 2 :][: len(part)] = part
    assert (packed == context_mix.pack(counts)).all() and packed.any()

    mixer = context_mix.Mixer(packed)
    start = passes.model(mixer)
    (learned,) = passes.run(docs.select("text"), "learn", 16, "part int, sums binary", start).collect()
    used, total, ones = mixer.learn(iter(streams))
    size = mixer.weights.size
    sums = np.split(np.frombuffer(learned["sums"], float), [size, 2 * size, 2 * size + mixer.map.size])
    assert (sums[1] == used.ravel()).all() and total.sum() == sums[2].sum() == sums[1].sum() / 6 and (sums[3].sum() == ones.sum())
    assert np.allclose(sums[0], (mixer.weights * used).ravel(), rtol=1e-4, atol=1e-4)

    mixer.map = rng.uniform(0.1, 0.9, mixer.map.shape).astype(np.float32)
    rated = passes.run(docs, "score", 16, context_mix.LOOKED.format("long"), passes.model(mixer)).collect()
    ends = [i for i, r in enumerate(rated) if r["n_tokens"]]
    assert [(rated[i]["row"], rated[i]["last"], rated[i]["n_tokens"]) for i in ends] == [(a[0], a[1], len(s)) for a, s in about]
    for begin, end, ((row, last), segment) in zip([0, *[i + 1 for i in ends]], ends, about):
        stream = context_mix.Stream(book, [segment])
        costs = np.add.reduceat(mixer.costs(stream, np.array([not rows[row][2]])), stream.chunks)
        want = {k: w for k, *w in zip(*(c.tolist() for c in context_mix.different_chunks(stream.keys, costs)))}
        chunks = {r["key"]: [r["cost"], r["again"], r["coded"], r["named"]] for r in rated[begin:end] if r["key"] is not None}
        assert chunks.keys() == want.keys() and all(np.allclose(chunks[k], want[k], rtol=1e-4, atol=1e-4) for k in want)
        r = rated[end]
        assert (r["ident"], r["held_out"], r["n_bytes"]) == (row, rows[row][2], sum(map(len, segment)) + len(segment) - last)
        assert r["n_known"] == sum(stream.place % 2 == 0) and r["base"] == stream.place.sum()
        others = collections.Counter(w for w, p in zip(segment, stream.place) if p == len(book.words))
        assert {bytes(r["word"]): r["times"] for r in rated[begin:end] if r["word"] is not None} == others
        assert len(chunks) + len(others) == end - begin and {r["held_out"] for r in rated[begin:end]} == {rows[row][2]}


def test_chunks_by_hand(spark):
    keys, costs = np.array([5, 7, 5, 5]), np.array([-3.0, -9.0, -1.0, -2.0])
    key, cost, again, coded, named = context_mix.different_chunks(keys, costs)
    assert list(key) == [5, 7] and list(cost) == [-3.0, -9.0] and list(again) == [2, 0]
    assert np.allclose(coded, [-3.0, 0.0]) and np.allclose(named, [-2 * math.log10(2), 0.0])
    rng = np.random.default_rng(8)
    rows = [
        (0, int(r), bool(r % 4), int(k), float(-rng.uniform(0, 20)), int(m), float(-5.0 * m), float(-1.0 * m))
        for r in range(200)
        for k, m in {(0, 1), (int(rng.integers(1, 30)), 0), (1000 + r, int(r % 2))}
    ]
    chunks = spark.createDataFrame(rows, "part int, row long, taught boolean, key long, cost double, again long, coded double, named double")
    n = collections.Counter()
    for _, _, taught, k, _, m, _, _ in rows:
        n[k] += taught * (m + 1)
    seen = collections.Counter(r[3] for r in rows)
    copies = sum(v for k, v in n.items() if seen[k] > 1)
    trained, repeats = sum(n.values()), sum(r[5] for r in rows if r[2])
    ways = np.array([copies, repeats, trained - min(trained, copies + repeats)]) + 1
    other, own, fresh = np.log10(ways / ways.sum())
    want = collections.Counter()
    for _, r, taught, k, cost, m, coded, named in rows:
        left = (n[k] if seen[k] > 1 else 0) - taught * (m + 1)
        whole = math.log10(left / trained) + other if left > 0 else -math.inf
        want[r] += max(cost + fresh, whole) + max(coded + m * fresh, named + m * own)
    got = {r["row"]: r["score"] for r in context_mix.whole_chunks(chunks).collect()}
    assert got.keys() == want.keys() and all(got[r] == pytest.approx(want[r]) for r in want)


def test_order_and_copies_count(spark, monkeypatch):
    rng = np.random.default_rng(3)
    follow = {f"w{i}": [f"w{j}" for j in rng.integers(0, 60, 8)] for i in range(60)}

    def text():
        words = [f"w{rng.integers(0, 60)}"]
        while len(words) < 120:
            words.append(follow[words[-1]][rng.integers(0, 8)])
        return words

    texts = [text() for _ in range(300)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(300, " ".join(texts[7]))]
    rows += [(1000 + i, " ".join(rng.permutation(texts[i]))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(context_mix, "TOGETHER", 1000)
    got = {r["doc_id"]: r["score"] for r in score_texts(docs, F.col("doc_id") >= 1000).collect()}
    assert all(got[1000 + i] < 1.2 * got[i] for i in range(20) if i != 7)  # shuffled words are less likely
    plain = np.mean([got[i] for i in range(300) if i != 7])
    assert got[7] > 0.6 * plain and got[300] > 0.6 * plain  # a text that another repeats
    again = {r["doc_id"]: r["score"] for r in score_texts(docs.repartition(2), F.col("doc_id") >= 1000).collect()}
    assert all(again[i] == pytest.approx(got[i], rel=0.05) for i in got)


def test_segments_add_up(spark, monkeypatch):
    monkeypatch.setattr(context_mix, "SEGMENT", 50)
    rows = [(1, " ".join(f"a{i % 30}" for i in range(500))), (2, None), (3, "b c d")]
    got = {r["doc_id"]: r for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False)).collect()}
    assert {i: r["n_tokens"] for i, r in got.items()} == {1: 501, 2: 1, 3: 4}
    assert got[2]["bits_per_byte"] == pytest.approx(-got[2]["score"] * math.log2(10) / 1)
