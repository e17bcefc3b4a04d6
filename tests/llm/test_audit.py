"""The filter interaction audit and its tries."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from shoal.llm import trie_audit
from shoal.llm.queries import table
from shoal.llm.trie_audit import Trie, audit, masks, shared_length, with_adaptive_prefix, with_prefix_hashes
from shoal.session import stage

BITS = dict(zip("ABCDE", (1, 2, 4, 8, 16)))


def brute_masks(docs):
    least, all_ids = {}, defaultdict(list)
    for ident, text, _ in docs:
        all_ids[text or ""].append(ident)
    for text, ids in all_ids.items():
        least[text] = min((i for i in ids if i is not None), default=None)
    out = []
    for ident, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        first = least[text]
        duplicate = first is not None and (ident is None or ident > first)
        fails = (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            bool(re.search("[#$%&*|]", text)), duplicate,
        )
        out.append((ident, part or "", sum(1 << k for k, f in enumerate(fails) if f)))
    return out


def brute_audit(docs, labels):
    marked, rows = brute_masks(docs), []
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    for part in {p for _, p, _ in marked}:
        shapley, steps = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            alive = [(i, m) for i, p, m in marked if p == part]
            gone = []
            for step, letter in enumerate(order, 1):
                bit = BITS[letter]
                out = [(i, m) for i, m in alive if m & bit]
                redundant = sum(1 for _, m in gone if m & bit)
                unique = sum(1 for _, p, m in marked if p == part and m == bit)
                alive = [(i, m) for i, m in alive if not m & bit]
                gone += out
                shapley[letter] += len(out)
                lost = [sum(1 for i, _ in out if i in s) for s in (good, bad)]
                steps.append((part, order, step, len(alive), len(out), redundant, unique, *lost))
        rows += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return sorted(rows)


def tuples(df):
    names = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_shared_length():
    for a, b in ((b"", b""), (b"", b"a"), (b"abc", b"abd"), (b"abc", b"abc"), (b"x" * 1000 + b"a", b"x" * 1000 + b"bb")):
        assert shared_length(a, b) == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_trie_holds_each_text_once():
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("aab"), int(rng.integers(0, 9)))).encode() for _ in range(600)]
    trie, losers = Trie(), []
    for i, text in zip(rng.permutation(600).tolist(), texts):
        losers += trie.insert(text, i, (), 1)
    held = list(trie.terminals())
    assert [t for t, _, _ in held] == sorted(set(texts))  # in order, compressed or not
    assert len(held) + len(losers) == 600
    depth, pending = 0, [(trie.root, 0)]
    while pending:
        node, d = pending.pop()
        depth = max(depth, d)
        assert node is trie.root or node.held is not None or len(node.children) > 1  # paths are compressed
        pending += [(c, d + 1) for c in node.children.values()]
    assert depth <= 9


def test_audit_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = ["", None, "A", "one two", "w " * 250, "word # " * 30, "SHOUT " * 220, " ".join(f"w{i}" for i in range(300))]
    base += ["boiler plate " * 40 + f"end {i}" for i in range(40)] + ["boiler plate " * 40]
    docs = [(int(rng.integers(0, 300)) if rng.random() > 0.05 else None, base[int(rng.integers(0, len(base)))],
             [None, "", "en", "de"][int(rng.integers(0, 4))]) for _ in range(500)]
    labels = [(int(rng.integers(0, 320)), int(rng.integers(0, 2)), int(rng.integers(0, 2))) for _ in range(200)] + [(None, 1, 1), (5, None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute_audit(docs, labels)
    assert tuples(audit(frame, said)) == want
    monkeypatch.setattr(trie_audit, "HELD_BYTES", 2000)  # tries that are emptied again and again
    assert tuples(audit(frame, said)) == want


def test_prefixes_part_texts_that_begin_alike(spark):
    rows = [(("the same long beginning of all texts " * 20 + f"and {i:05d}").encode(),) for i in range(3000)] + [(b"whole",)] * 2000
    dealt = with_adaptive_prefix(stage(with_prefix_hashes(spark.createDataFrame(rows, "body binary")), "rows"))
    assert dealt.count() == 5000
    groups = dealt.groupBy("head", "prefix").agg(F.count("*").alias("n"), F.countDistinct("body").alias("kinds"), F.sum(F.octet_length("body")).alias("b")).collect()
    total = sum(len(b) for b, in rows)
    assert all(g["b"] <= total / 8 or g["kinds"] == 1 for g in groups)
    assert dealt.select("body", "head", "prefix").distinct().count() == 3001


def test_rows_of_one_text_leave_a_task_once(spark):
    docs = spark.range(0, 4000, 1, 4).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"))
    got = masks(docs, [], F.lit("p")).collect()
    assert sum(r["n"] for r in got) == 4000
    assert [r["ident"] for r in got if not r["mask"]] == [0]


def test_other_filters(spark):
    docs = spark.createDataFrame([(1, "aa", "x"), (2, "b", "x"), (3, "aa", "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    got = audit(docs, labels, filters={"X": lambda body, words: len(body) > 1}).collect()
    found = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["good_lost"]) for r in got}
    assert found == {("XE", 1): (1, 2, 0, 1), ("XE", 2): (1, 0, 1, 0), ("EX", 1): (2, 1, 0, 1), ("EX", 2): (1, 1, 1, 0)}


def test_audit_edges(spark, edge_docs, no_docs):
    labels = table(spark, "/root/testdata/sf0.001", "labels")
    got = audit(edge_docs, labels)
    docs = [tuple(r) for r in edge_docs.select("doc_id", "text", "lang").collect()]
    assert tuples(got) == brute_audit(docs, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert audit(no_docs, labels).count() == 0
    assert tuples(audit(edge_docs, labels.limit(0)))[0][7:9] == (0, 0)
