"""Personal data: base spans against brute force, the trees on sentences they have not seen, long texts."""

from __future__ import annotations

import hashlib
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoal.llm.boosted_pii import (
    FEATURES, KINDS, _applied, account_check, boost, candidates, detect, features, fit_detector, luhn, pii_digest, redacted,
)
from shoal.llm.queries import QUERIES, table
from shoal.llm.spans import apart, found, running

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def passes(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute_base(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (
                True, kind != 1 or all(int(p) <= 255 for p in m[0].split(".")), kind != 2 or (12 <= len(digits) <= 19 and passes(digits)),
                kind != 3 or 9 <= len(digits) <= 15,
            )
            if all(ok):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def written(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


EDGE = [
    "a@b.c_d@e.f %x@y.z a@b..c aaa@bbb@c.d.e-.f @x.y x@y é@b.co 𝒳me@it.io, me@it.io.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.003.255 1.2.3 .1.2.3.4. 1..2.3.4.5",
    "4111 1111 1111 1111 4111-1111-1111-1111 41111111 11111111 4111  1111 1111 1111 1 2 3 4 5 6 7 8 9 0 1 2", "x4111111111111111y 41111111111111111111111 4111 1111 1111 1112",
    "+1 (489) 555-0950 +49..30 +1-2-3-4-5-6-7-8-9 +12345678 +1234567890123456 +1 ( ) +1( 2+3 4567 89012 34)", "+1 800 555 0199 4111111111111111 1.2.3.4@x.y 10.0.0.1",
    "", None, "5", "+", "@", "12-34 56-78 90-12 34", "é1.1.1.1é @@@a@b.c", "0" * 16 + " " + "0" * 12,
]


def test_base_against_brute_force(spark):
    rng = np.random.default_rng(3)
    pieces = np.array(list("0123456789....----  ++()@ab_é%") + ["1.2.3.4", "@b.c", "4111 1111", "+1 (", "255.", "\n"])
    texts = EDGE + ["".join(rng.choice(pieces, int(rng.integers(1, 80)))) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in pii_digest(docs).collect()}
    for i, text in enumerate(texts):
        base = brute_base(text)
        assert [got[i][f"n_{k}"] for k in KINDS[:4]] == [sum(s[1] == n for s in base) for n in range(4)], text
        assert got[i]["base_sha256"] == hashlib.sha256(written(base).encode()).hexdigest()
        spans = [s for s in got[i]["spans"].split(",") if s]
        assert set(written(base).split(",") if base else ()) <= set(spans)


def test_given_documents_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = {r["doc_id"]: (r["base_sha256"], r["spans"]) for r in QUERIES["op11_boosted_pii"](spark, "/root/testdata/sf0.001").collect()}
    for i, text in docs.select("doc_id", "text").collect():
        base = written(brute_base(text))
        assert got[i] == (hashlib.sha256(base.encode()).hexdigest(), base)  # nothing is added to invented prose


def test_checks(spark):
    numbers = ["4111111111111111", "4111111111111112", "0", "18", "79927398713", "79927398710"]
    accounts = ["DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    rows = spark.createDataFrame([(n,) for n in numbers], "t string").select(luhn(F.col("t"))).collect()
    assert [r[0] for r in rows] == [passes(n) for n in numbers]
    assert [r[0] for r in spark.createDataFrame([(a,) for a in accounts], "t string").select(account_check(F.col("t"))).collect()] == [True, False, True]


UNSEEN = [
    ("please phone my aunt under 0331 778 4512 before noon", "phone", "0331 778 4512"),
    ("our new telephone: (415) 555-2671", "phone", "(415) 555-2671"),
    ("you may mail peter.pan [at] neverland [dot] org", "email", "peter.pan [at] neverland [dot] org"),
    ("send an e-mail to anna at example dot com", "email", "anna at example dot com"),
    ("pay with visa 5105.1051.0510.5100 please", "card", "5105.1051.0510.5100"),
    ("the form asks for the ssn 219-09-9999 again", "natid", "219-09-9999"),
    ("IBAN: DE89 3704 0044 0532 0130 00", "account", "DE89 3704 0044 0532 0130 00"),
    ("the ip address 2001:db8:85a3:0:0:8a2e:370:7334 of the host", "ip", "2001:db8:85a3:0:0:8a2e:370:7334"),
]
CLEAN = [
    "order 331-7784512 left the depot", "ISBN 978-3-1614-8410-0 is a book", "it happened on 2021-03-04 and 04.03.2021", "version 10.2.31 of the tool",
    "the price was $ 1200-1500 in 1999-2003", "mac 00:1b:44:11:3a:b7 seen", "look at the house dot by dot", "commit 25a0bc4376e17c8019a0b1c2d3e4f50617283940 is bad",
    "they scored 10-12 against 11-13 and 21-19", "page 120-125, table 3.4.5", "we met at noon. Then left", "token = \"2588243963847068548461485475\"",
]


def test_sentences_not_seen(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([u[0] for u in UNSEEN] + CLEAN)], "doc_id long, text string")
    model = fit_detector(table(spark, "/root/testdata/sf0.001", "documents"))
    assert set(model.thresholds) == set(KINDS) and min(p for p, _ in model.quality.values()) >= 0.95
    got = {r["doc_id"]: [(KINDS[s["kind"]], UNSEEN[r["doc_id"]][0][s["start"] : s["end"]] if r["doc_id"] < len(UNSEEN) else s["start"]) for s in r["added"]]
           for r in detect(docs, model).collect()}
    caught = sum((kind, span) in got[i] for i, (_, kind, span) in enumerate(UNSEEN))
    assert caught >= 7, got
    assert sum(bool(got[len(UNSEEN) + i]) for i in range(len(CLEAN))) <= 1, got
    again = fit_detector(table(spark, "/root/testdata/sf0.001", "documents").repartition(5))
    assert again == model


def test_trees_as_columns(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 9, size=(400, len(FEATURES)))
    x[:, 0] = rng.integers(0, 2, 400)
    y = ((x[:, 1] > 4) & (x[:, 3] < 6)).astype(float)
    model = boost(x, y, np.ones(400), np.arange(400) % 3 == 0)
    margin = sum(_applied(t, x) for t in model.trees)
    p = 1 / (1 + np.exp(-(model.slope * margin + model.shift)))
    assert ((p > 0.5) == (y > 0)).mean() > 0.97
    rows = spark.createDataFrame([(i, tuple(r)) for i, r in enumerate(x.tolist())], f"i int, x struct<{','.join(f'{f}:int' for f in FEATURES)}>")
    got = dict(rows.select("i", model.probability(F.col("x")).alias("p")).collect())
    assert max(abs(got[i] - p[i]) for i in range(400)) < 1e-9
    nothing = boost(x[:0], y[:0], np.ones(0), np.zeros(0, bool))
    assert nothing.trees == [] and nothing.thresholds == {}


def test_features_are_small_numbers(spark):
    text = "my card 4111.1111.1111.1111! tel (030) 123-4567"
    rows = spark.createDataFrame([(text,)], "body string").select(F.explode(candidates(F.col("body"))).alias("c")).select("c.match", features(F.col("c")).alias("x"))
    got = {r["match"]: r["x"] for r in rows.collect()}
    card = got["4111.1111.1111.1111"]
    assert (card["digits"], card["groups"], card["checked"], card["separator"], card["card_words"]) == (16, 4, 1, 3, 1)
    assert (got["(030) 123-4567"]["lead"], got["(030) 123-4567"]["phone_words"], got["(030) 123-4567"]["separator"]) == (1, 1, 5)


def test_running_and_apart(spark):
    rng = np.random.default_rng(1)
    lists = [rng.integers(0, 50, n).tolist() for n in (0, 1, 63, 64, 65, 200, 5000)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<int>")
    got = rows.select("i", running(F.col("v"), lambda a, b: a + b).alias("s"), running(F.col("v"), lambda a, b: F.greatest(a, b)).alias("m")).collect()
    for r in got:
        assert r["s"] == np.cumsum(lists[r["i"]], dtype=int).tolist() and r["m"] == np.maximum.accumulate(np.array(lists[r["i"]], int)).tolist()
    cases = []
    for _ in range(200):
        mine, others = ([(int(a), int(a + rng.integers(1, 9))) for a in rng.integers(0, 60, rng.integers(0, 9))] for _ in range(2))
        cases.append((mine, others))
    kind = "array<struct<start:int,end:int>>"
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i int, a {kind}, b {kind}")
    for r in frame.select("i", apart(F.col("a"), F.col("b")).alias("k")).collect():
        mine, others = cases[r["i"]]
        assert sorted(map(tuple, r["k"])) == sorted(s for s in mine if not any(s[0] < o[1] and o[0] < s[1] for o in others))


def test_found_context(spark):
    text = "ab12cd𝒳34é" * 90
    hits = spark.createDataFrame([(text,)], "t string").select(F.explode(found(F.col("t"), "[0-9]+", 3)).alias("h")).select("h.*").collect()
    want = [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", text)]
    assert [(h["start"], h["end"], h["match"]) for h in hits] == want
    assert (hits[0]["before"], hits[0]["after"], hits[1]["before"]) == ("ab", "cd𝒳", "cd𝒳")


def test_redaction(spark):
    text = "x me@it.io 1.2.3.4 yé"
    kind = "array<struct<start:int,kind:int,end:int>>"
    cases = [([(2, 0, 10), (11, 1, 18)], "x <EMAIL> <IP> yé"), ([], text), ([(0, 0, 21)], "<EMAIL>"), ([(2, 0, 12), (11, 1, 18), (14, 2, 16)], "x <EMAIL> yé")]
    rows = spark.createDataFrame([(text, s, w) for s, w in cases], f"t string, s {kind}, w string")
    assert [r[0] for r in rows.select(redacted(F.col("t"), F.col("s")) == F.col("w")).collect()] == [True] * len(cases)


@pytest.mark.parametrize("piece", ["+1 (489) 555-0950 ", "4111.1111.1111.1111 ", "a@b.cd ", "1 ", "+", "9", "a.", "at dot "])
def test_long_texts(spark, piece):
    model = boost(np.zeros((0, len(FEATURES)), int), np.zeros(0), np.zeros(0), np.zeros(0, bool))
    short, long = (piece * (n // len(piece)) for n in (6_000, 400_000))
    count = F.size("base").alias("n")
    small = detect(spark.createDataFrame([(1, short)], "doc_id long, text string"), model).select(count).first()["n"]
    assert small == len(brute_base(short))
    began = time.time()
    large = detect(spark.createDataFrame([(1, long)], "doc_id long, text string"), model).select(count).first()["n"]
    assert large >= small and time.time() - began < 40


def test_pii_edges(edge_docs, no_docs):
    got = pii_digest(edge_docs)
    assert got.count() == edge_docs.count()
    assert pii_digest(no_docs).count() == 0
