"""The learned rank index and the fill-in-middle transformation."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoal.llm.queries import table
from shoal.llm.rank_index import Sentinels, boundaries, boundary_index, fill_in_middle, fim_digest, fit_index, offset_at, restored


def brute(ident, text):
    units = re.findall(r"[^\n]*\n|[^\n]+", text or "")
    digest = hashlib.sha256(f"7:{'' if ident is None else ident}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text or ""
    if h[3] % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("error", [0, 1, 16, 127])
def test_index_is_exact_and_within_its_error(error):
    rng = np.random.default_rng(error)
    for case in range(40):
        widths = rng.integers(1, 2 + 10 ** rng.integers(0, 4), size=rng.integers(0, 700))
        if case % 5 == 0:  # a jump in an even run
            widths = np.r_[np.full(200, 40), 10**7, np.full(200, 40)]
        offsets = np.r_[0, np.cumsum(widths)].astype(np.int64)
        index = fit_index(offsets, error)
        ranks = np.arange(len(offsets))
        assert (index.lookup(ranks) == offsets).all()
        assert abs(index.residual.astype(int)).max() <= error
        assert (np.diff(index.rank) > 0).all() and index.rank[0] == 0
    even = fit_index(np.arange(0, 10**6, 50), error)
    assert len(even.rank) == 1  # equal units are one segment


def test_boundaries():
    for text in ("", "a", "\n", "a\n", "a\nb", "\n\n", "é\n𝒳𝒳\r\n x", "a b\n"):
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        assert boundaries(text).tolist() == np.r_[0, np.cumsum([len(u) for u in units])].astype(int).tolist()


def test_against_brute_force(spark, edge_docs):
    texts = [
        None, "", "\n", "\n\n\n", "one line", "a\nb\nc\n", "a\r\nb\r\n", "ends <P", "has <S> in it\nb", "é𝒳\n𝒳\né" * 50,
        "<\n<\n<P\n>\nS>\n<M" * 3, "\n".join("x" * (i * i % 301) for i in range(900)), "\u0085 \nq",
    ]
    rows = [(i, t) for i in (0, 7, 12345, 2**40, -3, None) for t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(edge_docs.select("doc_id", "text"))
    expected = sorted((r, brute(*r)) for r in map(tuple, docs.collect()) if r[0] is not None and r[1] is not None)
    got = fill_in_middle(docs.where("doc_id IS NOT NULL AND text IS NOT NULL"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((r[0], *b) for r, b in expected)
    digests = fim_digest(docs).collect()
    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()

    want = sorted(((i, *brute(i, t)[:4], sha(brute(i, t)[4]), sha(t or "")) for i, t in map(tuple, docs.collect())), key=str)
    assert sorted(map(tuple, digests), key=str) == want


def test_other_cuts_from_the_index_alone(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    index = boundary_index(docs)
    ranks = (F.lit(0), F.floor(F.col("n") / 3).cast("long"), F.floor(F.col("n") / 2).cast("long"), F.col("n"))
    got = index.select("doc_id", *[offset_at(r).alias(f"o{k}") for k, r in enumerate(ranks)], "n").collect()
    texts = dict(docs.select("doc_id", "text").collect())
    for r in got:
        ends = boundaries(texts[r["doc_id"]])
        assert [r["o0"], r["o1"], r["o2"], r["o3"]] == ends[[0, r["n"] // 3, r["n"] // 2, r["n"]]].tolist()


def test_rates_and_sentinels(spark):
    docs = spark.createDataFrame([(i, f"a{i}\nb\nc") for i in range(400)], "doc_id long, text string")
    marks = Sentinels("[pre]", "[suf]", "[mid]")
    made = fill_in_middle(docs, rate=50, spm_rate=20, seed=3, marks=marks)
    shares = {r["form"]: r["count"] / 400 for r in made.groupBy("form").count().collect()}
    assert 0.4 < shares["plain"] < 0.6 and shares["spm"] < shares["psm"]
    back = made.join(docs, "doc_id").where(restored(F.col("output"), F.col("form"), marks) != F.col("text"))
    assert back.count() == 0
    for bad in (Sentinels("<a", "a<", "<b"), Sentinels("", "x", "y"), Sentinels("<<", "<<<", "y")):
        with pytest.raises(ValueError):
            fill_in_middle(docs, marks=bad)


def test_fim_edges(edge_docs, no_docs):
    assert fim_digest(edge_docs).count() == edge_docs.count()
    assert fim_digest(no_docs).count() == 0 and boundary_index(no_docs).count() == 0
