"""Near-duplicates of texts and of embeddings."""

from __future__ import annotations

import numpy as np
import pytest
import xxhash

from shoal.llm.common import components
from shoal.llm.nn_descent import near_vectors
from shoal.llm import nn_descent, simhash_bk
from shoal.llm.simhash_bk import BKTree, fingerprint, near_duplicates, one_of_each


def brute_components(ids, linked):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, i) for i in range(2001, 2300)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = brute_components({x for p in links if p[0] != p[1] for x in p}, [p for p in links if p[0] != p[1]])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_fingerprint_and_tree():
    words = "A b  c\td É e".encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert fingerprint("A b  c\td É e".encode()) == want
    assert fingerprint(None) == fingerprint(b" \n") == 0
    assert fingerprint(b"One two") == xxhash.xxh64_intdigest(b"one two", 42)
    rng = np.random.default_rng(1)
    values = [int(v) for v in rng.integers(0, 1 << 12, 300)]
    tree = BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert sorted(tree.search(q, 3)) == sorted({v for v in values if (v ^ q).bit_count() <= 3})


@pytest.mark.parametrize("part_rows", [1024, 3])
def test_simhash_links(spark, monkeypatch, part_rows):
    """Shards cut into parts of three rows must give the same classes."""
    monkeypatch.setattr(simhash_bk, "PART_ROWS", part_rows)
    rng = np.random.default_rng(3)
    base = [int(rng.integers(0, 1 << 62)) for _ in range(15)]
    values = sorted({b ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(0, 5)), replace=False)) for b in base for _ in range(25)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = simhash_bk.fingerprint_classes(spark.createDataFrame([(v,) for v in signed], "fingerprint long")).collect()
    want = brute_components(signed, [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3])
    sizes = {}
    for root in want.values():
        sizes[root] = sizes.get(root, 0) + 1
    assert {r["fingerprint"]: r["root"] for r in got} == {v: r for v, r in want.items() if sizes[r] > 1}


def test_near_duplicates_edges(edge_docs, no_docs):
    got = near_duplicates(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["component_id"] == by[2]["component_id"] == 1
    assert {by[i]["component_id"] for i in (3, 4, 5)} == {3} and by[3]["fingerprint"] == "0" * 16
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {None, 3}
    kept = one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 6, 7, 8, 9]
    assert one_of_each(no_docs).count() == 0 == near_duplicates(no_docs).count()


def brute_vectors(rows):
    ok = []
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, np.float64)
        ok.append((i, x / np.linalg.norm(x), label))
    links = [(a[0], b[0]) for k, a in enumerate(ok) for b in ok[:k] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] >= 0.98]
    return links


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        rows.append((i, rng.standard_normal(16).tolist(), int(i % 3)))
    centre = rng.standard_normal(16)
    for i in range(300, 400):  # a dense class that fills every list
        rows.append((i, (centre + 0.05 * rng.standard_normal(16)).tolist(), 1))
    for i in range(400, 440):  # near copies of single vectors, and equal ones
        rows.append((i, (np.array(rows[i - 400][1]) * (1.0 if i % 2 else 1.001)).tolist(), rows[i - 400][2]))
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] + [1.0] * 15, 1), (503, [None] + [1.0] * 15, 1), (504, rows[0][1], None)]
    rows += [(505, [1.0, 2.0], 1), (506, [2.0, 4.0], 1), (None, rows[0][1], 0), (507, [], 1)]
    links = brute_vectors(rows)
    frame = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<double>, label int, id string, v double").repartition(4)
    got = near_vectors(frame).collect()
    assert len(got) == len(rows)
    want = brute_components({r[0] for r in rows if r[0] is not None}, links)
    degree = {}
    for a, b in links:
        degree[a] = degree.get(a, 0) + 1
        degree[b] = degree.get(b, 0) + 1
    for r in got:
        if r["vec_id"] is None:
            assert r["n_links"] == 0
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (degree.get(r["vec_id"], 0), want[r["vec_id"]], want[r["vec_id"]] == r["vec_id"])


def same_as_brute_force(spark, rows):
    links = brute_vectors(rows)
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).collect()
    want = brute_components({r[0] for r in rows}, links)
    degree = {r[0]: 0 for r in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (degree[i], want[i], want[i] == i) for i in degree}


def bundles(cross, members=12, width=64):
    """Two bundles of vectors; inside of each all lists are full, between them cosines are near `cross`."""
    rng = np.random.default_rng(8)
    a, b = np.linalg.qr(rng.standard_normal((width, 2)))[0].T
    centres = [a, cross * a + np.sqrt(1 - cross * cross) * b]
    near = [c + 0.02 / np.sqrt(width) * rng.standard_normal(width) for c in centres for _ in range(members)]
    return [v.tolist() for v in near]


@pytest.mark.parametrize("whole", [1024, 0])
def test_links_between_full_lists(spark, monkeypatch, whole):
    """Each bundle fills its own members' lists, so links between the bundles are in no list."""
    monkeypatch.setattr(nn_descent, "WHOLE", whole, raising=False)
    rng = np.random.default_rng(9)
    rows = [(i, v, 1) for i, v in enumerate(bundles(0.985) + bundles(0.5, 300))]
    rows += [(1000 + i, rng.standard_normal(64).tolist(), 1 + i % 2) for i in range(200)]
    same_as_brute_force(spark, rows)


def test_small_label_beside_a_large_one(spark, monkeypatch):
    """Leaves as deep as the large label's would part the small label's pairs."""
    monkeypatch.setattr(nn_descent, "LEAF", 2)
    rng = np.random.default_rng(10)
    rows = [(i, rng.standard_normal(32).tolist(), 1) for i in range(3000)]
    for i in range(3000, 3200, 2):
        v = rng.standard_normal(32)
        rows += [(i, v.tolist(), 2), (i + 1, (v + 0.18 * rng.standard_normal(32)).tolist(), 2)]
    want = {a for pair in brute_vectors(rows[3000:]) for a in pair}
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)).where("n_links > 0").collect()
    assert len(want) > 100 and {r["vec_id"] for r in got} == want


def test_audit_fails_aloud(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "WHOLE", 0)
    monkeypatch.setattr(nn_descent, "gathered", lambda unit, links, threshold: (spark.createDataFrame([], "id long, n long"), links))
    rows = spark.createDataFrame([(i, v, 1) for i, v in enumerate(bundles(0.985))], "vec_id long, embedding array<double>, label int")
    with pytest.raises(RuntimeError, match="too few"):
        near_vectors(rows)


def test_vectors_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert near_vectors(empty).count() == 0
