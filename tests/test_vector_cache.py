"""Vectors looked up by content."""

from __future__ import annotations

import numpy as np
import pytest

from shoal.operators.embed import HashingEmbedder
from shoal.plans.vector_cache import embed_cached
from shoal.sources import store


def only(*allowed):
    """Embeds some texts and fails at any other, and at a text that comes twice."""

    class Only(HashingEmbedder):  # local, so that it travels to the workers by value
        def embed(self, texts):
            if set(texts) - set(allowed) or len(set(texts)) < len(texts):
                raise ValueError(f"not to be embedded: {texts}")
            return super().embed(texts)

    return Only(16)


def test_each_text_is_embedded_once(spark, tmp_path):
    cache = str(tmp_path / "cache")
    rows = [(1, "a b"), (2, "a b"), (3, None), (4, "c"), (5, "")] + [(i, "a b") for i in range(10, 60)]
    frame = spark.createDataFrame(rows, "id long, document string").repartition(4)
    got = {r.id: r.embedding for r in embed_cached(frame, only("a b", "c", ""), cache, "m").collect()}
    direct = dict(zip(("a b", "c", ""), HashingEmbedder(16).embed(["a b", "c", ""])))
    assert set(got) == {i for i, _ in rows} and got[3] is None
    assert all(np.allclose(got[i], direct[t]) for i, t in rows if t is not None)
    # what is held is looked up, also by other rows; only the new text is embedded
    more = spark.createDataFrame([(1, "c"), (2, "d"), (3, "a b")], "id long, document string")
    again = {r.id: r.embedding for r in embed_cached(more, only("d"), cache, "m").collect()}
    assert np.allclose(again[1], direct["c"]) and np.allclose(again[3], direct["a b"]) and again[2] is not None
    assert store.current_records(spark, cache).count() == 4
    # another model has vectors of its own
    with pytest.raises(Exception, match="not to be embedded"):
        embed_cached(more, only("d"), cache, "other").collect()


def test_nothing_to_embed(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, document string, embedding array<float>")
    got = embed_cached(empty, only(), str(tmp_path / "cache"), "m")
    assert got.columns == ["id", "document", "embedding"] and got.count() == 0
    nulls = spark.createDataFrame([(1, None)], "id long, document string")
    assert embed_cached(nulls, only(), str(tmp_path / "cache"), "m").collect() == [(1, None, None)]
