from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from plan import simple
from shoal import session


class Unset:
    """A session whose configuration names no shared folder."""

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return default

    def __init__(self, master):
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-" + master})


def test_shared_dir_is_the_configured_one(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_local_fallback_and_none_on_a_cluster():
    local = session.shared_dir(Unset("local[2]"))
    assert os.path.isdir(local) and session.shared_dir(Unset("local[2]")) == local
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Unset("spark://host:7077"))


def test_stage_and_clear(spark):
    staged = session.stage(spark.range(10).withColumn("v", F.parse_json(F.lit('{"a":1}'))), "test")
    assert staged.count() == 10 and staged.schema["v"].dataType.simpleString() == "variant"
    (path,) = {f.rsplit("/", 1)[0].removeprefix("file://") for f in staged.inputFiles()}
    session.clear_scratch(spark)
    assert not os.path.exists(path)


def test_scratch_has_an_owner(spark):
    def exists(df):
        return os.path.exists(df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://"))

    outside = session.stage(spark.range(3), "outside")
    with session.Scratch(spark):
        outer = session.stage(spark.range(3), "outer")
        with session.Scratch(spark):
            inner = session.stage(spark.range(3), "inner")
            assert exists(inner) and exists(outer)
        assert not exists(inner) and exists(outer)
    assert not exists(outer) and exists(outside)
    kept = session.Scratch(spark)
    with kept.open():
        later = session.stage(spark.range(3), "later")
    assert exists(later)
    kept.close()
    assert not exists(later)
    session.drop_scratch(spark, outside.inputFiles()[0].rsplit("/", 1)[0])
    assert not exists(outside)


def test_spread_moves_small_scans_only(spark, tmp_path, monkeypatch):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    assert "Exchange" in simple(session.spread(scan)) and session.spread(scan).count() == 100
    monkeypatch.setattr(session, "SPREAD_TASKS", 1)
    assert "Exchange" not in simple(session.spread(scan))
