"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from oracle_check import differences
from plan import simple
from shoal.plans.oracles import ORACLES
from shoal.plans.queries import QUERIES

TABLES = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert differences(spark, TABLES, name) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.queries()) >= set(QUERIES) and set(entry.oracle_sql()) >= set(ORACLES)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="test tables are not here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="test tables are not here")
@pytest.mark.parametrize("name", ["import_records", "upsert_records", "resolve_or_uuid", "knn_l2", "blocked_knn", "text_query"])
def test_no_query_forms_all_pairs(spark, name):
    plan = simple(entry.queries()[name](spark, TABLES))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
