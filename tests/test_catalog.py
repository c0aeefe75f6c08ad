"""Every registered query beside its SQL, and the shape of the plans."""

import glob
import os
import re

import pytest

import __spark_entry__ as entry_points
import check
from passagework import catalog

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def connection():
    return check.duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, connection, name):
    plans = []
    same, note = check.compare(
        spark, connection, SF, name,
        lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()),
    )
    assert same is True, note
    # No plan multiplies its sides.
    assert "CartesianProduct" not in plans[0] and "NestedLoop" not in plans[0]


def test_every_query_has_sql():
    assert set(catalog.oracles()) == set(NAMES)
    assert set(NAMES) <= set(entry_points.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_entry(spark):
    assert entry_points.entry(spark).count() == 40


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_scans_read_only_what_is_needed(spark):
    query = entry_points.queries()
    plan = query["chunk_stats"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in plan
    plan = query["score_labels"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in plan


def test_no_unbounded_tricks_in_the_library():
    root = os.path.dirname(os.path.abspath(check.__file__))
    for path in glob.glob(f"{root}/passagework/**/*.py", recursive=True):
        with open(path, encoding="utf-8") as f:
            source = f.read()
        assert not re.search(r"localCheckpoint|crossJoin|toPandas\(|\.rdd\.(map|mapPartitions)", source), path
