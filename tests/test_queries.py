"""Every registered query against its SQL twin at the smallest scale."""

import os

import pytest

from __spark_entry__ import entry
from authloom.workload.oracles import ORACLES
from authloom.workload.queries import QUERIES
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, got, want, diff, _, _ = compare(spark, con, QUERIES[name], ORACLES[name], SF)
    assert ok is True, diff
    assert got > 0


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "final_conclusion" in df.columns


def test_normalized_union_makes_only_what_it_counts(spark, tmp_path):
    """Evidence and alerts aren't stored for four columns of them; with both stored the counts are the same."""
    from authloom.workload import tables

    sf = str(tmp_path)
    spark.range(400).selectExpr(
        "id AS event_id", "id % 7 AS user_id", "timestamp_seconds(1704067200 + id * 600) AS ts", "'login' AS event_type",
        "1.0D AS value").write.parquet(f"{sf}/events.parquet")
    counts = lambda: sorted(map(tuple, QUERIES["normalized_union"](spark, sf).collect()), key=repr)
    has = lambda name: (spark.sparkContext.applicationId, sf, name) in tables._STORED
    alone = counts()
    assert not has("evidence") and not has("alerts")
    found, alerts = tables.chain(spark, sf)[2], tables.alerts(spark, sf)
    assert has("evidence") and has("alerts") and found.count() > 0
    assert counts() == alone and sum(r[-1] for r in alone) == found.count() + alerts.count()
