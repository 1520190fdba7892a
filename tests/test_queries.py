"""Each query of the engine beside its SQL, in a session without settings, on the smallest tables."""

import pytest

import bench
from oracle_check import compare, connect
from recordloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_is_its_sql(spark, con, name):
    assert compare(spark, con, catalog.queries()[name], catalog.oracle_sql()[name], SF) == ""


def test_benchmark_names_queries():
    assert set(bench.HEADLINE) <= set(catalog.queries())


def test_shared_sets_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    """A task's share doesn't grow with the tables: adaptive execution doesn't join the partitions that rows are dealt to."""
    monkeypatch.setattr(catalog, "ROWS", 10)
    spark.range(40).selectExpr("id AS o_orderkey", "id div 4 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(120).selectExpr("id div 3 AS l_orderkey", "IF(id % 3 = 0, 7, id) AS l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.agg12_shared_set(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(c, 7) for c in range(10)] and got.rdd.getNumPartitions() == 13
