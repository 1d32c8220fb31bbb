"""Every query with SQL, against DuckDB; every other one runs and gives rows."""

import pytest
from compare import connect, rows

from tessera import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["scan_partition", "consensus_map", "partitioned_trees", "routed_predictions", "tree_rules", "tree_nodes", "partition_tree", "two_layer"])
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
