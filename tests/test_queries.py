"""Every query with SQL against DuckDB; those of optional packages too, where they are there."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables here")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert differences(spark, QUERIES[name], SQL[name], FOLDER, con) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_with_unique_columns(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert len(set(df.columns)) == len(df.columns) and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() == 100


def test_partitioning_does_not_change_results(spark):
    for name in ("snk_5", "win_3", "sft_5", "eval_11", "tel_2"):
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = sorted(map(tuple, QUERIES[name](spark, FOLDER).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert sorted(map(tuple, QUERIES[name](spark, FOLDER).collect())) == one
    spark.conf.set("spark.sql.shuffle.partitions", "4")
