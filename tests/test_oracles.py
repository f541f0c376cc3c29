"""Every query of the catalog against its SQL, on the given tables and on badly skewed ones."""

import duckdb
import pytest

import compare
from __spark_entry__ import entry, oracle_sql, queries
from tallyframe import catalog
from tallyframe.fixtures import derived
from tallyframe.fixtures.oracle import ORACLES

QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return compare.connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_holds_every_query():
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, connection, name):
    assert compare.spark_result(QUERIES[name](spark, sf_dir)) == compare.oracle_result(connection, ORACLES[name])


@pytest.fixture(scope="module")
def skewed_dir(tmp_path_factory, sf_dir):
    """The given tables with a third of all lines on one order, a third of all orders on one customer and a third
    of all customers in one nation."""
    target = tmp_path_factory.mktemp("skewed")
    connection = duckdb.connect()
    changes = {
        "lineitem": "REPLACE (CASE WHEN hash(l_orderkey, l_partkey) % 3 = 0 THEN 17 ELSE l_orderkey END AS l_orderkey)",
        "orders": "REPLACE (CASE WHEN o_orderkey % 3 = 2 THEN 5 ELSE o_custkey END AS o_custkey)",
        "customer": "REPLACE (CASE WHEN c_custkey % 3 = 0 THEN 4 ELSE c_nationkey END AS c_nationkey)",
        "nation": "", "region": "",
    }
    for table, change in changes.items():
        connection.execute(
            f"COPY (SELECT * {change} FROM '{sf_dir}/{table}.parquet') TO '{target}/{table}.parquet' (ROW_GROUP_SIZE 2048)"
        )
    return str(target)


SKEWED = ["div_table", "div_summary", "div_pp_tcp", "pp_by_party_percent", "pp_party_groups", "build_cand", "rollup_geo",
          "pp_distance", "pp_tcp_swing_alp", "nat_primary_by_year_pct"]


@pytest.fixture
def shuffling(spark):
    """Small partitions and no broadcasts, so that joins shuffle and adaptive execution splits the hot keys."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


@pytest.mark.parametrize("name", SKEWED)
def test_query_on_skewed_tables(spark, skewed_dir, shuffling, name):
    found = compare.spark_result(QUERIES[name](spark, skewed_dir))
    assert found == compare.oracle_result(compare.connect(skewed_dir), ORACLES[name])


def test_hot_keys_of_joins_are_split(spark, skewed_dir, shuffling):
    # Several map tasks, as any large table has; one map's output cannot be split.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        table = derived.cand(spark, skewed_dir)
        table.collect()
        assert "skew=true" in table._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
