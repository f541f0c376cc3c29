"""What the planner makes of the queries: scans pruned, nothing crossed, no Python, few shuffles."""

import re

import pytest

from tallyframe.catalog import QUERIES, Inputs
from tallyframe.fixtures import derived
from tallyframe.plans import division_tables, party_tables, tcp_places, vote_type_tables
from tallyframe.sources import store



def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUERIES)
def test_no_cross_join_and_no_python(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](Inputs(spark, sf_dir)))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas", "SinglePartition"):
        assert operator not in plan, plan


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("stored"))
    store.write_tables({"cand": derived.cand(spark, sf_dir)}, root)
    return store.read_tables(spark, root, ("cand",))["cand"]


@pytest.mark.parametrize(
    ("query", "shuffles"),
    [
        (vote_type_tables.div_votes_by_type, 2),
        (division_tables.div_table, 2),
        (division_tables.div_table_informal, 2),
        (division_tables.div_tcp_percent, 2),
        (party_tables.pp_party_groups, 1),
        (party_tables.pp_by_party, 1),
        (party_tables.pp_by_party_percent, 1),
        (tcp_places.div_pp_tcp, 1),
        (lambda cand: tcp_places.pp_tcp_swing(cand, 2013, 2016), 2),
    ],
)
def test_shuffles_over_a_stored_table(spark, stored, query, shuffles):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(query(stored))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == shuffles


def test_scan_reads_only_what_the_query_needs(stored):
    plan = plan_of(vote_type_tables.div_votes_by_type(stored, elections=[2016], divisions=["NATION_1"]))
    read = [{c.split(":")[0] for c in schema.split(",")} for schema in re.findall(r"ReadSchema: struct<([^>]*)", plan)]
    names = {"division_nm"}  # are looked for in a subquery
    assert {"state_ab", "division_id", "division_nm", "polling_place", "votes", "type", "early"} in read
    assert all(columns == names or len(columns) == 7 for columns in read)
    assert "EqualTo(division_nm,NATION_1)" in plan
    assert re.search(r"PartitionFilters: \[[^\]]*election#\d+ = 2016", plan)


def test_every_order_counts(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg({"l_quantity": "sum"}).first()[0]
    assert derived.cand(spark, sf_dir).agg({"votes": "sum"}).first()[0] == lines


def test_a_division_lies_in_few_files(spark, sf_dir, tmp_path):
    settings = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.shuffle.partitions": "64",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4k",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        store.write_tables({"cand": derived.cand(spark, sf_dir)}, str(tmp_path))
    finally:
        for key in settings:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    files = (
        store.read_tables(spark, str(tmp_path), ("cand",))["cand"].where("election = 2016")
        .selectExpr("division_nm", "_metadata.file_path AS file").distinct().collect()
    )
    assert len({r.file for r in files}) >= 6
    one = files[0].division_nm
    assert len({r.file for r in files if r.division_nm == one}) <= 2
