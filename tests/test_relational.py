"""Joins, shares and filters on hot and missing keys."""

import random

import pytest
from pyspark.sql import functions as F

import tallyframe as tf
from frames import cand_table
from tallyframe.operators.relational import full_join, restrict, share_of_total
from tallyframe.sources import store

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.enabled": "false",
}


@pytest.fixture
def plain(spark):
    """Neither broadcasts nor adaptive execution, so that rows lie where their keys put them."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key in SETTINGS:
        spark.conf.unset(key)


def sides(spark, left, right):
    return spark.createDataFrame(left, "k string, a int"), spark.createDataFrame(right, "k string, b int")


def brute(left, right):
    out = [(k, a, b) for k, a in left for j, b in right if j == k]
    out += [(k, a, None) for k, a in left if all(j != k for j, _ in right)]
    out += [(k, None, b) for k, b in right if all(j != k for j, _ in left)]
    return sorted(out, key=str)


@pytest.mark.parametrize(
    ("left", "right"),
    [
        ([("x", 1), (None, 2), (None, 3), ("y", 4), ("y", 4)], [("x", 5), (None, 6), ("z", 7), ("y", 8)]),
        ([(None, 1), (None, 1), ("x", 2)], [("x", 3)]),
        ([("x", 2)], [(None, 1), (None, 2), (None, 2)]),
        ([(None, None)], [(None, None)]),
        ([], [(None, 1), ("x", 2)]),
        ([("x", 1)], []),
        ([], []),
    ],
)
def test_full_join_matches_missing_keys(spark, left, right):
    a, b = sides(spark, left, right)
    joined = full_join(a, b, "k")
    assert joined.columns == ["k", "a", "b"]
    assert sorted((tuple(r) for r in joined.collect()), key=str) == brute(left, right)


def test_full_join_with_a_third_of_the_keys_missing(spark, plain):
    random.seed(1)
    left = [(None if i % 3 == 0 else f"k{i}", i) for i in range(900)]
    right = [(None if i % 3 == 0 else f"k{i + random.randrange(2)}", i) for i in range(600)]
    a, b = sides(spark, left, right)
    joined = full_join(a, b, "k")
    assert sorted((tuple(r) for r in joined.collect()), key=str) == brute(left, right)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        sizes = [r["count"] for r in full_join(a, b, "k").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(sizes) >= 60 and max(sizes) < 4 * sum(sizes) / 64


def test_share_over_one_key_for_all_rows(spark, plain):
    rows = spark.range(2000).select(F.lit("all").alias("k"), F.col("id").cast("double").alias("v"))
    window = share_of_total(rows, "v", ["k"])
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        joined = share_of_total(rows, "v", ["k"], parts=64)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert "Window" not in joined._jdf.queryExecution().executedPlan().toString()
    assert len(sizes) >= 14 and max(sizes) < 2000 / 4
    assert sorted(r["percent"] for r in joined.collect()) == pytest.approx(sorted(r["percent"] for r in window.collect()))


def test_shares_with_missing_values_and_keys(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0), ("a", None), ("b", 0.0)], "k string, v double")
    expected = sorted(map(str, share_of_total(rows, "v", ["k"]).collect()))
    assert sorted(map(str, share_of_total(rows, "v", ["k"], parts=8).collect())) == expected


def jobs_of(spark, build):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "")
    try:
        table = build()
        return table, len(tracker.getJobIdsForGroup("planning"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_division_names_are_checked_without_a_job(spark, tmp_path):
    rows = [{"division_nm": name, "division_id": name, "election": year} for name in ("Alpha", "Beta") for year in (2013, 2016)]
    store.write_tables({"cand": cand_table(spark, rows)}, str(tmp_path))
    cand = store.read_tables(spark, str(tmp_path), ("cand",))["cand"]
    found, jobs = jobs_of(spark, lambda: tf.div_votes_by_type(cand, divisions=["Alpha"]))
    assert jobs == 0 and found.count() == 2
    for divisions in ("Gamma", ["Alpha", "Gamma"]):
        table, jobs = jobs_of(spark, lambda: tf.div_votes_by_type(cand, divisions=divisions))
        assert jobs == 0
        with pytest.raises(Exception, match="unknown divisions Gamma"):
            table.collect()
        with pytest.raises(Exception, match="unknown divisions Gamma"):
            restrict(cand, 2016, divisions).count()
    swing, jobs = jobs_of(spark, lambda: tf.pp_tcp_swing(cand, 2013, 2016, divisions=["Alpha"]))
    assert jobs == 0
    plan = restrict(cand, 2016, "Alpha")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(division_nm,Alpha)" in plan or "In(division_nm" in plan
