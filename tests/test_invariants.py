"""Laws that hold in every table, checked on whole derived tables."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import tallyframe as tf
from tallyframe import schemas as S
from tallyframe.fixtures import derived
from tallyframe.functions.geo import haversine_km

DIR = "/root/testdata/sf0.01"
PARTS = ["absent", "postal", "pre_poll_declaration", "provisional", "total_ordinary"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("stored"))
    tf.write_tables({"cand": derived.cand(spark, DIR), "pp": derived.pp(spark, DIR)}, root)
    return tf.read_tables(spark, root, ("cand", "pp"))


def none(df):
    assert df.limit(1).count() == 0


def test_totals_are_the_sum_of_their_parts(tables):
    table = tf.div_table(tables["cand"])
    none(table.where("total_votes IS NOT NULL").where(F.col("total_votes") != sum(F.col(c) for c in PARTS)))
    # A total may be missing only where a part is missing in some row.
    none(table.where("surname <> 'Total' AND total_votes IS NULL").where(" AND ".join(f"{c} IS NOT NULL" for c in PARTS)))


def test_shares_add_to_100_or_are_all_missing(tables):
    for table, over in (
        (tf.div_table(tables["cand"]), ["election", "division_id"]),
        (tf.pp_by_party_percent(tables["cand"]), S.PLACE_KEY),
        (tf.div_pp_tcp(tables["cand"]), ["election", "division_id", "polling_place"]),
    ):
        sums = table.groupBy(*over).agg(F.sum("percent").alias("s"))
        assert sums.where("s IS NOT NULL").limit(1).count() == 1
        none(sums.where(F.abs(F.col("s") - 100) > 1e-9))


def test_groups_make_up_the_formal_votes(tables):
    groups = tf.pp_party_groups(tables["cand"])
    none(groups.where(F.col("total_formal") != sum(F.col(c) for c in S.PARTY_GROUPS)))
    none(groups.where(F.col("total_pp") != F.col("total_formal") + F.col("informal")))


def test_levels_roll_up(tables):
    cand = tables["cand"]
    divisions = tf.div_party_groups(cand).groupBy("election").agg(F.sum("total_pp").alias("d"))
    states = tf.state_primary_by_group(cand).groupBy("election").agg(F.sum("total").alias("s"))
    nation = tf.nat_primary_by_year(cand, 2004)
    none(nation.join(divisions, "election").join(states, "election").where("total <> d OR total <> s"))
    assert nation.count() == 5


def test_statuses_cover_every_place_once(tables):
    pp = tables["pp"]
    counts = {r["status"]: r["places"] for r in tf.pp_status_counts(pp, 2013, 2016).collect()}
    assert set(counts) == {"Abolished", "MissingGeo", "Mobile", "Moved", "Same", None}
    assert sum(counts.values()) == pp.select("polling_place_id").distinct().count()


def test_one_division_equals_its_rows_of_the_whole(tables):
    whole, _ = tf.div_summary(tables["cand"])
    one, _ = tf.div_summary(tables["cand"], elections=[2013], divisions=["NATION_3"])
    expected = whole.where("election = 2013 AND division_nm = 'NATION_3'")
    assert sorted(map(str, one.collect())) == sorted(map(str, expected.collect()))


DEGREES = st.tuples(st.floats(-180, 180), st.floats(-90, 90))


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(DEGREES, DEGREES), min_size=1, max_size=20))
def test_distance_agrees_with_the_spherical_law_of_cosines(spark, pairs):
    rows = spark.createDataFrame([(*a, *b) for a, b in pairs], "x1 double, y1 double, x2 double, y2 double")
    columns = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    for row in rows.withColumn("km", haversine_km(*columns)).collect():
        x1, y1, x2, y2 = (math.radians(row[c]) for c in ("x1", "y1", "x2", "y2"))
        cosine = math.sin(y1) * math.sin(y2) + math.cos(y1) * math.cos(y2) * math.cos(x2 - x1)
        assert row["km"] == pytest.approx(6371 * math.acos(max(-1.0, min(1.0, cosine))), abs=0.2)
