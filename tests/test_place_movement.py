import math

import pytest
from pyspark.sql import functions as F

from frames import cand_table, ordinary, pp_table, records
from tallyframe.functions.geo import haversine_km
from tallyframe.plans import place_movement, reconciliation


def km(spark, long1, lat1, long2, lat2, legacy=False):
    row = spark.createDataFrame([(long1, lat1, long2, lat2)], "a double, b double, c double, d double")
    return row.select(haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"), legacy).alias("km")).first()["km"]


def test_haversine(spark):
    assert km(spark, 151.2, -33.8, 151.21, -33.8) == pytest.approx(0.924, abs=1e-3)
    assert km(spark, 151.2, -33.8, 151.21, -33.8, legacy=True) == pytest.approx(0.808, abs=1e-3)
    assert km(spark, 0.0, 0.0, 180.0, 0.0) == pytest.approx(math.pi * 6371)
    assert km(spark, 10.0, 20.0, 10.0, 20.0) == 0.0


def test_missing_or_undefined_coordinates_give_no_distance(spark):
    assert km(spark, None, -33.8, 151.21, -33.8) is None
    assert km(spark, float("nan"), -33.8, 151.21, -33.8) is None
    # Cosines of degrees read as radians: opposite signs make the product negative.
    assert km(spark, 100.0, 1.0, 110.0, 2.0, legacy=True) is None


def places(spark):
    def both(place, old, new):
        return [
            {"polling_place_id": place, "election": election, **row}
            for election, row in ((2013, old), (2016, new))
            if row is not None
        ]

    moved = {"latitude": "-33.9"}
    gone = {"latitude": None}
    return pp_table(
        spark,
        both("same", {}, {"latitude": "-33.8001"}) + both("moved", {}, moved) + both("closed", {}, None)
        + both("new", None, {}) + both("mobile", {**gone, "polling_place_type_id": "2"}, {})
        + both("mobile with place", {"polling_place_type_id": "2"}, {}) + both("unlocated", {}, {"latitude": "junk"})
        + both("no type", {"polling_place_type_id": None}, gone) + both("respelled", {}, {"latitude": "-33.80"}),
    )


def test_status(spark):
    found = {r["polling_place_id"]: r["status"] for r in records(place_movement.pp_distance(places(spark), 2013, 2016))}
    assert found == {
        "same": "Same", "moved": "Moved", "closed": "Abolished", "new": None, "mobile": "Mobile",
        "mobile with place": "Same", "unlocated": "MissingGeo", "no type": None, "respelled": "Same",
    }
    counts = {r["status"]: r["places"] for r in records(place_movement.pp_status_counts(places(spark), 2013, 2016))}
    assert counts == {"Same": 3, "Moved": 1, "Abolished": 1, "Mobile": 1, "MissingGeo": 1, None: 2}


def test_geocode_changes_compare_text_and_drop_gaps(spark):
    rows = {r["polling_place_id"]: r for r in records(place_movement.pp_geocode_changes(places(spark), 2013, 2016))}
    assert set(rows) == {"same", "moved", "respelled"}
    assert rows["respelled"]["distance"] == 0.0
    assert rows["moved"]["distance"] == pytest.approx(11.12, abs=0.01)


def test_reconciliation(spark):
    pp = pp_table(spark, [{"polling_place_id": "1"}, {"polling_place_id": "2"}])
    cand = cand_table(spark, [ordinary("1", 5.0), {"votes": 3.0}, {"votes": 2.0, "informal": 1, "surname": "Informal"}])
    total = records(reconciliation.division_totals(cand, pp))[0]
    assert (total["total_cand"], total["total_pp"], total["difference"]) == (10.0, 4.0, 6.0)
    assert {r["informal"]: r["votes"] for r in records(reconciliation.state_informal(cand))} == {0: 8.0, 1: 2.0}
    assert {(r["surname"], r["type"]): r["votes"] for r in records(reconciliation.candidate_type(cand))} == {
        ("Smith", "Ordinary"): 5.0, ("Smith", "Declaration"): 3.0, ("Informal", "Declaration"): 2.0,
    }
    assert {r["surname"]: r["votes"] for r in records(reconciliation.candidate_declaration(cand))} == {
        "Smith": 3.0, "Informal": 2.0,
    }
    gap = pp_table(spark, [{"polling_place_id": "1"}, {"polling_place_id": "2", "tpp_alp_votes": None}])
    totals = records(reconciliation.tpp_totals(gap))[0]
    assert (totals["tpp_coalition_votes"], totals["tpp_alp_votes"], totals["total"]) == (2.0, None, None)
    other = pp_table(spark, [{"division_id": "other"}])
    assert records(reconciliation.division_totals(cand, other))[0]["difference"] is None
