"""What is counted while tables are written, what is staged for joins, and what is deleted in time."""

import random
from pathlib import Path

import pytest

import tallyframe as tf
from frames import cand_table, pp_table, records, text_table
from tallyframe import catalog
from tallyframe.operators.relational import null_safe_join
from tallyframe.plans import reconciliation
from tallyframe.plans.candidates_build import build_cand
from tallyframe.plans.places_build import build_pp
from tallyframe.session import release, shared_folder, stored
from tallyframe.sources import staging, store
from test_builds import AT_HALL, BY_TYPE, TCP_BY_TYPE, TCP_HALL

TPP = {
    "polling_place_id": "1", "liberal_national_coalition_votes": "10", "liberal_national_coalition_percentage": "junk",
    "australian_labor_party_votes": "30", "australian_labor_party_percentage": " ", "total_votes": None, "swing": "1d",
}


def test_values_lost_to_casts_are_counted_in_the_writing_pass(spark, tmp_path):
    places = text_table(spark, [{"polling_place_id": p, "polling_place_type_id": "1"} for p in ("1", "2", "11")])
    losses = tf.Losses()
    tables = {
        "pp": build_pp(places, text_table(spark, [TPP, {**TPP, "polling_place_id": "2", "swing": "-"}]), mark_losses=True),
        "cand": build_cand(
            text_table(spark, [AT_HALL, {**AT_HALL, "ordinary_votes": "n/a", "swing": ""}]), text_table(spark, [TCP_HALL]),
            text_table(spark, [BY_TYPE]), text_table(spark, [TCP_BY_TYPE]), places, mark_losses=True,
        ),
    }
    tf.write_tables(tables, str(tmp_path), losses=losses)
    assert losses.counts("pp") == {
        "tpp_coalition_votes": 0, "tpp_coalition_percent": 2, "tpp_alp_votes": 0, "tpp_alp_percent": 0, "tpp_total_votes": 0,
        "tpp_swing": 2,
    }
    assert losses.counts("cand") == {"ballot_position": 0, "votes": 2, "swing": 0, "tcp_votes": 0, "tcp_swing": 0}
    written = tf.read_tables(spark, str(tmp_path), ("cand",))["cand"]
    assert written.where("votes IS NULL").count() == 2 and "__lost" not in written.columns
    tf.write_tables(tables, str(tmp_path / "without"))
    assert tf.read_tables(spark, str(tmp_path / "without"), ("cand",))["cand"].columns == written.columns


def test_totals_of_a_write_equal_the_checks(spark, tmp_path):
    random.seed(1)
    cand = cand_table(
        spark,
        [
            {"election": random.choice([2004, 2013, 2016]), "state_ab": random.choice(["NSW", "VIC", "TAS"]), "votes": float(i % 97),
             "informal": random.choice([0, 1, None]), "polling_place_id": str(i)}
            for i in range(300)
        ] + [{"election": 2016, "state_ab": "NT", "votes": None}, {"election": 2016, "state_ab": "XX", "votes": 5.0}],
    )
    pp = pp_table(spark, [{"election": 2013 + 3 * (i % 2), "polling_place_id": str(i), "tpp_alp_votes": float(i)} for i in range(50)])
    totals = tf.Totals()
    tf.write_tables({"cand": cand, "pp": pp}, str(tmp_path), totals)
    tables = store.read_tables(spark, str(tmp_path), ("cand", "pp"))
    expected = [(r.election, r.state_ab if r.state_ab != "XX" else None, r.informal, r.votes) for r in reconciliation.state_informal(tables["cand"]).collect()]
    assert sorted(totals.by_state(), key=str) == sorted(expected, key=str)
    votes = {}
    for row in records(reconciliation.division_candidate_totals(tables["cand"])):
        votes.setdefault(row["election"], []).append(row["total_cand"])
    assert totals.votes() == {e: None if None in v else sum(v) for e, v in votes.items()}
    tpp = {}
    for row in records(reconciliation.tpp_totals(tables["pp"])):
        mine = tpp.setdefault(row["election"], dict.fromkeys(["tpp_coalition_votes", "tpp_alp_votes", "tpp_total_votes"], 0.0))
        for c in mine:
            mine[c] += row[c]
    assert totals.tpp() == tpp


def test_tables_without_totals_are_written_all_the_same(spark, tmp_path):
    div = text_table(spark, [{"division_id": "1", "division_nm": "Alpha"}])
    tf.write_tables({"div": div}, str(tmp_path), tf.Totals())
    assert tf.read_tables(spark, str(tmp_path), ("div",))["div"].count() == 1


ODD = [None, "", "-", "1:-", "a", "1:a", "-1:a", "é"]


def test_staged_joins_match_missing_keys_without_an_exchange(spark):
    random.seed(2)
    left = spark.createDataFrame([(random.choice(ODD), random.choice(ODD), i) for i in range(80)], "a string, b string, x int")
    pairs = {(random.choice(ODD), random.choice(ODD)) for _ in range(30)}
    right = spark.createDataFrame([(*pair, i) for i, pair in enumerate(pairs)], "a string, b string, y int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = staging.staged(left, ["a", "b"], 4), staging.staged(right, ["a", "b"], 4)
        joined = staging.staged_join(a, b, ["a", "b"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        expected = null_safe_join(left, right, ["a", "b"])
        assert joined.columns == expected.columns
        assert sorted(map(str, joined.collect())) == sorted(map(str, expected.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    release(a, b)


def test_bucketed_build_reads_staged_files_without_an_exchange(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = catalog.QUERIES["build_cand_base_bucketed"](catalog.Inputs(spark, sf_dir))
        assert "Exchange" not in base._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def folders(spark) -> dict[str, set[str]]:
    root = Path(shared_folder(spark, "none")).parent
    found = {}
    for path in root.iterdir():
        found.setdefault(path.name.split("-", 2)[-1], set()).add(path.name)
    return found


def test_released_tables_are_gone_and_others_stay(spark):
    one = stored(spark.range(3).toDF("a"), "first-of-two")
    two = stored(one, "second-of-two", replaces=[one])
    assert two.count() == 3
    assert "first-of-two" not in folders(spark) and "second-of-two" in folders(spark)
    release(two, spark.range(1))
    assert "second-of-two" not in folders(spark)


def test_a_build_from_files_leaves_one_intermediate(spark, sf_dir):
    before = folders(spark)
    built = catalog.QUERIES["build_from_files"](catalog.Inputs(spark, sf_dir))
    after = folders(spark)
    assert built.limit(1).count() == 1
    assert {k: len(v - before.get(k, set())) for k, v in after.items() if v - before.get(k, set())} == {"landed": 1}
