import pytest
from pyspark.sql import functions as F

from frames import FOUR, cand_table, declared, ordinary, records
from tallyframe.operators.relational import with_total_row
from tallyframe.plans import division_tables, tcp_places, vote_type_tables


def candidate(candidate_id, hall, pre_poll=5.0, **row):
    """All rows of one candidate: four declaration types, one polling place, one pre-poll centre."""
    rows = declared(FOUR, candidate_id=candidate_id, **row)
    rows.append(ordinary("Hall", hall, candidate_id=candidate_id, **row))
    if pre_poll is not None:
        rows.append(ordinary("Centre", pre_poll, early=1, candidate_id=candidate_id, **row))
    return rows


def by(rows, key):
    return {r[key]: r for r in rows}


def test_table_adds_up(spark):
    rows = by(records(division_tables.div_table(cand_table(spark, candidate("1", 15.0) + candidate("2", 45.0)))), "candidate_id")
    one, two, total = rows["1"], rows["2"], rows[None]
    assert (one["absent"], one["postal"], one["pre_poll_declaration"], one["provisional"]) == (1.0, 2.0, 3.0, 4.0)
    assert (one["ordinary"], one["pre_poll_ordinary"], one["total_ordinary"], one["total_votes"]) == (15.0, 5.0, 20.0, 30.0)
    assert (one["percent"], two["percent"], total["percent"]) == (pytest.approx(100 / 3), pytest.approx(200 / 3), None)
    assert (total["surname"], total["given_nm"], total["party_ab"], total["elected"]) == ("Total", "", "", None)
    assert total["total_votes"] == 90.0


def test_gap_inside_a_cell_reaches_every_total(spark):
    rows = candidate("1", 15.0) + [ordinary("Second hall", None, candidate_id="1")] + candidate("2", 45.0)
    table = by(records(division_tables.div_table(cand_table(spark, rows))), "candidate_id")
    assert (table["1"]["ordinary"], table["1"]["total_ordinary"], table["1"]["total_votes"]) == (None, None, None)
    assert table["1"]["pre_poll_ordinary"] == 5.0
    assert (table["2"]["total_votes"], table["2"]["percent"]) == (60.0, None)
    assert (table[None]["ordinary"], table[None]["absent"], table[None]["total_votes"]) == (None, 2.0, None)


def test_absent_vote_type_is_missing_not_zero(spark):
    table = by(records(division_tables.div_table(cand_table(spark, candidate("1", 15.0, pre_poll=None)))), "candidate_id")
    assert (table["1"]["pre_poll_ordinary"], table["1"]["total_ordinary"]) == (None, None)


@pytest.mark.parametrize(("election", "ordinary_votes", "pre_poll"), [(2004, 20.0, None), (2007, 20.0, None), (2010, 15.0, 5.0)])
def test_pre_poll_ordinary_starts_after_2007(spark, election, ordinary_votes, pre_poll):
    rows = cand_table(spark, candidate("1", 15.0, election=election))
    row = by(records(division_tables.div_table(rows)), "candidate_id")["1"]
    assert (row["ordinary"], row["pre_poll_ordinary"], row["total_ordinary"]) == (ordinary_votes, pre_poll, 20.0)
    split = records(division_tables.ordinary_by_candidate(rows))[0]
    assert (split["ordinary"], split["ppo"]) == (15.0, 5.0)


def test_candidate_with_only_ordinary_votes_is_left_out(spark):
    rows = candidate("1", 15.0) + [ordinary("Hall", 99.0, candidate_id="2")]
    table = records(division_tables.div_table(cand_table(spark, rows)))
    assert {r["candidate_id"] for r in table} == {"1", None}


def test_ordinary_votes_attach_by_candidate_id_alone(spark):
    rows = declared(FOUR, candidate_id="1", surname="Smith")
    rows += [ordinary("Hall", 15.0, candidate_id="1", surname="SMITH"), ordinary("Centre", 5.0, early=1, candidate_id="1")]
    table = by(records(division_tables.div_table(cand_table(spark, rows))), "candidate_id")
    assert (table["1"]["surname"], table["1"]["total_votes"]) == ("Smith", 30.0)


def test_same_candidate_id_in_two_divisions_stays_apart(spark):
    rows = candidate("999", 10.0, division_id="1", division_nm="A") + candidate("999", 20.0, division_id="2", division_nm="B")
    table = records(division_tables.div_table(cand_table(spark, rows)))
    assert sorted(r["total_votes"] for r in table if r["candidate_id"]) == [25.0, 35.0]


def informal(hall):
    return candidate("999", hall, surname="Informal", given_nm="Informal", party_ab="")


def test_informal_rows(spark):
    rows = candidate("1", 15.0) + candidate("2", 45.0) + informal(15.0)
    table = by(records(division_tables.div_table_informal(cand_table(spark, rows))), "surname")
    assert set(table) == {"Formal", "Informal", "Total"}
    assert (table["Formal"]["total_votes"], table["Formal"]["percent"]) == (90.0, 75.0)
    assert (table["Informal"]["candidate_id"], table["Informal"]["given_nm"], table["Informal"]["percent"]) == ("999", "", 25.0)
    assert (table["Total"]["total_votes"], table["Total"]["percent"]) == (120.0, None)


def test_candidate_named_total_still_counts(spark):
    rows = candidate("1", 15.0, surname="Total") + informal(15.0)
    table = by(records(division_tables.div_table_informal(cand_table(spark, rows))), "surname")
    assert table["Formal"]["total_votes"] == 30.0
    primary, _ = division_tables.div_summary(cand_table(spark, rows))
    assert sorted(r["surname"] for r in records(primary)) == ["Formal", "Informal", "Total", "Total"]


def test_division_with_informal_votes_only_has_zero_formal(spark):
    table = by(records(division_tables.div_table_informal(cand_table(spark, informal(15.0)))), "surname")
    assert (table["Formal"]["total_votes"], table["Informal"]["percent"]) == (0.0, 100.0)


def test_summary_percent_is_of_formal_votes(spark):
    rows = candidate("1", 15.0, elected="Y") + candidate("2", 45.0) + informal(15.0)
    for row in rows:
        row["tcp_votes"] = None if row["candidate_id"] == "999" else row["votes"]
    primary, tcp = division_tables.div_summary(cand_table(spark, rows))
    table = {(r["surname"], r["elected"]): r for r in records(primary)}
    assert (table["Smith", "Y"]["percent"], table["Smith", "N"]["percent"]) == (33.33, 66.67)
    assert (table["Formal", ""]["percent"], table["Formal", ""]["historic"]) == (75.0, "")
    assert primary.columns[-8:] == [
        "absent", "postal", "pre_poll_dec", "provisional", "pre_poll_ordinary", "ordinary", "total_votes", "percent",
    ]
    assert sorted(r["ordinary"] for r in records(tcp)) == [25.0, 75.0]
    assert sorted(r["absent"] for r in records(tcp)) == [50.0, 50.0]


def test_tcp_ignores_rows_without_a_count(spark):
    rows = candidate("1", 15.0) + candidate("2", 45.0)
    for row in rows:
        row["tcp_votes"] = 2 * row["votes"] if row["polling_place"] != "Absent" or row["candidate_id"] == "1" else None
    table = by(records(division_tables.div_tcp(cand_table(spark, rows))), "candidate_id")
    assert (table["1"]["absent"], table["1"]["total_votes"]) == (2.0, 60.0)
    assert (table["2"]["absent"], table["2"]["total_votes"], table[None]["ordinary"]) == (None, None, 120.0)


def test_filters(spark):
    rows = candidate("1", 15.0) + candidate("2", 45.0, division_nm="Beta", division_id="102", election=2013)
    cand = cand_table(spark, rows)
    assert {r["division_nm"] for r in records(division_tables.div_table(cand, elections=[2013]))} == {"Beta"}
    assert {r["division_nm"] for r in records(division_tables.div_table(cand, divisions=["Alpha"]))} == {"Alpha"}


def tcp_rows(spark):
    def at(place, party, votes, **row):
        return {**ordinary(place, votes, party_ab=party, **row), "tcp_votes": votes}

    return cand_table(
        spark,
        [
            at("Hall", "ALP", 40.0, candidate_id="1", election=2013), at("Hall", "LP", 60.0, candidate_id="2", election=2013),
            at("Lone", "LP", 60.0, candidate_id="2", election=2013),
            {**at("Hall", "ALP", 75.0, candidate_id="1", elected="Y"), "tcp_swing": 3.5},
            at("Hall", "LP", 25.0, candidate_id="2"), at("New", "LP", 25.0, candidate_id="2"),
        ],
    )


def test_place_total_needs_both_parties(spark):
    rows = {(r["election"], r["polling_place"], r["party_ab"]): r for r in records(tcp_places.div_pp_tcp(tcp_rows(spark)))}
    assert (rows[2013, "Hall", "LP"]["total"], rows[2013, "Hall", "LP"]["percent"]) == (100.0, 60.0)
    assert (rows[2013, "Lone", "LP"]["total"], rows[2013, "Lone", "LP"]["percent"]) == (None, None)
    wide = {(r["election"], r["polling_place"]): r for r in records(tcp_places.div_pp_tcp_wide(tcp_rows(spark), ("ALP", "LP")))}
    assert (wide[2016, "Hall"]["percent_ALP"], wide[2016, "Hall"]["total"]) == (75.0, 100.0)
    assert (wide[2013, "Lone"]["ALP"], wide[2013, "Lone"]["total"]) == (None, None)


def test_swing_is_earlier_minus_later(spark):
    rows = {r["polling_place"]: r for r in records(tcp_places.pp_tcp_swing(tcp_rows(spark), 2013, 2016, "LP"))}
    assert set(rows) == {"Hall", "Lone"}
    assert (rows["Hall"]["swing"], rows["Hall"]["tcp_swing"]) == (35.0, 3.5)
    assert (rows["Lone"]["swing"], rows["Lone"]["tcp_swing"]) == (None, None)


def test_division_votes_by_type(spark):
    rows = candidate("1", 15.0) + candidate("2", 45.0)
    row = records(vote_type_tables.div_votes_by_type(cand_table(spark, rows)))[0]
    assert (row["ordinary"], row["pre_poll_ordinary"], row["total_votes"]) == (60.0, 10.0, 90.0)
    percent = records(vote_type_tables.div_votes_by_type(cand_table(spark, rows), percentage=True))[0]
    assert percent["total_ordinary"] == pytest.approx(700 / 9)
    assert "total_votes" not in percent


def test_national_types(spark):
    rows = candidate("1", 15.0) + candidate("2", 45.0, pre_poll=None, division_id="102", division_nm="Beta")
    cand = cand_table(spark, rows)
    strict = records(vote_type_tables.nat_type_by_year(cand, 2016))[0]
    assert (strict["ordinary"], strict["pre_poll_ordinary"], strict["total_votes"]) == (60.0, None, None)
    lenient = records(vote_type_tables.nat_type_by_year(cand, 2016, skip_missing=True))[0]
    assert (lenient["pre_poll_ordinary"], lenient["total_votes"]) == (5.0, 30.0)
    with pytest.raises(ValueError):
        vote_type_tables.nat_type_by_year(cand, 2001)
    assert vote_type_tables.nat_type_by_year(cand, 2004, percentage=True).columns[-1] == "election"


def test_with_total_row(spark):
    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "y", None), ("b", "x", 2.0)], "g string, n string, v double")
    table = with_total_row(rows, ["g"], ["v"], {"n": "Total"})
    found = {(r["g"], r["n"], r["is_total"]): r["v"] for r in table.collect()}
    assert found == {
        ("a", "x", False): 1.0, ("a", "y", False): None, ("b", "x", False): 2.0,
        ("a", "Total", True): None, ("b", "Total", True): 2.0,
    }
    assert table.where(F.col("is_total")).count() == 2


def tcp(division, place, party, votes):
    return {"division_nm": division, "division_id": division, "polling_place": place, "party_ab": party, "tcp_votes": votes}


def test_own_pairs_need_two_parties_and_keep_every_vote(spark):
    rows = [
        tcp("One", "Hall", "ALP", 10.0),
        tcp("Two", "Hall", "LP", 6.0), tcp("Two", "Hall", "ALP", 4.0), tcp("Two", "School", "ALP", 4.0),
        tcp("Three", "Hall", "ALP", 10.0), tcp("Three", "Hall", "GRN", 5.0), tcp("Three", "Hall", "LP", 20.0),
        tcp("Three", "School", "LP", 1.0), tcp("Four", "Hall", "ALP", 1.0), tcp("Four", "Hall", None, 2.0),
    ]
    found = {(r["division_nm"], r["polling_place"]): r for r in records(tcp_places.div_pp_tcp_wide(cand_table(spark, rows)))}
    columns = ["parties", "first_party", "second_party", "first", "second", "other", "total", "percent_first", "percent_second"]
    assert {k: tuple(r[c] for c in columns) for k, r in found.items()} == {
        ("One", "Hall"): (1, "ALP", None, 10.0, None, None, None, None, None),
        ("Two", "Hall"): (2, "ALP", "LP", 4.0, 6.0, None, 10.0, 40.0, 60.0),
        ("Two", "School"): (2, "ALP", "LP", 4.0, None, None, None, None, None),
        ("Three", "Hall"): (3, "ALP", "GRN", 10.0, 5.0, 20.0, None, None, None),
        ("Three", "School"): (3, "ALP", "GRN", None, None, 1.0, None, None, None),
        ("Four", "Hall"): (2, "ALP", None, 1.0, 2.0, None, 3.0, pytest.approx(100 / 3), pytest.approx(200 / 3)),
    }
    votes = sum(r["tcp_votes"] for r in rows)
    assert sum((r["first"] or 0) + (r["second"] or 0) + (r["other"] or 0) for r in found.values()) == votes
