import pytest

from frames import cand_table, ordinary, records
from tallyframe.operators.relational import pivot_sum
from tallyframe.plans import party_tables


def vote(party, votes, place="Hall", **row):
    return ordinary(place, votes, **{"party_ab": party, "candidate_id": f"c-{party}", **row})


def mixed(election=2016):
    rows = [
        vote("ALP", 30.0), vote("LP", 20.0), vote("NP", 5.0), vote("GRN", 10.0), vote("XEN", 4.0), vote("", 3.0),
        vote(None, 2.0), vote("", 6.0, candidate_id="999"), vote("LNP", 1.0), vote("LNQ", 7.0),
    ]
    return [{**row, "election": election} for row in rows]


@pytest.mark.parametrize(("election", "coalition", "others"), [(2007, 25.0, 17.0), (2010, 32.0, 10.0), (2013, 26.0, 16.0)])
def test_coalition_members_depend_on_the_election(spark, election, coalition, others):
    row = records(party_tables.pp_party_groups(cand_table(spark, mixed(election))))[0]
    assert (row["coalition"], row["others"]) == (coalition, others)
    assert (row["alp"], row["grn"], row["informal"], row["total_formal"], row["total_pp"]) == (30.0, 10.0, 6.0, 82.0, 88.0)
    assert sum(row[c] for c in ("coalition", "others", "alp", "grn")) == row["total_formal"]


def test_votes_by_party_skip_gaps_and_relabel_informal(spark):
    rows = [*mixed(), vote("ALP", None), vote("GONE", None)]
    found = {r["party_ab"]: r["votes"] for r in records(party_tables.pp_by_party(cand_table(spark, rows)))}
    assert found == {
        "ALP": 30.0, "LP": 20.0, "NP": 5.0, "GRN": 10.0, "XEN": 4.0, "": 3.0, None: 2.0, "Informal": 6.0, "LNP": 1.0,
        "LNQ": 7.0, "GONE": 0.0,
    }


def test_missing_candidate_has_a_missing_party(spark):
    rows = cand_table(spark, [vote("ALP", 5.0, candidate_id=None)])
    assert records(party_tables.pp_by_party(rows))[0]["party_ab"] is None
    assert records(party_tables.pp_party_groups(rows))[0]["others"] == 5.0


def test_percent_is_of_formal_votes(spark):
    found = {r["party_ab"]: r["percent"] for r in records(party_tables.pp_by_party_percent(cand_table(spark, mixed())))}
    assert "Informal" not in found
    assert found["ALP"] == pytest.approx(3000 / 82)
    assert sum(found.values()) == pytest.approx(100)
    groups = records(party_tables.pp_party_groups_percent(cand_table(spark, mixed())))[0]
    assert groups["coalition"] == pytest.approx(2600 / 82)


def test_legacy_formal_leaves_out_the_last_party(spark):
    with_missing = records(party_tables.pp_party_groups(cand_table(spark, mixed()), legacy_formal=True))[0]
    assert with_missing["total_formal"] == 80.0
    named = [row for row in mixed() if row["party_ab"] is not None]
    without = records(party_tables.pp_party_groups(cand_table(spark, named), legacy_formal=True))[0]
    assert without["total_formal"] == 76.0  # 80 formal votes without XEN's 4


def test_wide_table_has_gaps_for_absent_parties(spark):
    row = records(party_tables.pp_by_party_wide(cand_table(spark, mixed()), ["ALP", "CLP", "XEN"]))[0]
    assert (row["ALP"], row["CLP"], row["XEN"], row["Informal"]) == (30.0, None, 4.0, 6.0)
    assert (row["blank"], row["other"]) == (3.0, 45.0)
    assert sum(row[c] or 0 for c in ("ALP", "CLP", "XEN", "Informal", "blank", "other")) == row["total_pp"]
    assert (row["group_coalition"], row["group_others"], row["total_formal"], row["total_pp"]) == (26.0, 16.0, 82.0, 88.0)


def test_division_state_and_nation_roll_up(spark):
    rows = mixed() + [{**row, "state_ab": "VIC", "division_id": "2", "votes": 3 * row["votes"]} for row in mixed()]
    cand = cand_table(spark, rows)
    divisions = records(party_tables.div_party_groups(cand))
    assert sum(r["total_pp"] for r in divisions) == 352.0
    assert sum(r["votes"] for r in records(party_tables.div_by_party(cand))) == 352.0
    states = records(party_tables.state_primary_by_group(cand))
    assert [r["state_ab"] for r in states] == ["VIC", "NSW"]
    nation = records(party_tables.state_primary_by_group(cand, national=True))
    assert [(r["election"], r["alp"], r["total"]) for r in nation] == [(2016, 120.0, 352.0)]
    percent = records(party_tables.state_primary_by_group(cand, percentage=True))
    assert "total" not in percent[0]
    assert [(r["informal"], r["alp"]) for r in percent] == [(pytest.approx(600 / 88), pytest.approx(3000 / 82))] * 2


def test_primary_by_year_runs_from_a_start(spark):
    cand = cand_table(spark, mixed(2010) + mixed(2016) + mixed(2004))
    assert [r["election"] for r in records(party_tables.nat_primary_by_year(cand, 2010))] == [2010, 2016]
    with pytest.raises(ValueError):
        party_tables.nat_primary_by_year(cand, 2002)


def test_pivot_leaves_no_votes_out(spark):
    table = cand_table(spark, mixed())
    row = records(pivot_sum(table, ["polling_place"], "party_ab", {"ALP": "ALP", "": "blank"}, "votes"))[0]
    assert (row["ALP"], row["blank"], row["other"]) == (30.0, 9.0, 49.0)


def test_last_party_is_that_of_the_whole_election(spark):
    here = [vote("ALP", 30.0), vote("LP", 20.0)]
    there = [vote("ALP", 1.0, division_nm="Beta"), vote("XEN", 2.0, division_nm="Beta")]
    cand = cand_table(spark, here + there)
    row = records(party_tables.pp_party_groups(cand, 2016, "Alpha", legacy_formal=True))[0]
    assert row["total_formal"] == 50.0
    shares = {r["party_ab"]: r["percent"] for r in records(party_tables.pp_by_party_percent(cand, 2016, "Alpha", True))}
    assert shares == {"ALP": pytest.approx(60.0), "LP": pytest.approx(40.0)}


def test_one_division_or_election_may_be_given_as_such(spark):
    cand = cand_table(spark, mixed())
    assert party_tables.pp_by_party(cand, 2016, "Alpha").count() == party_tables.pp_by_party(cand, [2016], ["Alpha"]).count() > 0
    with pytest.raises(Exception, match="unknown divisions Elsewhere, Nowhere"):
        party_tables.pp_by_party(cand, divisions=["Nowhere", "Alpha", "Elsewhere"]).collect()
    with pytest.raises(ValueError, match="unknown elections"):
        party_tables.pp_by_party(cand, 1999)
