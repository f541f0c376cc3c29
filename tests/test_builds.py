from frames import pp_table, records, text_table
from tallyframe.plans.candidates_build import build_cand, build_cand_base, build_cand_declaration, mark_early
from tallyframe.plans.divisions_build import build_div
from tallyframe.plans.places_build import build_pp

PERSON = {
    "state_ab": "NSW", "division_id": "101", "division_nm": "Alpha", "candidate_id": "7", "surname": "Smith",
    "given_nm": "Jo", "ballot_position": "1", "elected": "Y", "historic_elected": "N", "party_ab": "ALP",
    "party_nm": "Labor",
}
AT_HALL = {**PERSON, "polling_place_id": "11", "polling_place": "Hall", "ordinary_votes": "50", "swing": "1.5"}
TCP_HALL = {"candidate_id": "7", "polling_place_id": "11", "ordinary_votes": "60", "swing": "-0.5"}
BY_TYPE = {**PERSON, "absent_votes": "1", "provisional_votes": "2", "pre_poll_votes": "x", "postal_votes": "4"}
TCP_BY_TYPE = {
    "division_id": "101", "candidate_id": "7", "absent_votes": "10", "provisional_votes": "20",
    "pre_poll_votes": "30", "postal_votes": "40",
}


def test_places_keep_unmatched_rows_and_text_coordinates(spark):
    places = text_table(spark, [{"polling_place_id": p, "state": "NSW", "latitude": "-33.80"} for p in ("1", "2")])
    tpp = text_table(
        spark,
        [
            {
                "polling_place_id": "1", "liberal_national_coalition_votes": "10",
                "liberal_national_coalition_percentage": "junk", "australian_labor_party_votes": "30",
                "australian_labor_party_percentage": "75", "total_votes": "40", "swing": "",
            }
        ],
    )
    one, two = sorted(records(build_pp(places, tpp)), key=lambda r: r["polling_place_id"])
    assert one["latitude"] == "-33.80"
    assert (one["tpp_coalition_votes"], one["tpp_coalition_percent"], one["tpp_swing"]) == (10.0, None, None)
    assert two["tpp_total_votes"] is None


def test_base_joins_missing_keys_with_missing_keys(spark):
    votes = text_table(spark, [AT_HALL, {**AT_HALL, "polling_place_id": None}])
    tcp = text_table(spark, [TCP_HALL, {**TCP_HALL, "polling_place_id": None, "ordinary_votes": "99"}])
    found = {r["polling_place_id"]: r["tcp_votes"] for r in build_cand_base(votes, tcp).collect()}
    assert found == {"11": "60", None: "99"}


def test_join_does_not_cross_elections(spark):
    votes = text_table(spark, [AT_HALL], 2016)
    tcp = text_table(spark, [TCP_HALL], 2013)
    assert build_cand_base(votes, tcp).first()["tcp_votes"] is None


def test_declaration_votes_become_pseudo_places(spark):
    rows = build_cand_declaration(text_table(spark, [BY_TYPE]), text_table(spark, [TCP_BY_TYPE]))
    found = {r["polling_place"]: (r["votes"], r["tcp_votes"], r["early"], r["type"]) for r in rows.collect()}
    assert found == {
        "Absent": ("1", "10", 0, "Declaration"), "Provisional": ("2", "20", 0, "Declaration"),
        "PrePollDeclaration": ("x", "30", 1, "Declaration"), "Postal": ("4", "40", 1, "Declaration"),
    }


def test_early_places_come_from_one_election_or_from_their_own(spark):
    pp = pp_table(
        spark,
        [
            {"election": 2013, "polling_place_id": "1", "polling_place_type_id": "5"},
            {"election": 2016, "polling_place_id": "2", "polling_place_type_id": "5"},
            {"election": 2016, "polling_place_id": "3", "polling_place_type_id": "1"},
        ],
    )
    rows = text_table(spark, [{"polling_place_id": p} for p in ("1", "2", "3", "4")], 2013)
    def flags(source):
        return {r["polling_place_id"]: r["early"] for r in mark_early(rows, pp, source).collect()}

    assert flags(2016) == {"1": 0, "2": 1, "3": 0, "4": 0}
    assert flags(None) == {"1": 1, "2": 0, "3": 0, "4": 0}


def test_candidate_table(spark):
    informal = {**AT_HALL, "candidate_id": "999", "ballot_position": "999"}
    padded = {**AT_HALL, "candidate_id": "8", "ballot_position": "0999"}
    unplaced = {**AT_HALL, "candidate_id": "9", "ballot_position": None}
    pp = pp_table(spark, [{"polling_place_id": "11", "polling_place_type_id": "5"}])
    built = build_cand(
        text_table(spark, [AT_HALL, informal, padded, unplaced]), text_table(spark, [TCP_HALL]),
        text_table(spark, [BY_TYPE]), text_table(spark, [TCP_BY_TYPE]), pp,
    )
    rows = records(built)
    assert len(rows) == 8
    assert {r["candidate_id"]: r["informal"] for r in rows if r["type"] == "Ordinary"} == {
        "7": 0, "999": 1, "8": 0, "9": None,
    }
    hall = next(r for r in rows if r["candidate_id"] == "7" and r["type"] == "Ordinary")
    assert (hall["votes"], hall["tcp_votes"], hall["tcp_swing"], hall["early"]) == (50.0, 60.0, -0.5, 1)
    postal = next(r for r in rows if r["polling_place"] == "Postal")
    assert (postal["votes"], postal["tcp_votes"], postal["polling_place_id"], postal["swing"]) == (4.0, 40.0, None, None)
    pre_poll = next(r for r in rows if r["polling_place"] == "PrePollDeclaration")
    assert pre_poll["votes"] is None


def test_division_table(spark):
    def ids(*values):
        return text_table(spark, [{"division_id": v} for v in values])

    nominations = text_table(
        spark, [{"transaction_id": "t", "division_id": d, "state_ab": "NSW", "division_nm": f"D{d}"} for d in "12"]
    )
    elected = text_table(
        spark, [{"division_id": "1", "candidate_id": "7", "given_nm": "Jo", "surname": "Smith", "party_ab": "ALP"}]
    )
    changed = text_table(spark, [{"division_id": "2", "previous_party_ab": "LP"}])
    contest = text_table(spark, [{"division_id": "1", "party_ab1": "ALP", "party_ab2": "GRN"}])
    built = build_div(nominations, elected, changed, ids("1"), ids("2"), contest)
    assert "transaction_id" not in built.columns
    one, two = sorted(records(built), key=lambda r: r["division_id"])
    assert (one["elected_party"], one["changed"], one["preferences"], one["nonclassic"]) == ("ALP", None, "First", 1)
    assert (two["elected_party"], two["changed"], two["preferences"], two["nonclassic"]) == (None, 1, "Preferences", None)
    assert (one["nonclassic_party2"], two["previous_party"]) == ("GRN", "LP")
