"""Names and fixed values shared by the whole package. No logic lives here."""

from __future__ import annotations

# --- Fixed values: election years and the publisher's event ids -------------------------------------
EVENT_IDS = {2016: 20499, 2013: 17496, 2010: 15508, 2007: 13745, 2004: 12246, 2001: 10822}

# --- Fixed values: the state codes that name the per-state files ------------------------------------
STATES = ("NSW", "VIC", "QLD", "WA", "SA", "TAS", "ACT", "NT")

# --- Fixed values: elections that have each table ----------------------------------------------------
TABLE_ELECTIONS = {
    "cand": (2004, 2007, 2010, 2013, 2016),
    "pp": (2013, 2016),
    "div": (2004, 2007, 2010, 2013, 2016),
}

# --- Fixed values: published file families ------------------------------------------------------------
POLLING_PLACES = "GeneralPollingPlacesDownload"
TPP_BY_PLACE = "HouseTppByPollingPlaceDownload"
FIRST_PREFS_BY_PLACE = "HouseStateFirstPrefsByPollingPlaceDownload"  # one file per state
TCP_BY_PLACE = "HouseTcpByCandidateByPollingPlaceDownload"
FIRST_PREFS_BY_TYPE = "HouseFirstPrefsByCandidateByVoteTypeDownload"
TCP_BY_TYPE = "HouseTcpByCandidateByVoteTypeDownload"
NOMINATIONS = "HouseNominationsByDivisionDownload"
MEMBERS_ELECTED = "HouseMembersElectedDownload"
CHANGED_HANDS = "HouseSeatsWhichChangedHandsDownload"
DECIDED_ON_FIRST_PREFS = "HouseSeatsDecidedOnFirstPrefsDownload"
DECIDED_ON_PREFS = "HouseSeatsDecidedOnPrefsDownload"
NON_CLASSIC = "HouseNonClassicDivisionsDownload"
DIVISION_FAMILIES = (NOMINATIONS, MEMBERS_ELECTED, CHANGED_HANDS, DECIDED_ON_FIRST_PREFS, DECIDED_ON_PREFS, NON_CLASSIC)

# --- Fixed values: codes inside the data ---------------------------------------------------------------
INFORMAL_CANDIDATE = "999"
INFORMAL_BALLOT_POSITION = "999"
PRE_POLL_CENTRE = "5"
MOBILE_TEAM = "2"
ORDINARY = "Ordinary"
DECLARATION = "Declaration"
INFORMAL = "Informal"

# --- Fixed values: the column that tells informal rows; missing where there is no ballot position -----------
INFORMAL_STATES = (0, 1, None)

# --- Fixed value: elections up to this one have no separate pre-poll ordinary count -----------------------
LAST_ELECTION_WITHOUT_PRE_POLL_ORDINARY = 2007

# --- Fixed values: parties of the coalition, by the span of elections they hold for ---------------------
COALITION_BEFORE_2010 = ("LP", "NP", "CLP")
COALITION_IN_2010 = ("LP", "NP", "LNQ", "CLP")
COALITION_AFTER_2010 = ("LP", "NP", "LNP", "CLP")

# --- Fixed values: a place that moved less than this counts as unmoved; the earth's mean radius ------------
SAME_PLACE_KM = 0.2
EARTH_RADIUS_KM = 6371.0

# --- Column lists -------------------------------------------------------------------------------------
DIVISION_KEY = ["election", "state_ab", "division_id", "division_nm"]
CANDIDATE_IDENTITY = ["surname", "given_nm", "party_ab", "elected", "historic_elected"]
PLACE_KEY = [*DIVISION_KEY, "polling_place_id", "polling_place"]
# The same keys, most distinctive first: a sort on them seldom compares more than the first.
PLACE_SORT_KEY = ["polling_place_id", "polling_place", "division_id", "election", "division_nm", "state_ab"]
# How rows lie inside stored files, as far as a table has the columns.
STORED_ORDER = ["election", "division_nm", "polling_place_id"]

# --- Fixed values: declaration vote types, with the column that holds each in the by-vote-type files -------
DECLARATION_TYPES = {
    "Absent": "absent_votes",
    "Provisional": "provisional_votes",
    "PrePollDeclaration": "pre_poll_votes",
    "Postal": "postal_votes",
}
EARLY_DECLARATION_TYPES = ("PrePollDeclaration", "Postal")

# One column per vote type, in report order, then the totals made from them.
TYPE_COLUMNS = ["absent", "postal", "pre_poll_declaration", "provisional", "ordinary", "pre_poll_ordinary"]
TYPE_MEASURES = [*TYPE_COLUMNS, "total_ordinary", "total_votes"]

# Party groups of a primary-vote table, then the totals.
PARTY_GROUPS = ["coalition", "alp", "grn", "others"]
GROUP_MEASURES = [*PARTY_GROUPS, "informal", "total_formal", "total_pp"]

# --- Fixed values: two-party-preferred columns as published, and their names in the table ------------------
TPP_COLUMNS = {
    "liberal_national_coalition_votes": "tpp_coalition_votes",
    "liberal_national_coalition_percentage": "tpp_coalition_percent",
    "australian_labor_party_votes": "tpp_alp_votes",
    "australian_labor_party_percentage": "tpp_alp_percent",
    "total_votes": "tpp_total_votes",
    "swing": "tpp_swing",
}

# The descriptive columns of a by-vote-type file, and of the candidate table without its place.
CANDIDATE_COLUMNS = [
    *DIVISION_KEY, "candidate_id", "surname", "given_nm", "ballot_position", "elected", "historic_elected",
    "party_ab", "party_nm",
]
CAND_COLUMNS = [
    *DIVISION_KEY, "polling_place_id", "polling_place", "candidate_id", "surname", "given_nm", "ballot_position",
    "elected", "historic_elected", "party_ab", "party_nm", "votes", "swing", "tcp_votes", "tcp_swing", "type",
    "early", "informal",
]
PP_COLUMNS = [
    "election", "state", "division_id", "division_nm", "polling_place_id", "polling_place_type_id",
    "polling_place_nm", "latitude", "longitude", *TPP_COLUMNS.values(),
]
DIV_COLUMNS = [
    "election", "division_id", "state_ab", "division_nm", "nominations", "elected_candidate_id",
    "elected_given_nm", "elected_surname", "elected_party", "previous_party", "changed", "preferences",
    "nonclassic_party1", "nonclassic_party2", "nonclassic",
]
