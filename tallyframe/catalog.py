"""Every query by name, over whole tables in a directory of Parquet files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import schemas as S
from tallyframe.fixtures import derived, raw
from tallyframe.functions.geo import haversine_km
from tallyframe.functions.missing import na_sum, number, zero_sum
from tallyframe.operators import relational as rel
from tallyframe.plans import (
    candidates_build,
    division_tables,
    divisions_build,
    party_tables,
    place_movement,
    places_build,
    reconciliation,
    tables_build,
    tcp_places,
    vote_type_tables,
)
from tallyframe.session import release, shared_folder
from tallyframe.sources import registry, result_files, staging, store

FIXTURE_STATES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
FIXTURE_PARTIES = ["ALP", "CLP", "GRN", "HAN", "IND", "LNP", "LNQ", "LP", "NP", "XEN"]
ONE_DIVISION = "NATION_1"
EARLIER, LATER = 2013, 2016


@dataclass(frozen=True)
class Inputs:
    """The tables one query reads; each is planned only when asked for."""

    spark: SparkSession
    sf_dir: str

    @property
    def cand(self) -> DataFrame:
        return derived.cand(self.spark, self.sf_dir)

    @property
    def pp(self) -> DataFrame:
        return derived.pp(self.spark, self.sf_dir)

    @property
    def divisions(self) -> DataFrame:
        return derived.divisions(self.spark, self.sf_dir)

    def stored(self, name: str, *elections: int) -> DataFrame:
        """A table, or its rows of some elections, written to the shared folder and read back, for queries that read it
        several times. The folder goes when the driver ends, or when the table is released."""
        root = shared_folder(self.spark, "tables")
        store.write_tables({name: rel.restrict(getattr(self, name), elections or None)}, root)
        table = store.read_tables(self.spark, root, (name,))[name]
        table._shared_folder = root
        return table


@dataclass(frozen=True)
class StoredInputs(Inputs):
    """The same tables, derived and stored once beforehand: what a user of the library has."""

    root: str

    @classmethod
    def write(cls, inputs: Inputs) -> StoredInputs:
        root = shared_folder(inputs.spark, "tables")
        store.write_tables({"cand": inputs.cand, "pp": inputs.pp}, root)
        return cls(inputs.spark, inputs.sf_dir, root)

    @property
    def cand(self) -> DataFrame:
        return store.read_tables(self.spark, self.root, ("cand",))["cand"]

    @property
    def pp(self) -> DataFrame:
        return store.read_tables(self.spark, self.root, ("pp",))["pp"]

    def stored(self, name: str, *elections: int) -> DataFrame:
        return rel.restrict(getattr(self, name), elections or None)


def rounded(table: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Percentages and distances, cut to digits that every engine agrees on."""
    return table.withColumns({c: F.round(c, digits) for c in columns})


# --- Sources and table builds ---------------------------------------------------------------------------


def scan_results_csv(t: Inputs) -> DataFrame:
    root = shared_folder(t.spark, "first-prefs")
    raw.land(S.FIRST_PREFS_BY_PLACE, raw.first_prefs(t.cand), root)
    return result_files.scan_family(
        t.spark, root, S.FIRST_PREFS_BY_PLACE, S.TABLE_ELECTIONS["cand"], layout=raw.staged_path
    )


def scan_state_union(t: Inputs) -> DataFrame:
    root = shared_folder(t.spark, "first-prefs-by-state")
    raw.land(S.FIRST_PREFS_BY_PLACE, raw.first_prefs(t.cand), root, by_state=True)
    return result_files.scan_family(
        t.spark, root, S.FIRST_PREFS_BY_PLACE, S.TABLE_ELECTIONS["cand"],
        by_state=True, states=FIXTURE_STATES, layout=raw.staged_path,
    )


def election_registry(t: Inputs) -> DataFrame:
    looked_up = t.cand.withColumn("event_id", registry.event_id_column())
    votes = looked_up.groupBy("election", "event_id").agg(na_sum("votes").alias("votes"))
    return registry.elections_table(t.spark).join(votes, ["election", "event_id"], "left")


def build_from_files(t: Inputs) -> DataFrame:
    """Land every file family as CSV, then build the candidate table from the files alone. The stored copy that they are
    made from goes as soon as they lie there."""
    root = shared_folder(t.spark, "landed")
    cand = t.stored("cand")
    raw.land_all(cand, t.pp, t.divisions, root)
    release(cand)
    return tables_build.build_tables(t.spark, root, FIXTURE_STATES, raw.staged_path)["cand"]


def build_pp(t: Inputs) -> DataFrame:
    return places_build.build_pp(raw.places(t.pp), raw.tpp(t.pp))


def build_cand_base(t: Inputs) -> DataFrame:
    cand = t.stored("cand")
    return candidates_build.build_cand_base(raw.first_prefs(cand), raw.tcp(cand))


def build_cand_base_bucketed(t: Inputs) -> DataFrame:
    """The same from files that are staged in buckets of their key, so that the join shuffles nothing."""
    cand = t.stored("cand")

    def joined(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
        return staging.staged_join(staging.staged(left, key, 8), staging.staged(right, key, 8), key)

    return candidates_build.build_cand_base(raw.first_prefs(cand), raw.tcp(cand), joined)


def build_cand_declaration(t: Inputs) -> DataFrame:
    cand = t.stored("cand")
    return candidates_build.build_cand_declaration(raw.first_prefs_by_type(cand), raw.tcp_by_type(cand))


def build_cand(t: Inputs, early_source_election: int | None = 2016) -> DataFrame:
    cand = t.stored("cand")
    return candidates_build.build_cand(
        raw.first_prefs(cand), raw.tcp(cand), raw.first_prefs_by_type(cand), raw.tcp_by_type(cand), t.pp,
        early_source_election,
    )


def build_div(t: Inputs) -> DataFrame:
    return divisions_build.build_div(**raw.division_files(t.stored("cand"), t.divisions))


def materialise_tables(t: Inputs) -> DataFrame:
    """Write the three tables, then count what came back per table and election."""
    root = shared_folder(t.spark, "tables")
    store.write_tables({"cand": t.cand, "pp": t.pp}, root)
    stored_cand = store.read_tables(t.spark, root, ("cand",))["cand"]
    store.write_tables({"div": divisions_build.build_div(**raw.division_files(stored_cand, t.divisions))}, root)
    stored = store.read_tables(t.spark, root)
    measure = {"cand": "votes", "pp": "tpp_total_votes", "div": "changed"}
    counts = [
        table.groupBy(F.lit(name).alias("table_name"), "election").agg(
            F.count(F.lit(1)).alias("n_rows"), zero_sum(measure[name]).alias("measure")
        )
        for name, table in stored.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# --- Operators on their own -------------------------------------------------------------------------------


def agg_na_sum(t: Inputs) -> DataFrame:
    return t.pp.groupBy("election", "division_id").agg(
        na_sum("tpp_total_votes").alias("total"), na_sum("tpp_alp_votes").alias("alp")
    )


def agg_sum_zero(t: Inputs) -> DataFrame:
    return t.cand.groupBy("election", "state_ab", "party_ab").agg(
        zero_sum("votes").alias("votes"), zero_sum("tcp_votes").alias("tcp_votes")
    )


def pivot_votes_by_type(t: Inputs) -> DataFrame:
    declared = t.cand.where(F.col("type") == S.DECLARATION)
    by = [*S.DIVISION_KEY, "candidate_id"]
    return rel.pivot_sum(declared, by, "polling_place", list(S.DECLARATION_TYPES), "votes")


def pivot_votes_by_party(t: Inputs) -> DataFrame:
    names = {**{party: party for party in FIXTURE_PARTIES}, "": "blank"}
    return rel.pivot_sum(t.cand, S.PLACE_KEY, "party_ab", names, "votes")


def with_total_row(t: Inputs) -> DataFrame:
    measures = ["votes", "tcp_votes"]
    states = t.cand.groupBy("election", "state_ab").agg(*[na_sum(c).alias(c) for c in measures])
    return rel.with_total_row(states, ["election"], measures, {"state_ab": "Total"})


def share_of_total(t: Inputs) -> DataFrame:
    votes = t.cand.groupBy("election", "division_id", "candidate_id").agg(na_sum("votes").alias("votes"))
    return rounded(rel.share_of_total(votes, "votes", ["election", "division_id"]), "percent")


def share_of_nation(t: Inputs) -> DataFrame:
    """Each candidate's share of all votes of an election: one group per election, however many candidates."""
    votes = t.cand.groupBy("election", "division_id", "candidate_id").agg(zero_sum("votes").alias("votes"))
    return rounded(rel.share_of_total(votes, "votes", ["election"], parts=32), "percent")


def rollup_geo(t: Inputs) -> DataFrame:
    return rel.rollup_geo(t.cand, ["votes", "tcp_votes"], ["polling_place_id", "polling_place"])


def haversine(t: Inputs) -> DataFrame:
    """Distance of every polling place from one landmark, by both formulas."""
    at = [number("longitude"), number("latitude"), F.lit(151.2), F.lit(-33.87)]
    return t.pp.select(
        "election", "polling_place_id",
        F.round(haversine_km(*at), 6).alias("km"), F.round(haversine_km(*at, legacy=True), 6).alias("legacy_km"),
    )


PERCENT_TYPES = [*S.TYPE_COLUMNS, "total_votes"]
Query = Callable[[Inputs], DataFrame]

QUERIES: dict[str, Query] = {
    "scan_results_csv": scan_results_csv,
    "scan_state_union": scan_state_union,
    "election_registry": election_registry,
    "election_slice": lambda t: registry.election_slice({"cand": t.cand}, "cand", 2016),
    "election_slice_pp": lambda t: registry.election_slice({"pp": t.pp}, "pp", 2013),
    "election_slice_div": lambda t: registry.election_slice({"div": build_div(t)}, "div", 2013),
    "build_from_files": build_from_files,
    "build_pp": build_pp,
    "build_cand_base": build_cand_base,
    "build_cand_base_bucketed": build_cand_base_bucketed,
    "build_cand_declaration": build_cand_declaration,
    "build_cand": build_cand,
    "build_cand_own_early": lambda t: build_cand(t, early_source_election=None),
    "build_div": build_div,
    "materialise_tables": materialise_tables,
    "agg_na_sum": agg_na_sum,
    "agg_sum_zero": agg_sum_zero,
    "pivot_votes_by_type": pivot_votes_by_type,
    "pivot_votes_by_party": pivot_votes_by_party,
    "with_total_row": with_total_row,
    "share_of_total": share_of_total,
    "share_of_nation": share_of_nation,
    "rollup_geo": rollup_geo,
    "haversine_km": haversine,
    "div_table": lambda t: rounded(division_tables.div_table(t.cand), "percent"),
    "div_table_one": lambda t: rounded(division_tables.div_table(t.stored("cand"), 2016, ONE_DIVISION), "percent"),
    "div_table_informal": lambda t: rounded(division_tables.div_table_informal(t.cand), "percent"),
    "div_tcp": lambda t: rounded(division_tables.div_tcp(t.cand), "percent"),
    "div_tcp_percent": lambda t: rounded(division_tables.div_tcp_percent(t.cand), *PERCENT_TYPES),
    "div_pp_tcp": lambda t: rounded(tcp_places.div_pp_tcp(t.cand), "percent"),
    "div_pp_tcp_one": lambda t: rounded(tcp_places.div_pp_tcp(t.stored("cand"), 2016, ONE_DIVISION), "percent"),
    "div_pp_tcp_pairs": lambda t: rounded(
        tcp_places.div_pp_tcp_wide(t.stored("cand")), "percent_first", "percent_second"
    ),
    "div_pp_tcp_wide": lambda t: rounded(
        tcp_places.div_pp_tcp_wide(t.cand, ("ALP", "LP")), "percent_ALP", "percent_LP"
    ),
    "div_summary": lambda t: division_tables.div_summary(t.cand)[0],
    "div_summary_tcp": lambda t: division_tables.div_summary(t.cand)[1],
    "ordinary_by_candidate": lambda t: division_tables.ordinary_by_candidate(t.cand),
    "pp_by_party": lambda t: party_tables.pp_by_party(t.cand),
    "pp_by_party_wide": lambda t: party_tables.pp_by_party_wide(t.cand, FIXTURE_PARTIES),
    "pp_by_party_percent": lambda t: rounded(party_tables.pp_by_party_percent(t.cand), "percent"),
    "pp_by_party_percent_legacy": lambda t: rounded(
        party_tables.pp_by_party_percent(t.stored("cand"), legacy_formal=True), "percent"
    ),
    "pp_party_groups": lambda t: party_tables.pp_party_groups(t.cand),
    "pp_party_groups_legacy": lambda t: party_tables.pp_party_groups(t.stored("cand"), legacy_formal=True),
    "pp_party_groups_legacy_one": lambda t: party_tables.pp_party_groups(
        t.stored("cand"), 2007, ONE_DIVISION, legacy_formal=True
    ),
    "pp_party_groups_pct": lambda t: rounded(party_tables.pp_party_groups_percent(t.cand), *S.PARTY_GROUPS),
    "div_by_party": lambda t: party_tables.div_by_party(t.cand),
    "div_party_groups": lambda t: party_tables.div_party_groups(t.cand),
    "div_party_groups_legacy": lambda t: party_tables.div_party_groups(t.stored("cand"), legacy_formal=True),
    "div_votes_by_type": lambda t: vote_type_tables.div_votes_by_type(t.cand),
    "div_votes_by_type_pct": lambda t: rounded(
        vote_type_tables.div_votes_by_type(t.cand, percentage=True), *S.TYPE_COLUMNS, "total_ordinary"
    ),
    "nat_type_by_year": lambda t: vote_type_tables.nat_type_by_year(t.cand, 2004),
    "nat_type_by_year_pct": lambda t: rounded(
        vote_type_tables.nat_type_by_year(t.cand, 2004, percentage=True), *S.TYPE_COLUMNS
    ),
    "nat_type_by_year_skip_missing": lambda t: vote_type_tables.nat_type_by_year(t.cand, 2004, skip_missing=True),
    "nat_type_by_year_skip_missing_pct": lambda t: rounded(
        vote_type_tables.nat_type_by_year(t.cand, 2004, percentage=True, skip_missing=True), *S.TYPE_COLUMNS
    ),
    "state_primary_by_group": lambda t: party_tables.state_primary_by_group(t.cand),
    "state_primary_pct": lambda t: rounded(
        party_tables.state_primary_by_group(t.cand, percentage=True), *S.PARTY_GROUPS, "informal"
    ),
    "state_primary_pct_legacy": lambda t: rounded(
        party_tables.state_primary_by_group(t.stored("cand"), percentage=True, legacy_formal=True),
        *S.PARTY_GROUPS, "informal",
    ),
    "national_primary_by_group": lambda t: party_tables.state_primary_by_group(t.cand, national=True),
    "nat_primary_by_year": lambda t: party_tables.nat_primary_by_year(t.cand, 2007),
    "nat_primary_by_year_pct": lambda t: rounded(
        party_tables.nat_primary_by_year(t.cand, 2004, percentage=True), *S.PARTY_GROUPS, "informal"
    ),
    "nat_primary_pct_legacy": lambda t: rounded(
        party_tables.nat_primary_by_year(t.stored("cand"), 2004, percentage=True, legacy_formal=True),
        *S.PARTY_GROUPS, "informal",
    ),
    "pp_distance": lambda t: rounded(place_movement.pp_distance(t.pp, EARLIER, LATER), "distance"),
    "pp_distance_legacy": lambda t: rounded(place_movement.pp_distance(t.pp, EARLIER, LATER, legacy=True), "distance"),
    "pp_status_counts": lambda t: place_movement.pp_status_counts(t.pp, EARLIER, LATER),
    "pp_geocode_changes": lambda t: rounded(place_movement.pp_geocode_changes(t.pp, EARLIER, LATER), "distance"),
    "pp_tcp_swing": lambda t: rounded(tcp_places.pp_tcp_swing(t.stored("cand", EARLIER, LATER), EARLIER, LATER), "swing"),
    "pp_tcp_swing_alp": lambda t: rounded(
        tcp_places.pp_tcp_swing(t.stored("cand", EARLIER, LATER), EARLIER, LATER, "ALP"), "swing"
    ),
    "check_division_totals": lambda t: reconciliation.division_totals(t.cand, t.pp),
    "check_state_informal": lambda t: reconciliation.state_informal(t.cand),
    "check_candidate_type": lambda t: reconciliation.candidate_type(t.cand),
    "check_candidate_declaration": lambda t: reconciliation.candidate_declaration(t.cand),
    "check_division_candidate_totals": lambda t: reconciliation.division_candidate_totals(t.cand),
    "check_tpp_totals": lambda t: reconciliation.tpp_totals(t.pp),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(query: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: query(Inputs(spark, sf_dir))

    return {name: bound(query) for name, query in QUERIES.items()}
