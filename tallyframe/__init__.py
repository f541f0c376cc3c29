"""Election tabulation on PySpark: keyed DataFrame queries over polling-place, candidate and division tables."""

from tallyframe.operators.losses import Losses, Totals
from tallyframe.plans.division_tables import (
    div_summary,
    div_table,
    div_table_informal,
    div_tcp,
    div_tcp_percent,
    ordinary_by_candidate,
)
from tallyframe.plans.party_tables import (
    div_by_party,
    div_party_groups,
    nat_primary_by_year,
    pp_by_party,
    pp_by_party_percent,
    pp_by_party_wide,
    pp_party_groups,
    pp_party_groups_percent,
    state_primary_by_group,
)
from tallyframe.plans.place_movement import pp_distance, pp_geocode_changes, pp_status_counts
from tallyframe.plans.tables_build import build_tables
from tallyframe.plans.tcp_places import div_pp_tcp, div_pp_tcp_wide, pp_tcp_swing
from tallyframe.plans.vote_type_tables import div_votes_by_type, nat_type_by_year
from tallyframe.sources.registry import election_slice
from tallyframe.sources.store import read_tables, write_tables

__all__ = [
    "Losses", "Totals", "build_tables", "div_by_party", "div_party_groups", "div_pp_tcp", "div_pp_tcp_wide", "div_summary", "div_table",
    "div_table_informal", "div_tcp", "div_tcp_percent", "div_votes_by_type", "election_slice", "nat_primary_by_year",
    "nat_type_by_year", "ordinary_by_candidate", "pp_by_party", "pp_by_party_percent", "pp_by_party_wide",
    "pp_distance", "pp_geocode_changes", "pp_party_groups", "pp_party_groups_percent", "pp_status_counts",
    "pp_tcp_swing", "read_tables", "state_primary_by_group", "write_tables",
]
