"""Primary votes by party and party group: per polling place, division, state and nation."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.missing import percent_of, zero_sum
from tallyframe.functions.parties import in_coalition, party_label
from tallyframe.operators.party_groups import group_percentages, sum_by_group
from tallyframe.operators.relational import restrict
from tallyframe.schemas import DIVISION_KEY, INFORMAL, PARTY_GROUPS, PLACE_KEY, PLACE_SORT_KEY
from tallyframe.sources.registry import elections_from

Elections = Collection[int] | int | None
Divisions = Collection[str] | str | None


def _labelled(cand: DataFrame, elections: Elections, divisions: Divisions) -> DataFrame:
    return restrict(cand, elections, divisions).withColumn("party", party_label())


def _by_party(cand: DataFrame, by: list[str], elections: Elections, divisions: Divisions) -> DataFrame:
    rows = _labelled(cand, elections, divisions)
    return rows.groupBy(*by, F.col("party").alias("party_ab")).agg(zero_sum("votes").alias("votes"))


def pp_by_party(cand: DataFrame, elections: Elections = None, divisions: Divisions = None) -> DataFrame:
    """Votes by polling place and party, as rows; informal votes are a party, declaration types are places."""
    return _by_party(cand, PLACE_KEY, elections, divisions)


def pp_by_party_percent(
    cand: DataFrame, elections: Elections = None, divisions: Divisions = None, legacy_formal: bool = False
) -> DataFrame:
    """``pp_by_party`` as percent of the place's formal votes, without informal votes.

    Candidate rows hardly add up before the shuffle (a place has one of each), so they are dealt out by place at once
    and both the sums and the totals stay there.
    """
    rows = _labelled(cand, elections, divisions).where(~F.col("party").eqNullSafe(INFORMAL))
    counted = F.lit(True)
    if legacy_formal:
        rows, counted = _legacy_formal(rows, cand, elections)
    keys = [*PLACE_KEY, F.col("party").alias("party_ab"), counted.alias("counted")]
    votes = rows.repartition(*PLACE_KEY).groupBy(*keys).agg(zero_sum("votes").alias("votes"))
    of_place = Window.partitionBy(*PLACE_SORT_KEY)
    total = F.sum(F.when(F.col("counted"), F.col("votes"))).over(of_place)
    return votes.withColumn("percent", percent_of("votes", total)).drop("votes", "counted")


def div_by_party(cand: DataFrame, elections: Elections = None, divisions: Divisions = None) -> DataFrame:
    return _by_party(cand, DIVISION_KEY, elections, divisions)


def _legacy_formal(labelled: DataFrame, cand: DataFrame, elections: Elections) -> tuple[DataFrame, Column]:
    """Rows with their election's alphabetically last party, and which of them older published totals call formal.

    Those totals left that party out along with the informal votes; a missing party sorts last. It is the last of the
    whole election in ``cand``, whatever divisions the rows are of. The broadcast side has one row per election.
    """
    is_informal = F.col("party").eqNullSafe(INFORMAL)
    last = (
        _labelled(cand, elections, None).where(~is_informal)
        .groupBy("election")
        .agg(F.when(F.count(F.lit(1)) == F.count("party"), F.max("party")).alias("last_party"))
    )
    joined = labelled.join(F.broadcast(last), "election", "left")
    return joined, ~is_informal & ~F.col("party").eqNullSafe(F.col("last_party"))


def _groups(
    cand: DataFrame, by: list[str], elections: Elections, divisions: Divisions, legacy_formal: bool = False
) -> DataFrame:
    rows = _labelled(cand, elections, divisions)
    if legacy_formal:
        rows, formal = _legacy_formal(rows, cand, elections)
        return sum_by_group(rows, by, formal)
    return sum_by_group(rows, by)


def pp_party_groups(
    cand: DataFrame, elections: Elections = None, divisions: Divisions = None, legacy_formal: bool = False
) -> DataFrame:
    """One row per polling place: party groups, informal, formal and all votes."""
    return _groups(cand, PLACE_KEY, elections, divisions, legacy_formal)


def pp_party_groups_percent(
    cand: DataFrame, elections: Elections = None, divisions: Divisions = None, legacy_formal: bool = False
) -> DataFrame:
    """Party groups of each polling place as percent of its formal votes."""
    groups = pp_party_groups(cand, elections, divisions, legacy_formal)
    return groups.select(*PLACE_KEY, *[percent_of(c, "total_formal").alias(c) for c in PARTY_GROUPS])


def div_party_groups(
    cand: DataFrame, elections: Elections = None, divisions: Divisions = None, legacy_formal: bool = False
) -> DataFrame:
    return _groups(cand, DIVISION_KEY, elections, divisions, legacy_formal)


def pp_by_party_wide(
    cand: DataFrame, parties: list[str], elections: Elections = None, divisions: Divisions = None
) -> DataFrame:
    """One row per polling place, one column per listed party (NULL where it has no candidate), one for candidates
    without a party (``blank``), one for all parties not listed (``other``), then the groups.

    The groups and totals count every party, listed or not.
    """
    party = F.col("party")
    named = [*parties, INFORMAL]
    rows_of = {name: party.eqNullSafe(name) for name in named}
    rows_of["blank"] = party.eqNullSafe("")
    rows_of["other"] = ~F.coalesce(party.isin(*named, ""), F.lit(False))
    columns = {name: zero_sum("votes", rows) for name, rows in rows_of.items()}
    present = {name: F.count(F.when(rows, 1)) > 0 for name, rows in rows_of.items()}
    informal = party.eqNullSafe(INFORMAL)
    coalition = F.coalesce(in_coalition(party), F.lit(False))
    major = F.coalesce(party.isin("ALP", "GRN"), F.lit(False))
    return (
        _labelled(cand, elections, divisions)
        .groupBy(*PLACE_KEY)
        .agg(
            *[F.when(present[name], value).alias(name) for name, value in columns.items()],
            zero_sum("votes", coalition).alias("group_coalition"),
            zero_sum("votes", ~(informal | coalition | major)).alias("group_others"),
            zero_sum("votes", ~informal).alias("total_formal"),
            zero_sum("votes").alias("total_pp"),
        )
    )


def state_primary_by_group(
    cand: DataFrame, elections: Elections = None, national: bool = False, percentage: bool = False,
    legacy_formal: bool = False,
) -> DataFrame:
    """Primary votes by party group, per state or (``national``) per election: by election, largest total first.

    With ``percentage``, groups are percent of formal votes, informal is percent of all votes, and the total goes.
    """
    by = ["election"] if national else ["election", "state_ab"]
    groups = _groups(cand, by, elections, None, legacy_formal)
    total = F.col("total_pp")
    if percentage:
        groups = group_percentages(groups)
    columns = [*by, *PARTY_GROUPS, "informal", total.alias("total")]
    table = groups.orderBy("election", F.desc("total_pp")).select(*columns)
    return table.drop("total") if percentage else table


def nat_primary_by_year(
    cand: DataFrame, start: int, percentage: bool = False, legacy_formal: bool = False
) -> DataFrame:
    """National primary votes by party group for every election from ``start`` on, oldest first."""
    return state_primary_by_group(cand, elections_from(start), True, percentage, legacy_formal)
