"""Cross-checks of the built tables against each other."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.missing import na_sum
from tallyframe.operators.relational import null_safe_join, restrict
from tallyframe.schemas import DECLARATION, DIVISION_KEY

Elections = Collection[int] | None
Divisions = Collection[str] | None


def division_candidate_totals(cand: DataFrame, elections: Elections = None) -> DataFrame:
    return restrict(cand, elections).groupBy(*DIVISION_KEY).agg(na_sum("votes").alias("total_cand"))


def division_totals(cand: DataFrame, pp: DataFrame, elections: Elections = None) -> DataFrame:
    """Candidate votes of each division next to its polling places' two-party-preferred total.

    The two differ by construction (declaration and informal votes); ``difference`` shows by how much.
    """
    key = ["election", "division_id"]
    places = restrict(pp, elections).groupBy(*key).agg(na_sum("tpp_total_votes").alias("total_pp"))
    joined = null_safe_join(division_candidate_totals(cand, elections), places, key)
    return joined.withColumn("difference", F.col("total_cand") - F.col("total_pp"))


def state_informal(cand: DataFrame, elections: Elections = None) -> DataFrame:
    return restrict(cand, elections).groupBy("election", "state_ab", "informal").agg(na_sum("votes").alias("votes"))


def candidate_type(cand: DataFrame, elections: Elections = None, divisions: Divisions = None) -> DataFrame:
    rows = restrict(cand, elections, divisions)
    return rows.groupBy(*DIVISION_KEY, "surname", "type").agg(na_sum("votes").alias("votes"))


def candidate_declaration(cand: DataFrame, elections: Elections = None, divisions: Divisions = None) -> DataFrame:
    rows = restrict(cand, elections, divisions).where(F.col("type") == DECLARATION)
    return rows.groupBy(*DIVISION_KEY, "surname", "polling_place").agg(na_sum("votes").alias("votes"))


def tpp_totals(pp: DataFrame, elections: Elections = None) -> DataFrame:
    measures = ["tpp_coalition_votes", "tpp_alp_votes", "tpp_total_votes"]
    totals = restrict(pp, elections).groupBy("election", "division_nm").agg(*[na_sum(c).alias(c) for c in measures])
    return totals.withColumn("total", F.col("tpp_coalition_votes") + F.col("tpp_alp_votes"))
