"""Build the division table: one row per division with how its seat was decided."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.relational import null_safe_join


def build_div(
    nominations: DataFrame,
    members_elected: DataFrame,
    changed_hands: DataFrame,
    decided_on_first_prefs: DataFrame,
    decided_on_prefs: DataFrame,
    non_classic: DataFrame,
) -> DataFrame:
    """``changed`` and ``nonclassic`` are 1 or missing, never 0."""
    key = ["election", "division_id"]
    elected = members_elected.select(
        *key,
        F.col("candidate_id").alias("elected_candidate_id"),
        F.col("given_nm").alias("elected_given_nm"),
        F.col("surname").alias("elected_surname"),
        F.col("party_ab").alias("elected_party"),
    )
    changed = changed_hands.select(
        *key, F.col("previous_party_ab").alias("previous_party"), F.lit(1).alias("changed")
    )
    decided = decided_on_first_prefs.select(*key, F.lit("First").alias("preferences")).unionByName(
        decided_on_prefs.select(*key, F.lit("Preferences").alias("preferences"))
    )
    contest = non_classic.select(
        *key,
        F.col("party_ab1").alias("nonclassic_party1"),
        F.col("party_ab2").alias("nonclassic_party2"),
        F.lit(1).alias("nonclassic"),
    )
    built = nominations.drop("transaction_id")
    for result in (elected, changed, decided, contest):
        built = null_safe_join(built, result, key)
    return built.select(*key, *[F.col(c) for c in built.columns if c not in key])
