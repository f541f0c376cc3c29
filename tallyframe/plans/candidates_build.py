"""Build the candidate table: one row per candidate and polling place, declaration votes as pseudo places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.losses import LOST, to_numbers
from tallyframe.operators.relational import Join, null_safe_join
from tallyframe.schemas import (
    CAND_COLUMNS,
    CANDIDATE_COLUMNS,
    DECLARATION,
    DECLARATION_TYPES,
    EARLY_DECLARATION_TYPES,
    INFORMAL_BALLOT_POSITION,
    ORDINARY,
    PRE_POLL_CENTRE,
)


def build_cand_base(first_prefs: DataFrame, tcp: DataFrame, join: Join = null_safe_join) -> DataFrame:
    """First preferences by polling place with the two-candidate-preferred result; still text."""
    key = ["election", "candidate_id", "polling_place_id"]
    votes = first_prefs.select(
        *CANDIDATE_COLUMNS, "polling_place_id", "polling_place",
        F.col("ordinary_votes").alias("votes"), "swing",
    )
    results = tcp.select(*key, F.col("ordinary_votes").alias("tcp_votes"), F.col("swing").alias("tcp_swing"))
    return join(votes, results, key)


def build_cand_declaration(
    first_prefs_by_type: DataFrame, tcp_by_type: DataFrame, join: Join = null_safe_join
) -> DataFrame:
    """Declaration votes, one row per candidate and vote type, the type standing in for the place; still text.

    Both files are wide, so they are joined wide and only then turned to rows: a quarter of the rows to shuffle.
    """
    key = ["election", "division_id", "candidate_id"]
    wide = first_prefs_by_type.select(*CANDIDATE_COLUMNS, *DECLARATION_TYPES.values())
    results = tcp_by_type.select(*key, *[F.col(c).alias(f"tcp_{c}") for c in DECLARATION_TYPES.values()])
    blocks = [
        F.struct(
            F.lit(place).alias("polling_place"),
            F.col(column).alias("votes"),
            F.col(f"tcp_{column}").alias("tcp_votes"),
            F.lit(1 if place in EARLY_DECLARATION_TYPES else 0).alias("early"),
        )
        for place, column in DECLARATION_TYPES.items()
    ]
    return (
        join(wide, results, key)
        .select(*CANDIDATE_COLUMNS, F.inline(F.array(*blocks)))
        .withColumn("type", F.lit(DECLARATION))
    )


def mark_early(ordinary: DataFrame, pp: DataFrame, early_source_election: int | None = 2016) -> DataFrame:
    """``early`` = 1 at pre-poll centres, else 0.

    Published tables take the centres of 2016 for every election; ``None`` takes those of the row's own election.
    """
    centres = pp.where(F.col("polling_place_type_id") == PRE_POLL_CENTRE)
    key = ["election", "polling_place_id"]
    if early_source_election is not None:
        centres = centres.where(F.col("election") == early_source_election)
        key = ["polling_place_id"]
    flags = centres.select(*key).distinct().withColumn("early", F.lit(1))
    return null_safe_join(ordinary, flags, key).withColumn("early", F.coalesce("early", F.lit(0)))


def build_cand(
    first_prefs: DataFrame,
    tcp: DataFrame,
    first_prefs_by_type: DataFrame,
    tcp_by_type: DataFrame,
    pp: DataFrame,
    early_source_election: int | None = 2016,
    mark_losses: bool = False,
    join: Join = null_safe_join,
) -> DataFrame:
    """``mark_losses`` marks texts that are no numbers; ``join`` says how the large files are joined."""
    base = build_cand_base(first_prefs, tcp, join).withColumn("type", F.lit(ORDINARY))
    ordinary = mark_early(base, pp, early_source_election)
    declared = build_cand_declaration(first_prefs_by_type, tcp_by_type, join)
    is_informal = F.col("ballot_position") == INFORMAL_BALLOT_POSITION  # text against text, before the cast
    informal = F.when(F.col("ballot_position").isNotNull(), is_informal.cast("int"))
    numbers = ["ballot_position", "votes", "swing", "tcp_votes", "tcp_swing"]
    rows = ordinary.unionByName(declared, allowMissingColumns=True).withColumn("informal", informal)
    return to_numbers(rows, numbers, mark_losses).select(*CAND_COLUMNS, *[LOST] * mark_losses)
