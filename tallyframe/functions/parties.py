"""Party labels and party groups as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.schemas import (
    COALITION_AFTER_2010,
    COALITION_BEFORE_2010,
    COALITION_IN_2010,
    INFORMAL,
    INFORMAL_CANDIDATE,
)


def party_label() -> Column:
    """The party, with the informal pseudo candidate as a party of its own; missing for a missing candidate."""
    candidate = F.col("candidate_id")
    return F.when(candidate.isNull(), F.lit(None)).when(candidate == INFORMAL_CANDIDATE, INFORMAL).otherwise(
        F.col("party_ab")
    )


def in_coalition(party: Column) -> Column:
    election = F.col("election")
    return (
        F.when(election > 2010, party.isin(*COALITION_AFTER_2010))
        .when(election == 2010, party.isin(*COALITION_IN_2010))
        .otherwise(party.isin(*COALITION_BEFORE_2010))
    )


def party_group(party: Column) -> Column:
    """coalition, alp, grn, informal, or others (which takes blank and missing parties)."""
    return (
        F.when(party == INFORMAL, "informal")
        .when(party == "ALP", "alp")
        .when(party == "GRN", "grn")
        .when(in_coalition(party), "coalition")
        .otherwise("others")
    )
