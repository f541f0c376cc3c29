"""Votes by type per division and per election."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.missing import na_sum, percent_of
from tallyframe.operators.relational import restrict
from tallyframe.operators.vote_types import votes_by_type
from tallyframe.schemas import TYPE_COLUMNS, TYPE_MEASURES
from tallyframe.sources.registry import elections_from


def div_votes_by_type(
    cand: DataFrame,
    elections: Collection[int] | None = None,
    divisions: Collection[str] | None = None,
    percentage: bool = False,
) -> DataFrame:
    """All votes of each division by vote type; with ``percentage``, as percent of the division's votes."""
    rows = restrict(cand, elections, divisions)
    table = votes_by_type(rows, ["election", "division_id"], ["state_ab", "division_nm"])
    if percentage:
        measures = [*TYPE_COLUMNS, "total_ordinary"]
        table = table.withColumns({c: percent_of(c, "total_votes") for c in measures}).drop("total_votes")
    return table


def nat_type_by_year(
    cand: DataFrame, start: int, percentage: bool = False, skip_missing: bool = False
) -> DataFrame:
    """National votes by type for every election from ``start`` on, oldest first.

    One division without a vote type makes the national figure missing, unless ``skip_missing``.
    """
    add = F.sum if skip_missing else na_sum
    divisions = div_votes_by_type(cand, elections_from(start))
    table = divisions.groupBy("election").agg(*[add(c).alias(c) for c in TYPE_MEASURES])
    columns = [*TYPE_COLUMNS, "total_votes"]
    if percentage:
        columns = TYPE_COLUMNS
        table = table.withColumns({c: percent_of(c, "total_votes") for c in columns})
    return table.select(*columns, "election").orderBy("election")
