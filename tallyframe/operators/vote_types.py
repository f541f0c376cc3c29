"""Votes split by vote type, in one pass over the candidate table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.missing import cell_sum
from tallyframe.schemas import DECLARATION, LAST_ELECTION_WITHOUT_PRE_POLL_ORDINARY, ORDINARY, TYPE_COLUMNS

# Declaration rows carry their vote type as the name of a pseudo polling place.
DECLARED_CELLS = {
    "absent": "Absent",
    "postal": "Postal",
    "pre_poll_declaration": "PrePollDeclaration",
    "provisional": "Provisional",
}
ORDINARY_CELLS = ["ordinary", "pre_poll_ordinary"]


def votes_by_type(cand: DataFrame, key: list[str], identity: list[str], measure: str = "votes") -> DataFrame:
    """One row per ``key`` and declared ``identity``: a column per vote type, ``total_ordinary``, ``total_votes``.

    The identity is that of the declaration rows; ordinary votes attach to it by ``key`` alone. A key with only
    ordinary rows is left out. A vote type without rows is NULL, and so is every total that needs it.

    The result is partitioned by election and division, so division-level steps after it need no shuffle; only
    rows already summed to ``key`` are moved there.
    """
    declared = F.col("type") == DECLARATION
    ordinary = F.col("type") == ORDINARY
    early = F.col("early") == 1
    counts_early = F.col("election") > LAST_ELECTION_WITHOUT_PRE_POLL_ORDINARY

    cells = {name: declared & (F.col("polling_place") == place) for name, place in DECLARED_CELLS.items()}
    cells["ordinary"] = ordinary & (~counts_early | ~early)
    cells["pre_poll_ordinary"] = ordinary & counts_early & early

    is_declared = F.col("is_declared")
    of_key = Window.partitionBy(*key)
    grouped = (
        cand.where(declared | ordinary)
        .groupBy(*key, declared.alias("is_declared"), *[F.when(declared, F.col(c)).alias(c) for c in identity])
        .agg(*[cell_sum(measure, rows).alias(name) for name, rows in cells.items()])
    )
    total_ordinary = F.when(counts_early, F.col("ordinary") + F.col("pre_poll_ordinary")).otherwise(F.col("ordinary"))
    total_votes = sum((F.col(name) for name in DECLARED_CELLS), F.col("total_ordinary"))
    return (
        grouped.repartition("election", "division_id")
        # A key has at most one row of ordinary sums, so max() just fetches it.
        .withColumns({c: F.max(F.when(~is_declared, F.col(c))).over(of_key) for c in ORDINARY_CELLS})
        .where(is_declared)
        .withColumn("total_ordinary", total_ordinary)
        .withColumn("total_votes", total_votes)
        .select(*key, *identity, *TYPE_COLUMNS, "total_ordinary", "total_votes")
    )
