"""Primary votes added up by party group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.missing import percent_of, zero_sum
from tallyframe.functions.parties import party_group
from tallyframe.schemas import GROUP_MEASURES, PARTY_GROUPS


def sum_by_group(labelled: DataFrame, by: list[str], formal: Column | None = None) -> DataFrame:
    """Party groups, informal, formal and all votes per ``by`` group in one aggregation; absent groups are 0.

    ``labelled`` has ``party`` and ``votes``. ``formal`` says which rows are formal votes (default: not informal).
    """
    group = F.col("party_group")
    formal = group != "informal" if formal is None else formal
    return (
        labelled.withColumn("party_group", party_group(F.col("party")))
        .groupBy(*by)
        .agg(
            *[zero_sum("votes", group == name).alias(name) for name in [*PARTY_GROUPS, "informal"]],
            zero_sum("votes", formal).alias("total_formal"),
            zero_sum("votes").alias("total_pp"),
        )
        .select(*by, *GROUP_MEASURES)
    )


def group_percentages(groups: DataFrame) -> DataFrame:
    """Groups as percentages of formal votes, informal as a percentage of all votes (rows do not add to 100)."""
    shares = {name: percent_of(name, "total_formal") for name in PARTY_GROUPS}
    return groups.withColumns({**shares, "informal": percent_of("informal", "total_pp")})
