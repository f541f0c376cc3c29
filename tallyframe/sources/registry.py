"""The registry of elections: which exist, under which event id, and which tables cover them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.schemas import EVENT_IDS, TABLE_ELECTIONS


def event_id(election: int) -> int:
    if election not in EVENT_IDS:
        raise ValueError(f"unknown election {election}; registered: {sorted(EVENT_IDS)}")
    return EVENT_IDS[election]


def _event_ids() -> Column:
    return F.create_map(*[F.lit(value) for pair in EVENT_IDS.items() for value in pair])


def elections_table(spark: SparkSession) -> DataFrame:
    return spark.range(0, 1, 1, 1).select(F.explode(_event_ids()).alias("election", "event_id"))


def elections_from(start: int, table: str = "cand") -> list[int]:
    """Registered elections from ``start`` on, oldest first; all of them must have the table."""
    event_id(start)
    wanted = sorted(year for year in EVENT_IDS if year >= start)
    missing = [year for year in wanted if year not in TABLE_ELECTIONS[table]]
    if missing:
        raise ValueError(f"no {table} table for {missing}; it covers {TABLE_ELECTIONS[table]}")
    return wanted


def election_slice(tables: dict[str, DataFrame], table: str, election: int) -> DataFrame:
    """One table's rows for one election; a partition-pruned read on stored tables."""
    if table not in TABLE_ELECTIONS:
        raise ValueError(f"unknown table {table!r}; known: {sorted(TABLE_ELECTIONS)}")
    if election not in TABLE_ELECTIONS[table]:
        raise ValueError(f"no {table} table for {election}; it covers {TABLE_ELECTIONS[table]}")
    return tables[table].where(F.col("election") == election)


def event_id_column() -> Column:
    """Each row's event id by its election. The registry is a literal, so the lookup is a map, not a join."""
    return F.try_element_at(_event_ids(), F.col("election"))
