"""The stored tables: Parquet, partitioned by election."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.operators.losses import LOST, Losses, Totals
from tallyframe.schemas import STORED_ORDER


def table_path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


def write_tables(
    tables: dict[str, DataFrame], root: str, totals: Totals | None = None, losses: Losses | None = None
) -> None:
    """Write each table, replacing only the elections it holds. ``totals`` and ``losses`` are taken in the same pass.

    Rows are dealt out by ranges of election, division and place, and adaptive execution merges small ranges: a small
    election is one file, a huge one many, each of few divisions, and a huge division is split by place. So a filter
    on divisions skips files and pages, neighbours compress well, and the rows of a place meet in one map task.
    """
    for name, table in tables.items():
        order = [column for column in STORED_ORDER if column in table.columns]
        rows = table.repartitionByRange(*order).sortWithinPartitions(*order)
        for watcher in (totals, losses):
            rows = rows if watcher is None else watcher.watch(name, rows)
        (
            rows.drop(LOST)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("election")
            .parquet(table_path(root, name))
        )


def read_tables(spark: SparkSession, root: str, names: tuple[str, ...] = ("cand", "pp", "div")) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(table_path(root, name)) for name in names}
