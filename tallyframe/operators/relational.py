"""Small relational building blocks used by several queries."""

from __future__ import annotations

from collections.abc import Callable, Collection
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.missing import cell_sum, na_sum, percent_of, share, zero_sum
from tallyframe.schemas import EVENT_IDS


def several(value):
    """One value or a collection of them, as a list; None stays None."""
    if value is None or isinstance(value, (list, tuple)):
        return value
    return [value] if isinstance(value, (str, int)) else list(value)


def restrict(
    table: DataFrame, elections: Collection[int] | int | None = None, divisions: Collection[str] | str | None = None
) -> DataFrame:
    """Keep the given elections and division names, one or several. Both are plain predicates, so they reach the scan.

    Unknown elections are refused by the registry. Division names, which only the table knows, are looked for when the
    query runs: it then fails if one of them is not among the chosen rows. Nothing runs before.
    """
    elections, divisions = several(elections), several(divisions)
    if elections is not None:
        unknown = sorted(set(elections) - set(EVENT_IDS))
        if unknown:
            raise ValueError(f"unknown elections {unknown}; registered: {sorted(EVENT_IDS)}")
        table = table.where(F.col("election").isin(*elections))
    if divisions is not None:
        table = table.where(F.col("division_nm").isin(*divisions))
        table = table.where(_all_found(table, sorted(set(divisions))))
    return table


def alone(rows: DataFrame) -> DataFrame:
    """Distinct rows, of which there are few, in one partition. They are made distinct in all tasks before."""
    return rows.distinct().coalesce(1)


def _all_found(chosen: DataFrame, divisions: list[str]) -> Column:
    """True, or an error that names the divisions without a row; a subquery over one column of the chosen rows."""
    found = F.collect_set("division_nm")  # of the given names
    unknown = F.array_except(F.array(*map(F.lit, divisions)), found)
    message = F.concat(F.lit("unknown divisions "), F.array_join(unknown, ", "))
    known = F.when(F.size(unknown) == 0, True).otherwise(F.raise_error(message).cast("boolean"))
    return alone(chosen.select("division_nm")).agg(known.alias("known")).scalar()


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` with missing matching missing; each key comes out once.

    ``<=>`` on plain columns is still planned as a hash or sort-merge join.
    """
    renamed = right.withColumnsRenamed({key: f"__{key}" for key in keys})
    matches: Column = reduce(and_, (F.col(key).eqNullSafe(F.col(f"__{key}")) for key in keys))
    return left.join(renamed, matches, how).drop(*[f"__{key}" for key in keys])


Join = Callable[[DataFrame, DataFrame, list[str]], DataFrame]


def full_join(left: DataFrame, right: DataFrame, key: str, parts: int = 16) -> DataFrame:
    """Full outer join on one column with missing matching missing.

    All rows without a key match each other, and adaptive execution splits no full join. So these rows are dealt over
    ``parts`` by ``parts`` cells: those of the left by row, those of the right by column, each standing in every cell of
    its row or column. A row that meets no other there is left only if the other side has no rows without a key.
    """
    other, empty = F.col(f"__{key}"), F.col(key).isNull()
    everywhere = F.sequence(F.lit(0), F.lit(parts - 1))

    def dealt(table: DataFrame, own: str, all_of: str) -> DataFrame:
        part = F.when(empty, F.pmod(F.xxhash64(*table.columns), F.lit(parts)).cast("int")).otherwise(0)
        cells = F.when(empty, everywhere).otherwise(F.array(F.lit(0)))
        return table.withColumn(own, part).withColumn(all_of, F.explode(cells))

    def has_empty(table: DataFrame) -> Column:
        return alone(table.where(empty).select(F.lit(1).alias("one"))).agg((F.count("one") > 0).alias("some")).scalar()

    a = dealt(left, "__row", "__column")
    b = dealt(right, "__column", "__row").withColumnsRenamed({key: f"__{key}", "__row": "__r", "__column": "__c"})
    row, column = F.col("__row"), F.col("__column")
    joined = a.join(b, F.col(key).eqNullSafe(other) & (row == F.col("__r")) & (column == F.col("__c")), "full")
    only_left, only_right = F.col("__r").isNull(), row.isNull()
    kept = (
        F.coalesce(F.col(key), other).isNotNull()
        | ~(only_left | only_right)
        | (only_left & (column == 0) & ~has_empty(right))
        | (only_right & (F.col("__r") == 0) & ~has_empty(left))
    )
    joined = joined.where(kept).withColumn(key, F.coalesce(F.col(key), other))
    return joined.drop(f"__{key}", "__row", "__column", "__r", "__c")


def with_total_row(rows: DataFrame, by: list[str], measures: list[str], labels: dict[str, str]) -> DataFrame:
    """Append one total per ``by`` group: ``na_sum`` of the measures, ``labels`` as text, other columns missing.

    Every row is counted twice, as itself and towards its total, so detail and totals come out of one
    aggregation and the input is read once. A row number keeps rows apart that differ in their measures alone.
    Rows already partitioned by (a part of) ``by`` are not shuffled again. Adds ``is_total``.
    """
    is_total = F.col("is_total")
    described = [c for c in rows.columns if c not in by and c not in measures]
    keys = [F.when(is_total, F.lit(labels.get(c))).otherwise(F.col(c)).alias(c) for c in described]
    return (
        rows.withColumn("__row", F.monotonically_increasing_id())
        .withColumn("is_total", F.explode(F.array(F.lit(False), F.lit(True))))
        .groupBy(*by, *keys, "is_total", F.when(~is_total, F.col("__row")).alias("__row"))
        .agg(*[na_sum(c).alias(c) for c in measures])
        .drop("__row")
    )


def share_of_total(
    rows: DataFrame, value: str, over: list[str], name: str = "percent", parts: int | None = None
) -> DataFrame:
    """Each row's ``value`` as a percentage of its group's total. One missing value makes all shares of a group missing.

    A group is one window, so it lies in one task: meant for rows that are sums already, few to a group. With ``parts``,
    for groups of any size, totals are summed where the rows lie and joined back; the rows of a group are dealt over so
    many parts, in each of which its total stands. The rows are then read twice.
    """
    if parts is None:
        return rows.withColumn(name, share(value, over))
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("int")
    totals = rows.groupBy(*over).agg(na_sum(value).alias("__total"))
    totals = totals.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    joined = null_safe_join(rows.withColumn("__part", part), totals, [*over, "__part"])
    return joined.withColumn(name, percent_of(value, "__total")).drop("__total", "__part")


def pivot_sum(
    rows: DataFrame, by: list[str], column: str, values: Collection[str] | dict[str, str], measure: str,
    remainder: str = "other",
) -> DataFrame:
    """One column per listed value (a dict names them), holding ``na_sum`` of the measure; NULL where a combination is
    absent. The column ``remainder`` sums all other values, missing ones included, so that no row is left out."""
    names = values if isinstance(values, dict) else {value: value for value in values}
    at = F.col(column)
    listed = F.coalesce(at.isin(*names), F.lit(False))
    cells = [cell_sum(measure, at.eqNullSafe(value)).alias(name) for value, name in names.items()]
    return rows.groupBy(*by).agg(*cells, cell_sum(measure, ~listed).alias(remainder))


def rollup_geo(rows: DataFrame, measures: list[str], place: list[str]) -> DataFrame:
    """Totals (missing skipped) per polling place, division, state and nation, told apart by ``level``.

    Each level is summed from the one below, so rows are read and shuffled once; both branches of the union share
    that shuffle.
    """
    nation = ["election"]
    state = [*nation, "state_ab"]
    division = [*state, "division_id", "division_nm"]
    sums = [zero_sum(c).alias(c) for c in measures]
    level = (
        F.when(F.grouping("state_ab") == 1, "nation").when(F.grouping("division_id") == 1, "state").otherwise("division")
    )
    places = rows.groupBy(*division, *place).agg(*sums)
    divisions = places.groupBy(*division).agg(*sums)
    upper = divisions.groupingSets([division, state, nation], *division).agg(level.alias("level"), *sums)
    return places.withColumn("level", F.lit("place")).unionByName(upper, allowMissingColumns=True)
