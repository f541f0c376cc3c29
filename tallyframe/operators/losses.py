"""Counts that are taken while tables are written, in the same pass: values lost to casts, and totals of what was written."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyframe.functions.missing import cell_sum, number
from tallyframe.schemas import INFORMAL_STATES, STATES, TABLE_ELECTIONS, TPP_COLUMNS


def lost(column: str) -> Column:
    """Whether a text is neither blank nor missing and still no number."""
    return F.coalesce(F.btrim(column, F.lit(" \t\r\n")) != "", F.lit(False)) & number(column).isNull()


#: Column in which a table tells, per column, whether a row's text was lost; ``write_tables`` counts it and takes it off.
LOST = "__lost"


def to_numbers(table: DataFrame, columns: list[str], mark: bool = False) -> DataFrame:
    """The columns cast by ``number``; with ``mark``, LOST tells which texts of a row are lost by it."""
    if mark:
        table = table.withColumn(LOST, F.struct(*[lost(c).alias(c) for c in columns]))
    return table.withColumns({c: number(c) for c in columns})


class Losses:
    """How many texts of each column a build could not read as numbers, counted while its tables are written.

    The counts are taken where rows are written, behind the last shuffle: whatever runs before, to choose ranges or
    again after a loss, counts nothing.
    """

    def __init__(self) -> None:
        self._of: dict[str, Observation] = {}

    def watch(self, name: str, table: DataFrame) -> DataFrame:
        """The table, its losses being counted wherever it is written next."""
        if LOST not in table.columns:
            return table
        self._of[name] = Observation(f"losses of {name}")
        columns = table.schema[LOST].dataType.names
        return table.observe(self._of[name], *[F.count_if(F.col(LOST)[c]).alias(c) for c in columns])

    def counts(self, name: str) -> dict[str, int]:
        """By column. Waits until the table is written."""
        return dict(self._of[name].get)


class Totals:
    """Reconciliation totals of tables while they are written: of ``cand`` the votes by election, state and informality and
    the votes by election, of ``pp`` the two-party-preferred votes by election; without reading anything again.

    Elections and states are fixed lists, so the totals are a fixed number of sums; rows of further states are counted
    under no state. The sums miss as in the checks: one missing value makes a sum missing.
    """

    def __init__(self, states: Collection[str] = STATES) -> None:
        self.states = list(states)
        self._of: dict[str, Observation] = {}
        self._keys: dict[str, dict[str, tuple]] = {}

    def watch(self, name: str, table: DataFrame) -> DataFrame:
        """The table, its totals being taken wherever it is written next."""
        sums: dict[tuple, Column] = {}
        for election in TABLE_ELECTIONS.get(name, ()):
            here = F.col("election") == election
            if name == "cand":
                sums["votes", election] = _sum("votes", here)
                for state in [*self.states, None]:
                    inside = F.col("state_ab") == state if state else ~F.coalesce(F.col("state_ab").isin(self.states), F.lit(False))
                    for informal in INFORMAL_STATES:
                        rows = here & inside & F.col("informal").eqNullSafe(F.lit(informal))
                        sums["votes", election, state, informal] = _sum("votes", rows)
            elif name == "pp":
                for column in TPP_TOTALS:
                    sums[column, election] = _sum(column, here)
        if not sums:
            return table
        self._of[name] = Observation(f"totals of {name}")
        self._keys[name] = {f"n{k}": key for k, key in enumerate(sums)}
        return table.observe(self._of[name], *[value.alias(f"n{k}") for k, value in enumerate(sums.values())])

    def _rows(self, name: str) -> list[tuple]:
        found = self._of[name].get
        return [(*key, found[column]["n"], found[column]["total"]) for column, key in self._keys[name].items() if found[column]["n"]]

    def by_state(self) -> list[tuple]:
        """(election, state or None, informal, votes) as ``check_state_informal`` gives them, states outside the list being
        one. Waits until ``cand`` is written."""
        return [(row[1], row[2], row[3], row[-1]) for row in self._rows("cand") if len(row) == 6]

    def votes(self) -> dict[int, float | None]:
        """All candidate votes by election. Waits until ``cand`` is written."""
        return {row[1]: row[-1] for row in self._rows("cand") if len(row) == 4}

    def tpp(self) -> dict[int, dict[str, float | None]]:
        """Two-party-preferred totals by election. Waits until ``pp`` is written."""
        out: dict[int, dict[str, float | None]] = {}
        for column, election, _, total in self._rows("pp"):
            out.setdefault(election, {})[column] = total
        return out


TPP_TOTALS = [c for c in TPP_COLUMNS.values() if c.endswith("_votes")]


def _sum(value: str, rows: Column) -> Column:
    return F.struct(F.count_if(rows).alias("n"), cell_sum(value, rows).alias("total"))
