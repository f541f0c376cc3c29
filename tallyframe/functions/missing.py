"""Missing-value rules, stated once.

A sum is one of three kinds, and mixing them up is the main source of wrong tables:

* ``na_sum``    any missing value makes the sum missing;
* ``zero_sum``  missing values are skipped and an empty sum is 0;
* ``cell_sum``  a pivot cell: ``na_sum`` of the matching rows, missing when no row matches.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def na_sum(value: str | Column) -> Column:
    value = _column(value)
    return F.when(F.count_if(value.isNull()) == 0, F.sum(value))


def cell_sum(value: str | Column, rows: Column) -> Column:
    """``na_sum`` over the rows where ``rows`` holds; NULL when there are none."""
    value = _column(value)
    return F.when(F.count_if(rows & value.isNull()) == 0, F.sum(F.when(rows, value)))


def total_sum(value: str | Column, rows: Column) -> Column:
    """``na_sum`` over the rows where ``rows`` holds; 0 when there are none."""
    value = _column(value)
    total = F.coalesce(F.sum(F.when(rows, value)), F.lit(0.0))
    return F.when(F.count_if(rows & value.isNull()) == 0, total)


def zero_sum(value: str | Column, rows: Column | None = None) -> Column:
    value = _column(value)
    kept = value if rows is None else F.when(rows, value)
    return F.coalesce(F.sum(kept), F.lit(0.0))


def percent_of(part: str | Column, whole: str | Column) -> Column:
    """``part`` as a percentage of ``whole``; NULL when the whole is zero or missing."""
    return F.try_divide(_column(part), _column(whole)) * 100


def share(value: str | Column, over: WindowSpec | list[str], rows: Column | None = None) -> Column:
    """Percentage of the window's total. One missing value in the window makes every share missing.

    With ``rows``, only those rows count towards the total and only they get a share.
    """
    window = Window.partitionBy(*over) if isinstance(over, list) else over
    value = _column(value)
    rows = F.lit(True) if rows is None else rows
    complete = F.count_if(rows & value.isNull()).over(window) == 0
    return F.when(rows & complete, percent_of(value, F.sum(F.when(rows, value)).over(window)))


def number(value: str | Column) -> Column:
    """Text to double; text that is not a number becomes NULL instead of an error.

    A cast would also take a type suffix (``1d``, ``2.5f``), which no result file means as a number.
    """
    value = _column(value)
    return F.when(~value.rlike(r"[0-9.][dDfF]\s*$"), value.try_cast("double"))


def text_field(value: str | Column) -> Column:
    """A raw CSV field: blank or cut-off fields are empty text, the text ``NA`` is missing."""
    filled = F.coalesce(_column(value), F.lit(""))
    return F.when(filled != "NA", filled)
