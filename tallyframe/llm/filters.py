"""What every task can be told of a table at bounded size: a bitmap of its hashed values, or a few rows of ids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest bitmap, in bits. Where values are many for it, more of others are let through by chance.
MAX_BITS = 1 << 27
#: Most rows of ids that a join sends to every task, lest it move texts or sets to them.
SENT_ROWS = 1 << 20


def bitmap(values: DataFrame, column: str) -> np.ndarray:
    """A bitmap of a column of well-mixed longs. Only its bytes come to the driver, never the values."""
    n = values.count()
    bits = min(MAX_BITS, 1 << max(15, (16 * n).bit_length()))
    rows = (
        values.select(F.pmod(F.col(column), F.lit(bits)).alias("bit"))
        .selectExpr("bit DIV 8 AS byte", "shiftleft(1, CAST(bit % 8 AS INT)) AS set")
        .groupBy("byte")
        .agg(F.bit_or("set").cast("short").alias("set"))
        .toArrow()
    )
    out = np.zeros(bits // 8, dtype=np.uint8)
    out[rows["byte"].to_numpy()] = rows["set"].to_numpy().astype(np.uint8)
    return out


def may_hold(made: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the values (longs or their bit patterns) may be in the table."""
    at = np.mod(values.view(np.int64), np.int64(8 * len(made)))
    return (made[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def asking(values: DataFrame, *columns: str) -> Callable[..., Column]:
    """A function of columns that says whether they may stand in a row of ``values`` (``columns``): surely if they do, and
    by chance if they do not. Only their hashes go to Python, whatever else a row holds; the bitmap goes to every task."""
    made = bitmap(values.select(F.xxhash64(*columns).alias("mark")), "mark")
    shared = values.sparkSession.sparkContext.broadcast(made)

    @F.pandas_udf("boolean")
    def held(marks: pd.Series) -> pd.Series:
        return pd.Series(may_hold(shared.value, marks.to_numpy()))

    return lambda *asked: held(F.xxhash64(*asked))


def sent_round(ids: DataFrame) -> DataFrame:
    """A stored table of ids, marked to go to every task if it has SENT_ROWS at most."""
    return F.broadcast(ids) if ids.count() <= SENT_ROWS else ids
