"""Landed rows staged in buckets of a join key, so that joins on it need no shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.session import shared_folder

#: Column that holds the key of a staged table.
KEY = "__staged_key"


def encoded(columns: list[str]) -> Column:
    """One text for several columns, never missing, that is equal for equal columns only; missing equals missing."""
    parts = []
    for name in columns:
        text = F.col(name).cast("string")
        # The length in front keeps parts apart, whatever characters they hold.
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text)))
    return F.concat(*parts)


def staged(table: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """The table written in ``buckets`` by its key over ``columns`` to the shared folder, and read back.

    Each bucket is one file, sorted by the key. The table is known to its session's catalog under a name of its own and
    goes when the driver ends; ``session.release`` deletes it before. A key that many rows share fills one bucket, and
    joins of buckets are not split: stage tables whose rows have keys of their own on at least one side.
    """
    spark = table.sparkSession
    name = f"staged_{uuid.uuid4().hex}"
    folder = shared_folder(spark, "staged")
    (
        table.withColumn(KEY, encoded(columns))
        .repartition(buckets, KEY)  # as buckets are dealt, so that each is written by one task
        .write.bucketBy(buckets, KEY)
        .sortBy(KEY)
        .option("path", folder)
        .saveAsTable(name)
    )
    read = spark.table(name)
    read._shared_folder = folder
    return read


def staged_join(left: DataFrame, right: DataFrame, columns: list[str], how: str = "left") -> DataFrame:
    """Join of two staged tables on the columns they are staged by; missing matches missing, and each comes out once."""
    right = right.drop(*columns).withColumnRenamed(KEY, f"{KEY}_right")
    return left.join(right, F.col(KEY) == F.col(f"{KEY}_right"), how).drop(KEY, f"{KEY}_right")
