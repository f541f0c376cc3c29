"""How polling places moved between two elections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.geo import haversine_km
from tallyframe.functions.missing import number
from tallyframe.operators.relational import full_join
from tallyframe.schemas import MOBILE_TEAM, SAME_PLACE_KM, TPP_COLUMNS

COORDINATES = ["latitude_x", "longitude_x", "latitude_y", "longitude_y"]


def _both(pp: DataFrame, earlier: int, later: int, columns: list[str]) -> DataFrame:
    """Places of two elections side by side (``_x`` earlier, ``_y`` later), including those of only one."""
    key = "polling_place_id"

    def side(election: int, suffix: str) -> DataFrame:
        rows = pp.where(F.col("election") == election)
        return rows.select(key, *[F.col(c).alias(f"{c}{suffix}") for c in columns])

    return full_join(side(earlier, "_x"), side(later, "_y"), key)


def _distance(legacy: bool):
    lat_x, long_x, lat_y, long_y = (F.col(c) for c in COORDINATES)
    return haversine_km(long_x, lat_x, long_y, lat_y, legacy)


def pp_distance(pp: DataFrame, earlier: int, later: int, legacy: bool = False) -> DataFrame:
    """Each place's distance between two elections and its ``status``.

    A place of the later election only has no earlier type to judge by, so its status is missing.
    """
    # All columns of the places, also those that only some files have; not the counts that the build adds.
    columns = [c for c in pp.columns if c not in ("election", "polling_place_id", *TPP_COLUMNS.values())]
    places = _both(pp, earlier, later, columns).withColumns({c: number(c) for c in COORDINATES})
    distance = F.col("distance")
    status = (
        F.when(F.col("polling_place_nm_y").isNull(), "Abolished")
        .when(distance.isNotNull(), F.when(distance < SAME_PLACE_KM, "Same").otherwise("Moved"))
        .when(F.col("polling_place_type_id_x").isNull(), F.lit(None))
        .when(F.col("polling_place_type_id_x") == MOBILE_TEAM, "Mobile")
        .otherwise("MissingGeo")
    )
    return places.withColumn("distance", _distance(legacy)).withColumn("status", status)


def pp_status_counts(pp: DataFrame, earlier: int, later: int, legacy: bool = False) -> DataFrame:
    return pp_distance(pp, earlier, later, legacy).groupBy("status").agg(F.count(F.lit(1)).alias("places"))


def pp_geocode_changes(pp: DataFrame, earlier: int, later: int, legacy: bool = False) -> DataFrame:
    """Places whose published coordinates differ as text, with the distance; rows with any gap are dropped."""
    lat_x, long_x, lat_y, long_y = (F.col(c) for c in COORDINATES)
    changed = _both(pp, earlier, later, ["polling_place_nm", "latitude", "longitude"]).where(
        (lat_x != lat_y) | (long_x != long_y)
    )
    numeric = changed.withColumns({c: number(c) for c in COORDINATES}).dropna("any")
    return numeric.withColumn("distance", _distance(legacy))
