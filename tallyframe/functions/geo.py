"""Great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.schemas import EARTH_RADIUS_KM


def haversine_km(long1: Column, lat1: Column, long2: Column, lat2: Column, legacy: bool = False) -> Column:
    """Distance in km between two points given in degrees; NULL when a coordinate is missing.

    ``legacy`` takes the cosine of the latitudes in degrees, as older published figures did. That product can
    turn negative, where those figures were undefined: NULL here.
    """
    cos_lat1, cos_lat2 = (F.cos(lat) if legacy else F.cos(F.radians(lat)) for lat in (lat1, lat2))
    half_lat = (F.radians(lat2) - F.radians(lat1)) / 2
    half_long = (F.radians(long2) - F.radians(long1)) / 2
    chord = F.pow(F.sin(half_lat), 2) + cos_lat1 * cos_lat2 * F.pow(F.sin(half_long), 2)
    # least() would skip a missing chord and report half the globe, so the upper bound is a CASE. NaN sorts above 1.
    bounded = F.when(F.isnan(chord), F.lit(None)).when(chord > 1, F.lit(1.0)).when(chord >= 0, F.sqrt(chord))
    return 2 * EARTH_RADIUS_KM * F.asin(bounded)
