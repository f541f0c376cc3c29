"""Build the polling-place table from raw files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.losses import to_numbers
from tallyframe.operators.relational import Join, null_safe_join
from tallyframe.schemas import TPP_COLUMNS


def build_pp(
    places: DataFrame, tpp: DataFrame, mark_losses: bool = False, join: Join = null_safe_join
) -> DataFrame:
    """All columns of the places file plus the two-party-preferred result of each place.

    Coordinates stay text: whether a place was re-surveyed is decided on the published text. ``mark_losses`` marks texts
    that are no numbers; ``join`` says how tables are joined.
    """
    key = ["election", "polling_place_id"]
    results = tpp.select(*key, *[F.col(raw).alias(name) for raw, name in TPP_COLUMNS.items()])
    built = join(places, to_numbers(results, list(TPP_COLUMNS.values()), mark_losses), key)
    return built.select("election", *[F.col(c) for c in built.columns if c != "election"])
