"""Small inline tables for tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe import schemas as S

CAND_DEFAULTS = {
    "election": 2016, "state_ab": "NSW", "division_id": "101", "division_nm": "Alpha", "polling_place_id": None,
    "polling_place": "Absent", "candidate_id": "1", "surname": "Smith", "given_nm": "Jo", "ballot_position": 1.0,
    "elected": "N", "historic_elected": "N", "party_ab": "ALP", "party_nm": "Labor", "votes": 10.0, "swing": None,
    "tcp_votes": None, "tcp_swing": None, "type": S.DECLARATION, "early": 0, "informal": 0,
}
CAND_TYPES = {
    "election": "int", "early": "int", "informal": "int",
    **dict.fromkeys(["ballot_position", "votes", "swing", "tcp_votes", "tcp_swing"], "double"),
}

PP_DEFAULTS = {
    "election": 2016, "state": "NSW", "division_id": "101", "division_nm": "Alpha", "polling_place_id": "1",
    "polling_place_type_id": "1", "polling_place_nm": "Hall", "latitude": "-33.8", "longitude": "151.2",
    "tpp_coalition_votes": 1.0, "tpp_coalition_percent": 50.0, "tpp_alp_votes": 1.0, "tpp_alp_percent": 50.0,
    "tpp_total_votes": 2.0, "tpp_swing": 0.0,
}
PP_TYPES = {"election": "int", **dict.fromkeys(S.TPP_COLUMNS.values(), "double")}


def _table(spark, rows, defaults, types, columns) -> DataFrame:
    schema = ", ".join(f"{c} {types.get(c, 'string')}" for c in columns)
    values = [tuple({**defaults, **row}[c] for c in columns) for row in rows]
    return spark.createDataFrame(values, schema)


def cand_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return _table(spark, rows, CAND_DEFAULTS, CAND_TYPES, S.CAND_COLUMNS)


def pp_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return _table(spark, rows, PP_DEFAULTS, PP_TYPES, S.PP_COLUMNS)


def text_table(spark: SparkSession, rows: list[dict], election: int = 2016) -> DataFrame:
    """A raw frame: every column text, plus the election tag."""
    columns = list(rows[0])
    schema = ", ".join(["election int", *[f"{c} string" for c in columns]])
    return spark.createDataFrame([(election, *[row[c] for c in columns]) for row in rows], schema)


def declared(votes: dict[str, float], **row) -> list[dict]:
    """Declaration rows of one candidate, one per vote type."""
    return [{**row, "type": S.DECLARATION, "polling_place": place, "votes": v} for place, v in votes.items()]


def ordinary(place: str, votes: float | None, early: int = 0, **row) -> dict:
    return {
        **row, "type": S.ORDINARY, "polling_place": place, "polling_place_id": place, "votes": votes, "early": early,
    }


FOUR = {"Absent": 1.0, "Postal": 2.0, "PrePollDeclaration": 3.0, "Provisional": 4.0}


def records(df: DataFrame) -> list[dict]:
    return [row.asDict() for row in df.collect()]
