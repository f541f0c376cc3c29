"""The derived tables in the shape of raw result files: text columns, one frame or landed file per family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe import schemas as S
from tallyframe.sources.registry import event_id_column

# Published spelling of the raw columns.
PUBLISHED = {
    "absent_votes": "AbsentVotes",
    "australian_labor_party_percentage": "Australian Labor Party Percentage",
    "australian_labor_party_votes": "Australian Labor Party Votes",
    "ballot_position": "BallotPosition",
    "candidate_id": "CandidateID",
    "division_id": "DivisionID",
    "division_nm": "DivisionNm",
    "elected": "Elected",
    "given_nm": "GivenNm",
    "historic_elected": "HistoricElected",
    "latitude": "Latitude",
    "liberal_national_coalition_percentage": "Liberal/National Coalition Percentage",
    "liberal_national_coalition_votes": "Liberal/National Coalition Votes",
    "longitude": "Longitude",
    "nominations": "Nominations",
    "ordinary_votes": "OrdinaryVotes",
    "party_ab": "PartyAb",
    "party_ab1": "PartyAb1",
    "party_ab2": "PartyAb2",
    "party_nm": "PartyNm",
    "polling_place": "PollingPlace",
    "polling_place_id": "PollingPlaceID",
    "polling_place_nm": "PollingPlaceNm",
    "polling_place_type_id": "PollingPlaceTypeID",
    "postal_votes": "PostalVotes",
    "pre_poll_votes": "PrePollVotes",
    "previous_party_ab": "PreviousPartyAb",
    "provisional_votes": "ProvisionalVotes",
    "state": "State",
    "state_ab": "StateAb",
    "surname": "Surname",
    "swing": "Swing",
    "total_votes": "TotalVotes",
    "transaction_id": "TransactionId",
}


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def first_prefs(cand: DataFrame) -> DataFrame:
    rows = cand.where(F.col("type") == S.ORDINARY)
    return rows.select(
        *S.DIVISION_KEY, "polling_place_id", "polling_place", "candidate_id", "surname", "given_nm",
        F.col("ballot_position").cast("int").cast("string").alias("ballot_position"), "elected", "historic_elected",
        "party_ab", "party_nm", _text("votes").alias("ordinary_votes"), _text("swing").alias("swing"),
    )


def tcp(cand: DataFrame) -> DataFrame:
    rows = cand.where((F.col("type") == S.ORDINARY) & F.col("tcp_votes").isNotNull())
    return rows.select(
        "election", "polling_place_id", "candidate_id",
        _text("tcp_votes").alias("ordinary_votes"), _text("tcp_swing").alias("swing"),
    )


def _wide(cand: DataFrame, by: list[str], measure: str) -> DataFrame:
    rows = cand.where((F.col("type") == S.DECLARATION) & F.col(measure).isNotNull())
    return rows.groupBy(*by).agg(
        *[
            F.sum(F.when(F.col("polling_place") == place, F.col(measure))).cast("string").alias(column)
            for place, column in S.DECLARATION_TYPES.items()
        ]
    )


def first_prefs_by_type(cand: DataFrame) -> DataFrame:
    position = F.col("ballot_position").cast("int").cast("string")
    return _wide(cand.withColumn("ballot_position", position), S.CANDIDATE_COLUMNS, "votes")


def tcp_by_type(cand: DataFrame) -> DataFrame:
    return _wide(cand, ["election", "division_id", "candidate_id"], "tcp_votes")


def places(pp: DataFrame) -> DataFrame:
    return pp.drop(*S.TPP_COLUMNS.values())


def tpp(pp: DataFrame) -> DataFrame:
    counted = pp.where(F.col("tpp_total_votes").isNotNull())
    return counted.select("election", "polling_place_id", *[_text(n).alias(raw) for raw, n in S.TPP_COLUMNS.items()])


def division_files(cand: DataFrame, divisions: DataFrame) -> dict[str, DataFrame]:
    """The six files the division table is built from, as keyword arguments of ``build_div``."""
    candidates = (
        cand.where(F.col("candidate_id") != S.INFORMAL_CANDIDATE)
        .select(*S.DIVISION_KEY, "candidate_id", "given_nm", "surname", "party_ab", "elected")
        .distinct()
    )
    nominations = candidates.groupBy(*S.DIVISION_KEY).agg(F.count(F.lit(1)).cast("string").alias("nominations"))
    key = ["election", "division_id"]
    elections = F.array(*[F.lit(election) for election in S.TABLE_ELECTIONS["cand"]])
    seats = divisions.withColumn("election", F.explode(elections))
    number = F.col("division_id").cast("int")
    on_first_prefs = number % 3 == 0
    return {
        "nominations": nominations.withColumn("transaction_id", F.lit("0")),
        "members_elected": candidates.where(F.col("elected") == "Y").select(
            *key, "candidate_id", "given_nm", "surname", "party_ab"
        ),
        "changed_hands": seats.where(number % 4 == 0).select(*key, F.lit("XEN").alias("previous_party_ab")),
        "decided_on_first_prefs": seats.where(on_first_prefs).select(*key),
        "decided_on_prefs": seats.where(~on_first_prefs).select(*key),
        "non_classic": seats.where(number % 6 == 0).select(
            *key, F.lit("GRN").alias("party_ab1"), F.lit("IND").alias("party_ab2")
        ),
    }


def staged_path(root: str, event: int, name: str) -> str:
    """Layout of ``land``: one folder of part files per published file."""
    return f"{root}/event_id={event}/file={name}"


def land(family: str, frame: DataFrame, root: str, by_state: bool = False) -> None:
    """Write one file family as banner-headed CSV, all elections (and states) in one distributed write.

    Banner and header travel together as the CSV writer's own, two-line header, so every part file starts with
    both. The writer puts its quote character around a header of two lines; a tab there is whitespace to a reader.
    """
    event = event_id_column()
    parts = [F.lit(family), event.cast("string"), *([F.col("state_ab")] if by_state else [])]
    fields = [c for c in frame.columns if c != "election"]
    line = F.to_csv(F.struct(*[F.coalesce(F.col(c), F.lit("NA")).alias(c) for c in fields]), {"escape": '"'})
    header = f"Election results, {family}\n{','.join(PUBLISHED[c] for c in fields)}"
    (
        frame.select(event.alias("event_id"), F.concat_ws("-", *parts).alias("file"), line.alias(header))
        .hint("rebalance", F.col("event_id"), F.col("file"))
        .write.mode("append")
        .partitionBy("event_id", "file")
        .option("header", True)
        .option("sep", "\u0001")
        .option("quote", "\t")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(root)
    )


def land_all(cand: DataFrame, pp: DataFrame, divisions: DataFrame, root: str) -> None:
    """Every file family of every election, as a build from files expects them."""
    division = division_files(cand, divisions)
    for family, frame in {
        S.POLLING_PLACES: places(pp),
        S.TPP_BY_PLACE: tpp(pp),
        S.TCP_BY_PLACE: tcp(cand),
        S.FIRST_PREFS_BY_TYPE: first_prefs_by_type(cand),
        S.TCP_BY_TYPE: tcp_by_type(cand),
        S.NOMINATIONS: division["nominations"],
        S.MEMBERS_ELECTED: division["members_elected"],
        S.CHANGED_HANDS: division["changed_hands"],
        S.DECIDED_ON_FIRST_PREFS: division["decided_on_first_prefs"],
        S.DECIDED_ON_PREFS: division["decided_on_prefs"],
        S.NON_CLASSIC: division["non_classic"],
    }.items():
        land(family, frame, root)
    land(S.FIRST_PREFS_BY_PLACE, first_prefs(cand), root, by_state=True)
