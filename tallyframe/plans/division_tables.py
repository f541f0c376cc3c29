"""Division tables: votes by candidate and vote type, informal votes, two-candidate-preferred, the summary report."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.missing import cell_sum, share, total_sum
from tallyframe.operators.relational import restrict, with_total_row
from tallyframe.operators.vote_types import votes_by_type
from tallyframe.schemas import (
    CANDIDATE_IDENTITY,
    DIVISION_KEY,
    INFORMAL,
    INFORMAL_CANDIDATE,
    ORDINARY,
    TYPE_COLUMNS,
    TYPE_MEASURES,
)

DIVISION = ["election", "division_id"]
TOTAL_LABELS = {"surname": "Total", "given_nm": "", "party_ab": ""}

Elections = Collection[int] | None
Divisions = Collection[str] | None


def _candidates(cand: DataFrame, elections: Elections, divisions: Divisions, measure: str = "votes") -> DataFrame:
    """One row per candidate of a division."""
    rows = restrict(cand, elections, divisions)
    return votes_by_type(rows, [*DIVISION_KEY, "candidate_id"], CANDIDATE_IDENTITY, measure)


def _with_totals(candidates: DataFrame) -> DataFrame:
    table = with_total_row(candidates, DIVISION_KEY, TYPE_MEASURES, TOTAL_LABELS)
    table = table.withColumn("percent", share("total_votes", DIVISION, rows=~F.col("is_total")))
    return table.select(*DIVISION_KEY, "candidate_id", *CANDIDATE_IDENTITY, *TYPE_MEASURES, "percent")


def div_table(cand: DataFrame, elections: Elections = None, divisions: Divisions = None) -> DataFrame:
    """Votes by candidate and vote type with a total per division; ``percent`` counts informal votes in."""
    return _with_totals(_candidates(cand, elections, divisions))


def _tcp_candidates(cand: DataFrame, elections: Elections, divisions: Divisions) -> DataFrame:
    return _candidates(cand.where(F.col("tcp_votes").isNotNull()), elections, divisions, "tcp_votes")


def div_tcp(cand: DataFrame, elections: Elections = None, divisions: Divisions = None) -> DataFrame:
    """``div_table`` of the two-candidate-preferred count."""
    return _with_totals(_tcp_candidates(cand, elections, divisions))


def div_tcp_percent(cand: DataFrame, elections: Elections = None, divisions: Divisions = None) -> DataFrame:
    """Each vote type of the two-candidate-preferred count as a percentage of its own total."""
    shares = [share(c, DIVISION).alias(c) for c in [*TYPE_COLUMNS, "total_votes"]]
    return _tcp_candidates(cand, elections, divisions).select(*DIVISION_KEY, *CANDIDATE_IDENTITY, *shares)


def _summary_rows(candidates: DataFrame) -> DataFrame:
    """Candidate, Formal, Informal and Total rows of each division, told apart by ``row``, in one aggregation.

    Each candidate counts as itself, towards Formal (unless informal) and towards Total.
    """
    row = F.col("row")
    is_informal = F.col("candidate_id") == INFORMAL_CANDIDATE
    own = F.when(is_informal, INFORMAL).otherwise("Candidate")
    keeps_identity = row.isin("Candidate", INFORMAL)
    named = {
        "candidate_id": F.when(keeps_identity, F.col("candidate_id")),
        "surname": F.when(keeps_identity, F.col("surname")).otherwise(row),
        "given_nm": F.when(row == "Candidate", F.col("given_nm")).otherwise(""),
        "party_ab": F.when(keeps_identity, F.col("party_ab")).otherwise(""),
        "elected": F.when(keeps_identity, F.col("elected")),
        "historic_elected": F.when(keeps_identity, F.col("historic_elected")),
    }
    counted = (row != "Formal") | ~is_informal
    rows = (
        candidates.where(F.col("candidate_id").isNotNull())
        .withColumn("row", F.explode(F.array(own, F.lit("Formal"), F.lit("Total"))))
        .groupBy(*DIVISION_KEY, "row", *[value.alias(name) for name, value in named.items()])
        .agg(*[total_sum(c, counted).alias(c) for c in TYPE_MEASURES])
    )
    percent = F.when(row == "Candidate", share("total_votes", DIVISION, rows=row == "Candidate")).otherwise(
        share("total_votes", DIVISION, rows=row.isin("Formal", INFORMAL))
    )
    return rows.withColumn("percent", percent)


def div_table_informal(cand: DataFrame, elections: Elections = None, divisions: Divisions = None) -> DataFrame:
    """Formal, informal and all votes of each division by vote type."""
    rows = _summary_rows(_candidates(cand, elections, divisions)).where(F.col("row") != "Candidate")
    return rows.select(*DIVISION_KEY, "candidate_id", *CANDIDATE_IDENTITY, *TYPE_MEASURES, "percent")


def div_summary(
    cand: DataFrame, elections: Elections = None, divisions: Divisions = None
) -> tuple[DataFrame, DataFrame]:
    """The division report, two tables to two decimals: primary votes (percent of formal), then ``div_tcp_percent``."""
    rows = _summary_rows(_candidates(cand, elections, divisions))
    is_candidate = F.col("row") == "Candidate"
    measures = {
        "absent": "absent", "postal": "postal", "pre_poll_dec": "pre_poll_declaration", "provisional": "provisional",
        "pre_poll_ordinary": "pre_poll_ordinary", "ordinary": "ordinary", "total_votes": "total_votes",
        "percent": "percent",
    }
    primary = rows.select(
        *DIVISION_KEY,
        "surname",
        "given_nm",
        "party_ab",
        F.when(is_candidate, F.col("elected")).otherwise("").alias("elected"),
        F.when(is_candidate, F.col("historic_elected")).otherwise("").alias("historic"),
        *[F.round(source, 2).alias(name) for name, source in measures.items()],
    )
    tcp = div_tcp_percent(cand, elections, divisions)
    tcp = tcp.withColumns({c: F.round(c, 2) for c in [*TYPE_COLUMNS, "total_votes"]})
    return primary, tcp


def ordinary_by_candidate(cand: DataFrame, elections: Elections = None, divisions: Divisions = None) -> DataFrame:
    """Ordinary votes of each candidate, split into pre-poll and polling day in every year."""
    early = F.col("early") == 1
    return (
        restrict(cand, elections, divisions)
        .where(F.col("type") == ORDINARY)
        .groupBy(*DIVISION_KEY, "candidate_id")
        .agg(cell_sum("votes", ~early).alias("ordinary"), cell_sum("votes", early).alias("ppo"))
    )
