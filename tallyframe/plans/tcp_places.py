"""Two-candidate-preferred results by polling place, and their swing between two elections."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.missing import cell_sum, percent_of
from tallyframe.operators.relational import null_safe_join, restrict
from tallyframe.schemas import DIVISION_KEY

# Places are told apart by name: declaration votes have no id.
NAMED_PLACE = [*DIVISION_KEY, "polling_place"]
COUNTED = "tcp_votes IS NOT NULL"
SIDES = ["first", "second"]


def div_pp_tcp(
    cand: DataFrame, elections: Collection[int] | None = None, divisions: Collection[str] | None = None
) -> DataFrame:
    """Votes by place and party, as rows. ``total`` and ``percent`` need both parties of the count at the place.

    Rows are dealt out by place at once, where both the sums and the totals are made.
    """
    return _by_place(restrict(cand, elections, divisions).where(COUNTED).repartition(*NAMED_PLACE))


def _by_place(rows: DataFrame) -> DataFrame:
    """``div_pp_tcp`` of rows that are dealt out by (a part of) the place."""
    votes = rows.groupBy(*NAMED_PLACE, "party_ab").agg(F.sum("tcp_votes").alias("votes"))
    of_place = Window.partitionBy(*reversed(NAMED_PLACE))  # sorts on the most distinctive column first
    total = F.when(F.count(F.lit(1)).over(of_place) == 2, F.sum("votes").over(of_place))
    return votes.withColumn("total", total).withColumn("percent", percent_of("votes", "total"))


def div_pp_tcp_wide(
    cand: DataFrame,
    parties: tuple[str, str] | None = None,
    elections: Collection[int] | None = None,
    divisions: Collection[str] | None = None,
) -> DataFrame:
    """One row per place, a vote and a percent column for each of two parties.

    Without ``parties`` each division has its own pair, the first two parties of its count by name: then the columns are
    first and second, with the parties next to their votes, and ``other`` for the votes of further parties. A division
    with one party or with more than two has no totals. The side that is joined to has one row per division and party.
    """
    if parties is None:
        return _own_pairs(div_pp_tcp(cand, elections, divisions))
    first, second = parties
    votes = (
        restrict(cand, elections, divisions)
        .where(F.col("tcp_votes").isNotNull() & F.col("party_ab").isin(first, second))
        .groupBy(*NAMED_PLACE)
        .agg(*[cell_sum("tcp_votes", F.col("party_ab") == party).alias(party) for party in parties])
    )
    return votes.withColumn("total", F.col(first) + F.col(second)).withColumns(
        {f"percent_{party}": percent_of(party, "total") for party in parties}
    )


def _own_pairs(votes: DataFrame) -> DataFrame:
    """Parties are numbered by name within each division, one without a name last; the first two have columns, ``other``
    sums the rest, and ``parties`` says how many there are. Totals and percentages need exactly two."""
    party = F.col("party_ab")
    by_name = Window.partitionBy(*DIVISION_KEY)
    parties = votes.select(*DIVISION_KEY, "party_ab").distinct()  # a few of each division
    numbered = parties.withColumns(
        {
            "number": F.row_number().over(by_name.orderBy(party.asc_nulls_last())),
            "parties": F.count(F.lit(1)).over(by_name),
        }
    )
    number = F.col("number")
    for k, side in enumerate(SIDES, 1):
        numbered = numbered.withColumn(f"{side}_party", F.max(F.when(number == k, party)).over(by_name))
    of_division = ["parties", *[f"{side}_party" for side in SIDES]]
    joined = null_safe_join(votes, numbered, [*DIVISION_KEY, "party_ab"], "inner")
    cells = {side: cell_sum("votes", number == k) for k, side in enumerate(SIDES, 1)} | {"other": cell_sum("votes", number > 2)}
    table = joined.groupBy(*NAMED_PLACE, *of_division).agg(*[c.alias(name) for name, c in cells.items()])
    total = F.when(F.col("parties") == 2, F.col("first") + F.col("second"))
    return table.withColumn("total", total).withColumns({f"percent_{side}": percent_of(side, "total") for side in SIDES})


def pp_tcp_swing(
    cand: DataFrame, earlier: int, later: int, party: str = "LP", divisions: Collection[str] | None = None
) -> DataFrame:
    """A party's percentage at the earlier election minus that at the later, for every place of the earlier one.

    Next to it stands the published swing of the later election's winner at the place, once per row that has it.
    Places are matched by division and place name; both elections come out of one pass.
    """
    key = ["division_nm", "polling_place"]
    at_earlier, at_later = F.col("election") == earlier, F.col("election") == later

    def percent(rows: Column) -> Column:
        return F.max(F.when(rows & (F.col("party_ab") == party), F.col("percent")))

    # Both elections of a place meet once, and the winners' rows meet them there.
    both = restrict(cand, [earlier, later], divisions).repartition(*key)
    swing = (
        _by_place(both.where(COUNTED))
        .groupBy(*key)
        .agg((percent(at_earlier) - percent(at_later)).alias("swing"), F.count_if(at_earlier).alias("rows"))
        .where(F.col("rows") > 0)
        .drop("rows")
    )
    winners = restrict(cand, [later], divisions).where(F.col("elected") == "Y").select(*key, "tcp_swing")
    return swing.join(winners, key, "left")
