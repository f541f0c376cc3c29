"""The whole build: landed result files to the three tables."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession

from tallyframe import schemas as S
from tallyframe.operators.relational import null_safe_join
from tallyframe.plans.candidates_build import build_cand
from tallyframe.plans.divisions_build import build_div
from tallyframe.plans.places_build import build_pp
from tallyframe.sources.result_files import Layout, family_paths, inspect_files, landed_path, scan_family
from tallyframe.sources.staging import staged, staged_join


def build_tables(
    spark: SparkSession,
    root: str,
    states: Collection[str] = S.STATES,
    layout: Layout = landed_path,
    elections: Collection[int] | None = None,
    early_source_election: int | None = 2016,
    line_breaks: bool | None = None,
    mark_losses: bool = False,
    buckets: int | None = None,
) -> dict[str, DataFrame]:
    """``pp``, ``cand`` and ``div`` from the files under ``root``.

    Covers every election that has the table, or those of them in ``elections``. Pre-poll centres come from the
    polling places of ``early_source_election``, which must then be among them; see ``mark_early``. One job looks at all
    files beforehand; ``line_breaks`` as in ``scan_files``.

    ``mark_losses`` marks texts that are no numbers, for ``write_tables`` to count. With ``buckets``, the files that are joined
    with each other are staged first, in so many buckets of their key: each is shuffled once when it is staged, and
    reading the tables, however often, shuffles no file.
    """
    covered = {
        table: [year for year in years if elections is None or year in set(elections)]
        for table, years in S.TABLE_ELECTIONS.items()
    }
    if early_source_election is not None and early_source_election not in covered["pp"]:
        raise ValueError(f"no polling places of {early_source_election} to tell pre-poll centres by")

    families = [
        ("pp", S.POLLING_PLACES, False), ("pp", S.TPP_BY_PLACE, False), ("cand", S.FIRST_PREFS_BY_PLACE, True),
        *[("cand", family, False) for family in (S.TCP_BY_PLACE, S.FIRST_PREFS_BY_TYPE, S.TCP_BY_TYPE)],
        *[("div", family, False) for family in S.DIVISION_FAMILIES],
    ]
    paths = [
        path for table, family, by_state in families
        for path in family_paths(root, family, covered[table], by_state, states, layout)
    ]
    facts = inspect_files(spark, paths, line_breaks)

    def scan(table: str, family: str, by_state: bool = False) -> DataFrame:
        return scan_family(spark, root, family, covered[table], by_state, states, layout, facts=facts)

    def joined(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
        if buckets is None:
            return null_safe_join(left, right, key)
        return staged_join(staged(left, key, buckets), staged(right, key, buckets), key)

    places, tpp = scan("pp", S.POLLING_PLACES), scan("pp", S.TPP_BY_PLACE)
    pp = build_pp(places, tpp, mark_losses, joined)
    cand = build_cand(
        scan("cand", S.FIRST_PREFS_BY_PLACE, by_state=True),
        scan("cand", S.TCP_BY_PLACE),
        scan("cand", S.FIRST_PREFS_BY_TYPE),
        scan("cand", S.TCP_BY_TYPE),
        places,
        early_source_election,
        mark_losses,
        joined,
    )
    div = build_div(
        nominations=scan("div", S.NOMINATIONS),
        members_elected=scan("div", S.MEMBERS_ELECTED),
        changed_hands=scan("div", S.CHANGED_HANDS),
        decided_on_first_prefs=scan("div", S.DECIDED_ON_FIRST_PREFS),
        decided_on_prefs=scan("div", S.DECIDED_ON_PREFS),
        non_classic=scan("div", S.NON_CLASSIC),
    )
    return {"pp": pp, "cand": cand, "div": div}
