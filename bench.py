"""Time every query end to end, from the given Parquet tables to its last row, and print one JSON line.

``queries`` has those times. Most of each is the derivation of election tables from orders; so ``engine`` has the times
over tables that were derived and stored once, and ``derive_and_store`` what that took.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (cores), BENCH_RUNS (warm runs per query, default 3),
BENCH_QUERIES (comma-separated names or "all", default the headline queries).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tallyframe.catalog import QUERIES, Inputs, StoredInputs
from tallyframe.session import local_session

HEADLINE = [
    "div_votes_by_type", "div_table", "div_table_informal", "div_summary", "div_tcp", "div_tcp_percent", "div_pp_tcp",
    "pp_by_party", "pp_party_groups", "pp_by_party_percent", "div_by_party", "nat_type_by_year",
    "state_primary_by_group", "nat_primary_by_year", "pp_distance", "pp_geocode_changes", "pp_tcp_swing",
    "rollup_geo", "check_division_totals", "build_cand", "scan_state_union", "materialise_tables",
]


def run(query, tables: Inputs) -> float:
    start = time.perf_counter()
    query(tables).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [name for name in chosen.split(",") if name] or HEADLINE

    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    given = Inputs(spark, sf_dir)

    def timed(name: str, tables: Inputs) -> float:
        run(QUERIES[name], tables)
        return round(statistics.median(run(QUERIES[name], tables) for _ in range(runs)), 3)

    StoredInputs.write(given)
    start = time.perf_counter()
    stored = StoredInputs.write(given)
    derive_and_store = round(time.perf_counter() - start, 3)
    seconds, engine = {}, {}
    for name in names:
        seconds[name], engine[name] = timed(name, given), timed(name, stored)
        print(f"{name}: {seconds[name]} {engine[name]}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": f"total seconds over {len(seconds)} queries, median of {runs} warm runs each",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "engine": engine,
                "derive_and_store": derive_and_store,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
