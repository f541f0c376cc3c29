"""DuckDB SQL for each query of the catalog, written apart from the Spark plans.

Where the Spark plan makes one pass with conditional sums, the SQL here filters, pivots and joins step by step.
"""

from __future__ import annotations

from tallyframe import schemas as S

CAND = """
base AS (
  SELECT CASE year(o.o_orderdate) % 5 WHEN 0 THEN 2004 WHEN 1 THEN 2007 WHEN 2 THEN 2010 WHEN 3 THEN 2013
              WHEN 4 THEN 2016 END AS election,
    r.r_name AS state_ab, CAST(100 + n.n_nationkey AS VARCHAR) AS division_id, n.n_name AS division_nm,
    n.n_regionkey AS rk, n.n_nationkey AS nk, l.l_linenumber AS slot, c.c_custkey AS ck, c.c_name AS c_name,
    c.c_mktsegment AS seg, o.o_orderpriority AS prio, l.l_quantity AS q
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
mapped AS (
  SELECT election, state_ab, division_id, division_nm, nk, slot, q,
    CASE WHEN slot = 7 THEN '999' ELSE CAST((100 + nk) * 10 + slot AS VARCHAR) END AS candidate_id,
    CASE WHEN slot = 7 THEN 'Informal' ELSE concat('Surname', slot) END AS surname,
    CASE WHEN slot = 7 THEN 'Informal' ELSE concat('Given', slot) END AS given_nm,
    CASE slot WHEN 1 THEN 'ALP' WHEN 3 THEN 'GRN' WHEN 4 THEN CASE WHEN election >= 2010 THEN 'XEN' ELSE 'HAN' END WHEN 5 THEN 'IND'
      WHEN 2 THEN CASE rk WHEN 1 THEN 'NP' WHEN 3 THEN 'CLP'
        WHEN 2 THEN CASE WHEN election > 2010 THEN 'LNP' WHEN election = 2010 THEN 'LNQ' ELSE 'LP' END
        ELSE 'LP' END ELSE '' END AS party_ab,
    CASE WHEN prio = '3-MEDIUM' THEN ck END AS place,
    CASE prio WHEN '1-URGENT' THEN 'Absent' WHEN '2-HIGH' THEN 'Provisional'
      WHEN '4-NOT SPECIFIED' THEN 'PrePollDeclaration' WHEN '5-LOW' THEN 'Postal' ELSE c_name END AS polling_place,
    CASE WHEN prio = '3-MEDIUM' THEN 'Ordinary' ELSE 'Declaration' END AS type,
    CASE WHEN prio = '3-MEDIUM' THEN CASE WHEN seg IN ('FURNITURE', 'HOUSEHOLD') THEN 1 ELSE 0 END
         WHEN prio IN ('4-NOT SPECIFIED', '5-LOW') THEN 1 ELSE 0 END AS early
  FROM base),
cand AS (
  SELECT election, state_ab, division_id, division_nm, CAST(place AS VARCHAR) AS polling_place_id, polling_place,
    candidate_id, surname, given_nm, CAST(CASE WHEN slot = 7 THEN 999 ELSE slot END AS DOUBLE) AS ballot_position,
    CASE WHEN slot = 1 + nk % 2 THEN 'Y' ELSE 'N' END AS elected,
    CASE WHEN slot = 1 THEN 'Y' ELSE 'N' END AS historic_elected, party_ab,
    CASE WHEN party_ab = '' THEN '' ELSE party_ab || ' party' END AS party_nm,
    sum(q) AS votes, (place % 61 - 30) / CAST(10 AS DOUBLE) AS swing,
    CASE WHEN slot <= 2 THEN sum(q) END AS tcp_votes,
    CASE WHEN slot <= 2 THEN (place % 41 - 20) / CAST(10 AS DOUBLE) END AS tcp_swing,
    type, early, CASE WHEN slot = 7 THEN 1 ELSE 0 END AS informal
  FROM mapped
  GROUP BY election, state_ab, division_id, division_nm, nk, slot, candidate_id, surname, given_nm, party_ab, place,
    polling_place, type, early)"""

PP = """
coordinates AS (
  SELECT y.election, c.*, n.n_nationkey AS nk, n.n_name, r.r_name,
    10000 + (c_custkey % 300) * 100
      - CASE WHEN y.election = 2016 AND c_custkey % 7 = 0 THEN 10 WHEN y.election = 2016 AND c_custkey % 7 = 1 THEN 1
             ELSE 0 END AS south,
    1130 + c_custkey % 400 AS east,
    50 + c_custkey % 401 AS coalition, 60 + c_custkey % 307 AS alp,
    NOT (n.n_nationkey % 5 = 3 AND c_custkey % 13 = 0) AS counted
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  CROSS JOIN (SELECT 2013 AS election UNION ALL SELECT 2016) y
  WHERE (y.election = 2013 AND c.c_acctbal >= 0) OR (y.election = 2016 AND c.c_acctbal <= 9000)),
pp AS (
  SELECT election, r_name AS state, CAST(100 + nk AS VARCHAR) AS division_id, n_name AS division_nm,
    CAST(c_custkey AS VARCHAR) AS polling_place_id,
    CASE c_mktsegment WHEN 'FURNITURE' THEN '5' WHEN 'HOUSEHOLD' THEN '5' WHEN 'BUILDING' THEN '2' ELSE '1' END
      AS polling_place_type_id,
    c_name AS polling_place_nm,
    CASE WHEN c_custkey % 11 <> 0 THEN '-' || CAST(south // 1000 AS VARCHAR) || '.' ||
      CASE WHEN election = 2016 AND c_custkey % 7 = 2 THEN CAST(south % 1000 // 100 AS VARCHAR)
           ELSE lpad(CAST(south % 1000 AS VARCHAR), 3, '0') END END AS latitude,
    CASE WHEN c_custkey % 11 <> 0 THEN CAST(east // 10 AS VARCHAR) || '.' || CAST(east % 10 AS VARCHAR) END
      AS longitude,
    CASE WHEN counted THEN CAST(coalition AS DOUBLE) END AS tpp_coalition_votes,
    CASE WHEN counted THEN round(100.0 * coalition / CAST(coalition + alp AS DOUBLE), 2) END AS tpp_coalition_percent,
    CASE WHEN counted THEN CAST(alp AS DOUBLE) END AS tpp_alp_votes,
    CASE WHEN counted THEN round(100.0 * alp / CAST(coalition + alp AS DOUBLE), 2) END AS tpp_alp_percent,
    CASE WHEN counted THEN CAST(coalition + alp AS DOUBLE) END AS tpp_total_votes,
    CASE WHEN counted THEN (c_custkey % 101 - 50) / CAST(10 AS DOUBLE) END AS tpp_swing
  FROM coordinates)"""

DIVISION = ", ".join(S.DIVISION_KEY)
PLACE = ", ".join(S.PLACE_KEY)
IDENTITY = ", ".join(S.CANDIDATE_IDENTITY)
TYPES = S.TYPE_MEASURES
TYPE_LIST = ", ".join(TYPES)


def na(value: str, where: str = "true") -> str:
    only = f"FILTER (WHERE {where})"
    return f"CASE WHEN count(*) {only} = count({value}) {only} THEN sum({value}) {only} END"


def na_list(columns: list[str]) -> str:
    return ", ".join(f"{na(c)} AS {c}" for c in columns)


def zero(value: str, where: str = "true") -> str:
    return f"coalesce(sum({value}) FILTER (WHERE {where}), 0)"


def pct(part: str, whole: str, digits: int = 6) -> str:
    return f"round({part} / nullif({whole}, 0) * 100, {digits})"


def share(value: str, over: str, digits: int = 6) -> str:
    window = f"OVER (PARTITION BY {over})"
    return f"CASE WHEN count(*) {window} = count({value}) {window} THEN {pct(value, f'sum({value}) {window}', digits)} END"


def query(body: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes or (CAND,))}\n{body}"


# --- Vote types: declaration pivot, ordinary pivot, left join -------------------------------------------


def typed(measure: str, source: str = "cand") -> str:
    """CTEs ending in ``detail``: one row per candidate of a division."""
    places = {
        "absent": "Absent", "postal": "Postal", "pre_poll_declaration": "PrePollDeclaration",
        "provisional": "Provisional",
    }
    cells = ", ".join(f"{na(measure, f'''polling_place = '{place}' ''')} AS {name}" for name, place in places.items())
    return f"""
dec AS (
  SELECT {DIVISION}, candidate_id, {IDENTITY}, {cells}
  FROM {source} WHERE type = 'Declaration' GROUP BY {DIVISION}, candidate_id, {IDENTITY}),
ord AS (
  SELECT election, division_id, candidate_id, {na(measure, 'early <> 1')} AS polling_day,
    {na(measure, 'early = 1')} AS pre_poll, {na(measure)} AS both_kinds
  FROM {source} WHERE type = 'Ordinary' GROUP BY election, division_id, candidate_id),
joined AS (
  SELECT dec.*, CASE WHEN dec.election > 2007 THEN polling_day ELSE both_kinds END AS ordinary,
    CASE WHEN dec.election > 2007 THEN pre_poll END AS pre_poll_ordinary,
    CASE WHEN dec.election > 2007 THEN polling_day + pre_poll ELSE both_kinds END AS total_ordinary
  FROM dec LEFT JOIN ord ON dec.election = ord.election AND dec.division_id = ord.division_id
    AND dec.candidate_id IS NOT DISTINCT FROM ord.candidate_id),
detail AS (
  SELECT *, absent + postal + pre_poll_declaration + provisional + total_ordinary AS total_votes FROM joined)"""


TCP = "counted AS (SELECT * FROM cand WHERE tcp_votes IS NOT NULL)"

WITH_TOTAL = f"""
SELECT {DIVISION}, candidate_id, {IDENTITY}, {TYPE_LIST}, {share('total_votes', 'election, division_id')} AS percent
FROM detail
UNION ALL
SELECT {DIVISION}, NULL, 'Total', '', '', NULL, NULL, {na_list(TYPES)}, NULL FROM detail GROUP BY {DIVISION}"""

# A division with informal votes alone has 0 formal ones.
FORMAL_TOTALS = ", ".join(
    f"CASE WHEN count(*) FILTER (WHERE candidate_id <> '999') = count({c}) FILTER (WHERE candidate_id <> '999') "
    f"THEN coalesce(sum({c}) FILTER (WHERE candidate_id <> '999'), 0) END AS {c}"
    for c in TYPES
)

INFORMAL_ROWS = f"""
formal_and_informal AS (
  SELECT {DIVISION}, NULL AS candidate_id, 'Formal' AS surname, '' AS given_nm, '' AS party_ab, NULL AS elected,
    NULL AS historic_elected, {FORMAL_TOTALS} FROM detail GROUP BY {DIVISION}
  UNION ALL
  SELECT {DIVISION}, candidate_id, surname, '', party_ab, elected, historic_elected, {TYPE_LIST}
  FROM detail WHERE candidate_id = '999'),
informal_rows AS (
  SELECT *, {share('total_votes', 'election, division_id', 10)} AS percent FROM formal_and_informal
  UNION ALL
  SELECT {DIVISION}, NULL, 'Total', '', '', NULL, NULL, {na_list(TYPES)}, NULL
  FROM formal_and_informal GROUP BY {DIVISION})"""

SUMMARY_MEASURES = [
    ("pre_poll_dec", "pre_poll_declaration"), *[(c, c) for c in S.TYPE_COLUMNS if c != "pre_poll_declaration"],
    ("total_votes", "total_votes"),
]
TWO_DIGITS = ", ".join(f"round({c}, 2) AS {name}" for name, c in SUMMARY_MEASURES)


def tcp_percent(digits: int) -> str:
    columns = ", ".join(
        f"{share(c, 'election, division_id', digits)} AS {c}" for c in [*S.TYPE_COLUMNS, "total_votes"]
    )
    return query(f"SELECT {DIVISION}, {IDENTITY}, {columns} FROM detail", CAND, TCP, typed("tcp_votes", "counted"))


DIV_TYPES = f"""
by_candidate_type AS (
  SELECT election, state_ab, division_id, division_nm, type, polling_place, early, sum(votes) AS v,
    count(*) - count(votes) AS gaps
  FROM cand GROUP BY ALL),
div_dec AS (
  SELECT election, division_id, state_ab, division_nm,
    sum(v) FILTER (WHERE polling_place = 'Absent') AS absent, sum(v) FILTER (WHERE polling_place = 'Postal') AS postal,
    sum(v) FILTER (WHERE polling_place = 'PrePollDeclaration') AS pre_poll_declaration,
    sum(v) FILTER (WHERE polling_place = 'Provisional') AS provisional
  FROM by_candidate_type WHERE type = 'Declaration' GROUP BY ALL),
div_ord AS (
  SELECT election, division_id, sum(v) FILTER (WHERE early <> 1 OR election <= 2007) AS ordinary,
    sum(v) FILTER (WHERE early = 1 AND election > 2007) AS pre_poll_ordinary
  FROM by_candidate_type WHERE type = 'Ordinary' GROUP BY ALL),
div_joined AS (
  SELECT d.*, o.ordinary, o.pre_poll_ordinary,
    o.ordinary + CASE WHEN d.election > 2007 THEN o.pre_poll_ordinary ELSE 0 END AS total_ordinary
  FROM div_dec d LEFT JOIN div_ord o ON d.election = o.election AND d.division_id = o.division_id),
div_types AS (
  SELECT *, absent + postal + pre_poll_declaration + provisional + total_ordinary AS total_votes FROM div_joined)"""


def national_types(percentage: bool, skip_missing: bool) -> str:
    add = (lambda c: f"sum({c})") if skip_missing else na
    sums = ", ".join(f"{add(c)} AS {c}" for c in [*S.TYPE_COLUMNS, "total_votes"])
    nation = f"nation_types AS (SELECT {sums}, election FROM div_types GROUP BY election)"
    if percentage:
        columns = ", ".join(f"{pct(c, 'total_votes')} AS {c}" for c in S.TYPE_COLUMNS)
        return query(f"SELECT {columns}, election FROM nation_types", CAND, DIV_TYPES, nation)
    return query("SELECT * FROM nation_types", CAND, DIV_TYPES, nation)


# --- Parties: classify through a table of coalition members ---------------------------------------------

LABELLED = f"""
coalition_members(first_election, last_election, party) AS (
  VALUES (2004, 2016, 'LP'), (2004, 2016, 'NP'), (2004, 2016, 'CLP'), (2010, 2010, 'LNQ'), (2013, 2016, 'LNP')),
labelled AS (
  SELECT cand.* REPLACE (CASE WHEN candidate_id = '999' THEN 'Informal' ELSE party_ab END AS party_ab),
    EXISTS (SELECT 1 FROM coalition_members m WHERE m.party = cand.party_ab AND candidate_id <> '999'
            AND cand.election BETWEEN m.first_election AND m.last_election) AS is_coalition
  FROM cand),
place_parties AS (
  SELECT {PLACE}, party_ab, is_coalition, coalesce(sum(votes), 0) AS votes FROM labelled GROUP BY ALL)"""


def groups(by: str, formal: str = "party_ab <> 'Informal'", source: str = "place_parties") -> str:
    return f"""SELECT {by},
    {zero('votes', 'is_coalition')} AS coalition, {zero('votes', "party_ab = 'ALP'")} AS alp,
    {zero('votes', "party_ab = 'GRN'")} AS grn,
    {zero('votes', "party_ab NOT IN ('ALP', 'GRN', 'Informal') AND NOT is_coalition")} AS others,
    {zero('votes', "party_ab = 'Informal'")} AS informal, {zero('votes', formal)} AS total_formal,
    {zero('votes')} AS total_pp
  FROM {source} GROUP BY {by}"""


def primary(by: str, percentage: bool, start: int = 2004) -> str:
    grouped = f"grouped AS ({groups(by)} HAVING election >= {start})"
    if percentage:
        columns = ", ".join(f"{pct(c, 'total_formal')} AS {c}" for c in S.PARTY_GROUPS)
        columns += f", {pct('informal', 'total_pp')} AS informal"
    else:
        columns = "coalition, alp, grn, others, informal, total_pp AS total"
    return query(f"SELECT {by}, {columns} FROM grouped", CAND, LABELLED, grouped)


def party_columns(parties: list[str], measure: str, source_has_labels: bool) -> str:
    aggregate = zero if source_has_labels else na
    return ", ".join(
        f"CASE WHEN count(*) FILTER (WHERE party_ab = '{p}') > 0 THEN {aggregate(measure, f'''party_ab = '{p}' ''')} END"
        f' AS "{p}"'
        for p in parties
    )


# --- Places ------------------------------------------------------------------------------------------------


def km(lat1: str, long1: str, lat2: str, long2: str, legacy: bool = False) -> str:
    cosines = f"cos({lat1}) * cos({lat2})" if legacy else f"cos(radians({lat1})) * cos(radians({lat2}))"
    chord = (
        f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + {cosines} * "
        f"pow(sin((radians({long2}) - radians({long1})) / 2), 2))"
    )
    return f"CASE WHEN {chord} >= 0 THEN 2 * 6371 * asin(CASE WHEN {chord} > 1 THEN 1 ELSE sqrt({chord}) END) END"


def sides(columns: list[str]) -> str:
    return ", ".join(f"x.{c} AS {c}_x, y.{c} AS {c}_y" for c in columns)


MOVE_COLUMNS = ["state", "division_id", "division_nm", "polling_place_type_id", "polling_place_nm"]


def movement(legacy: bool) -> str:
    return f"""
sides AS (
  SELECT coalesce(x.polling_place_id, y.polling_place_id) AS polling_place_id, {sides(MOVE_COLUMNS)},
    TRY_CAST(x.latitude AS DOUBLE) AS latitude_x, TRY_CAST(x.longitude AS DOUBLE) AS longitude_x,
    TRY_CAST(y.latitude AS DOUBLE) AS latitude_y, TRY_CAST(y.longitude AS DOUBLE) AS longitude_y
  FROM (SELECT * FROM pp WHERE election = 2013) x FULL JOIN (SELECT * FROM pp WHERE election = 2016) y
    ON x.polling_place_id = y.polling_place_id),
measured AS (SELECT *, {km('latitude_x', 'longitude_x', 'latitude_y', 'longitude_y', legacy)} AS distance FROM sides),
moves AS (
  SELECT * REPLACE (round(distance, 6) AS distance), CASE WHEN polling_place_nm_y IS NULL THEN 'Abolished'
    WHEN distance IS NULL AND polling_place_type_id_x IS NULL THEN NULL
    WHEN distance IS NULL AND polling_place_type_id_x = '2' THEN 'Mobile'
    WHEN distance IS NULL THEN 'MissingGeo' WHEN distance < 0.2 THEN 'Same' ELSE 'Moved' END AS status
  FROM measured)"""


PP_TCP = """
place_tcp AS (
  SELECT election, state_ab, division_id, division_nm, polling_place, party_ab, sum(tcp_votes) AS votes
  FROM cand WHERE tcp_votes IS NOT NULL GROUP BY ALL),
place_totals AS (
  SELECT election, state_ab, division_id, division_nm, polling_place, sum(votes) AS total
  FROM place_tcp GROUP BY ALL HAVING count(*) = 2),
pp_tcp AS (
  SELECT p.*, t.total, p.votes / nullif(t.total, 0) * 100 AS percent
  FROM place_tcp p LEFT JOIN place_totals t USING (election, state_ab, division_id, division_nm, polling_place))"""


def swing(party: str) -> str:
    return query(
        f"""
SELECT x.division_nm, x.polling_place, round(x.percent - y.percent, 6) AS swing, w.tcp_swing
FROM x LEFT JOIN y ON x.division_nm = y.division_nm AND x.polling_place = y.polling_place
LEFT JOIN (SELECT * FROM cand WHERE election = 2016 AND elected = 'Y') w
  ON x.division_nm = w.division_nm AND x.polling_place = w.polling_place""",
        CAND,
        PP_TCP,
        *[
            f"""{name} AS (SELECT division_nm, polling_place, max(percent) FILTER (WHERE party_ab = '{party}') AS percent
  FROM pp_tcp WHERE election = {election} GROUP BY division_nm, polling_place)"""
            for name, election in (("x", 2013), ("y", 2016))
        ],
    )


# --- Raw files and built tables -----------------------------------------------------------------------------

RAW_CANDIDATE = (
    f"{DIVISION}, candidate_id, surname, given_nm, CAST(CAST(ballot_position AS INTEGER) AS VARCHAR) AS ballot_position,"
    " elected, historic_elected, party_ab, party_nm"
)
FIRST_PREFS = f"""
SELECT {RAW_CANDIDATE}, polling_place_id, polling_place, CAST(votes AS VARCHAR) AS ordinary_votes,
  CAST(swing AS VARCHAR) AS swing
FROM cand WHERE type = 'Ordinary'"""

CANDIDATE_GROUP = ", ".join(S.CANDIDATE_COLUMNS)
DECLARED = f"""
declared_candidates AS (SELECT DISTINCT {CANDIDATE_GROUP} FROM cand WHERE type = 'Declaration'),
vote_types(polling_place, early) AS (
  VALUES ('Absent', 0), ('Provisional', 0), ('PrePollDeclaration', 1), ('Postal', 1)),
declared AS (
  SELECT c.*, t.polling_place, d.votes, d.tcp_votes, t.early
  FROM declared_candidates c CROSS JOIN vote_types t
  LEFT JOIN (SELECT election, division_id, candidate_id, polling_place, votes, tcp_votes FROM cand
             WHERE type = 'Declaration') d USING (election, division_id, candidate_id, polling_place))"""


def built_cand(early: str) -> str:
    return query(
        f"""
SELECT {CANDIDATE_GROUP}, polling_place_id, polling_place, votes, swing, tcp_votes, tcp_swing, type,
  CASE WHEN {early} THEN 1 ELSE 0 END AS early, informal
FROM cand WHERE type = 'Ordinary'
UNION ALL
SELECT {CANDIDATE_GROUP}, NULL, polling_place, votes, NULL, tcp_votes, NULL, 'Declaration', early,
  CASE WHEN ballot_position = 999 THEN 1 ELSE 0 END
FROM declared""",
        CAND,
        PP,
        DECLARED,
    )


BUILT_CAND_2016 = built_cand(
    "polling_place_id IN (SELECT polling_place_id FROM pp WHERE election = 2016 AND polling_place_type_id = '5')"
)

DIV = f"""
nominated AS (
  SELECT {DIVISION}, candidate_id, given_nm, surname, party_ab, elected
  FROM cand WHERE candidate_id <> '999' GROUP BY ALL),
div AS (
  SELECT n.election, n.division_id, n.state_ab, n.division_nm, CAST(count(*) AS VARCHAR) AS nominations,
    max(candidate_id) FILTER (WHERE elected = 'Y') AS elected_candidate_id,
    max(given_nm) FILTER (WHERE elected = 'Y') AS elected_given_nm,
    max(surname) FILTER (WHERE elected = 'Y') AS elected_surname,
    max(party_ab) FILTER (WHERE elected = 'Y') AS elected_party,
    CASE WHEN CAST(division_id AS INTEGER) % 4 = 0 THEN 'XEN' END AS previous_party,
    CASE WHEN CAST(division_id AS INTEGER) % 4 = 0 THEN 1 END AS changed,
    CASE WHEN CAST(division_id AS INTEGER) % 3 = 0 THEN 'First' ELSE 'Preferences' END AS preferences,
    CASE WHEN CAST(division_id AS INTEGER) % 6 = 0 THEN 'GRN' END AS nonclassic_party1,
    CASE WHEN CAST(division_id AS INTEGER) % 6 = 0 THEN 'IND' END AS nonclassic_party2,
    CASE WHEN CAST(division_id AS INTEGER) % 6 = 0 THEN 1 END AS nonclassic
  FROM nominated n GROUP BY n.election, n.division_id, n.state_ab, n.division_nm)"""

# Written out here, apart from the list that the Spark queries pivot on.
PARTY_COLUMNS = ["ALP", "CLP", "GRN", "HAN", "IND", "LNP", "LNQ", "LP", "NP", "XEN"]
WITH_LAST = """with_last AS (SELECT * FROM place_parties JOIN (SELECT election, max(party_ab) AS last_party
  FROM place_parties WHERE party_ab <> 'Informal' GROUP BY election) USING (election))"""
LEGACY = "party_ab <> 'Informal' AND party_ab <> last_party"


def legacy_primary(by: str) -> str:
    columns = ", ".join(f"{pct(c, 'total_formal')} AS {c}" for c in S.PARTY_GROUPS)
    return query(
        f"SELECT {by}, {columns}, {pct('informal', 'total_pp')} AS informal FROM ({groups(by, LEGACY, 'with_last')})",
        CAND,
        LABELLED,
        WITH_LAST,
    )


def other_parties(measure: str, with_informal: bool) -> str:
    """The columns for blank and unlisted parties."""
    listed = ", ".join(f"'{p}'" for p in [*PARTY_COLUMNS, "", *["Informal"] * with_informal])
    blank, rest = "party_ab = ''", f"party_ab NOT IN ({listed})"
    aggregate = zero if with_informal else na
    return ", ".join(
        f"CASE WHEN count(*) FILTER (WHERE {rows}) > 0 THEN {aggregate(measure, rows)} END AS {name}"
        for name, rows in (("blank", blank), ("other", rest))
    )


def table_counts(table: str, measure: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, election, count(*) AS n_rows, "
        f"CAST({zero(measure)} AS DOUBLE) AS measure FROM {table} GROUP BY election"
    )


def rollup_level(level: str, columns: list[str]) -> str:
    every = [*S.DIVISION_KEY, "polling_place_id", "polling_place"]
    keys = ", ".join(c if c in columns else f"CAST(NULL AS VARCHAR) AS {c}" for c in every)
    return (
        f"SELECT {keys}, '{level}' AS level, {zero('votes')} AS votes, {zero('tcp_votes')} AS tcp_votes "
        f"FROM cand GROUP BY {', '.join(columns)}"
    )


ORACLES: dict[str, str] = {
    "scan_results_csv": query(FIRST_PREFS),
    "scan_state_union": query(FIRST_PREFS),
    "election_registry": query(
        """SELECT r.election, r.event_id, v.votes
FROM (VALUES (2016, 20499), (2013, 17496), (2010, 15508), (2007, 13745), (2004, 12246), (2001, 10822))
  AS r(election, event_id) LEFT JOIN (SELECT election, sum(votes) AS votes FROM cand GROUP BY 1) v
  ON r.election = v.election"""
    ),
    "election_slice": query("SELECT * FROM cand WHERE election = 2016"),
    "election_slice_pp": query("SELECT * FROM pp WHERE election = 2013", PP),
    "build_pp": query("SELECT * FROM pp", PP),
    "build_cand_base": query(
        f"""SELECT {RAW_CANDIDATE}, polling_place_id, polling_place, CAST(votes AS VARCHAR) AS votes,
  CAST(swing AS VARCHAR) AS swing, CAST(tcp_votes AS VARCHAR) AS tcp_votes, CAST(tcp_swing AS VARCHAR) AS tcp_swing
FROM cand WHERE type = 'Ordinary'"""
    ),
    "build_cand_declaration": query(
        f"""SELECT {RAW_CANDIDATE}, polling_place, CAST(votes AS VARCHAR) AS votes,
  CAST(tcp_votes AS VARCHAR) AS tcp_votes, early, 'Declaration' AS type FROM declared""",
        CAND,
        DECLARED,
    ),
    "election_slice_div": query("SELECT * FROM div WHERE election = 2013", CAND, DIV),
    "build_from_files": BUILT_CAND_2016,
    "build_cand": BUILT_CAND_2016,
    "build_cand_own_early": built_cand(
        "(election, polling_place_id) IN "
        "(SELECT (election, polling_place_id) FROM pp WHERE polling_place_type_id = '5')"
    ),
    "build_div": query("SELECT * FROM div", CAND, DIV),
    "materialise_tables": query(
        "\nUNION ALL ".join(
            table_counts(*t) for t in (("cand", "votes"), ("pp", "tpp_total_votes"), ("div", "changed"))
        ),
        CAND,
        PP,
        DIV,
    ),
    "agg_na_sum": query(
        f"SELECT election, division_id, {na('tpp_total_votes')} AS total, {na('tpp_alp_votes')} AS alp "
        "FROM pp GROUP BY election, division_id",
        PP,
    ),
    "agg_sum_zero": query(
        f"SELECT election, state_ab, party_ab, {zero('votes')} AS votes, {zero('tcp_votes')} AS tcp_votes "
        "FROM cand GROUP BY election, state_ab, party_ab"
    ),
    "pivot_votes_by_type": query(
        "SELECT {keys}, {cells} FROM cand WHERE type = 'Declaration' GROUP BY {keys}".format(
            keys=f"{DIVISION}, candidate_id",
            cells=", ".join(
                f"sum(votes) FILTER (WHERE polling_place = '{place}') AS \"{place}\"" for place in S.DECLARATION_TYPES
            )
            + ", sum(votes) FILTER (WHERE polling_place NOT IN ('Absent', 'Provisional', 'PrePollDeclaration', 'Postal'))"
            " AS other",
        )
    ),
    "pivot_votes_by_party": query(
        f"SELECT {PLACE}, {party_columns(PARTY_COLUMNS, 'votes', False)}, {other_parties('votes', False)} "
        f"FROM cand GROUP BY {PLACE}"
    ),
    "with_total_row": query(
        f"""SELECT election, state_ab, false AS is_total, {na_list(['votes', 'tcp_votes'])} FROM cand GROUP BY 1, 2
UNION ALL SELECT election, 'Total', true, {na_list(['votes', 'tcp_votes'])} FROM cand GROUP BY 1"""
    ),
    "share_of_total": query(
        f"SELECT *, {share('votes', 'election, division_id')} AS percent FROM "
        "(SELECT election, division_id, candidate_id, sum(votes) AS votes FROM cand GROUP BY 1, 2, 3)"
    ),
    "share_of_nation": query(
        f"SELECT *, {share('votes', 'election')} AS percent FROM "
        "(SELECT election, division_id, candidate_id, coalesce(sum(votes), 0) AS votes FROM cand GROUP BY 1, 2, 3)"
    ),
    "rollup_geo": query(
        "\nUNION ALL ".join(
            rollup_level(level, columns)
            for level, columns in (
                ("place", [*S.DIVISION_KEY, "polling_place_id", "polling_place"]),
                ("division", S.DIVISION_KEY),
                ("state", ["election", "state_ab"]),
                ("nation", ["election"]),
            )
        )
    ),
    "haversine_km": query(
        f"""SELECT election, polling_place_id, round({km('-33.87', '151.2', 'lat', 'long')}, 6) AS km,
  round({km('-33.87', '151.2', 'lat', 'long', legacy=True)}, 6) AS legacy_km
FROM (SELECT *, TRY_CAST(latitude AS DOUBLE) AS lat, TRY_CAST(longitude AS DOUBLE) AS long FROM pp)""",
        PP,
    ),
    "div_table": query(WITH_TOTAL, CAND, typed("votes")),
    "div_table_one": query(
        f"SELECT * FROM ({WITH_TOTAL}) WHERE election = 2016 AND division_nm = 'NATION_1'", CAND, typed("votes")
    ),
    "div_table_informal": query(
        "SELECT * REPLACE (round(percent, 6) AS percent) FROM informal_rows", CAND, typed("votes"), INFORMAL_ROWS
    ),
    "div_tcp": query(WITH_TOTAL, CAND, TCP, typed("tcp_votes", "counted")),
    "div_tcp_percent": tcp_percent(6),
    "div_pp_tcp": query("SELECT * REPLACE (round(percent, 6) AS percent) FROM pp_tcp", CAND, PP_TCP),
    "div_pp_tcp_one": query(
        "SELECT * REPLACE (round(percent, 6) AS percent) FROM pp_tcp WHERE election = 2016 AND division_nm = 'NATION_1'",
        CAND,
        PP_TCP,
    ),
    "div_pp_tcp_pairs": query(
        f"""SELECT * EXCLUDE whole, whole AS total, {pct('first', 'whole')} AS percent_first,
  {pct('second', 'whole')} AS percent_second
FROM (SELECT *, CASE WHEN parties = 2 THEN first + second END AS whole
      FROM (SELECT {DIVISION}, polling_place, d.parties, d.names[1] AS first_party, d.names[2] AS second_party,
              sum(votes) FILTER (WHERE party_ab = d.names[1]) AS first,
              sum(votes) FILTER (WHERE party_ab = d.names[2]) AS second,
              sum(votes) FILTER (WHERE NOT list_contains(d.names[1:2], party_ab)) AS other
            FROM place_tcp JOIN (SELECT {DIVISION}, list_sort(list(DISTINCT party_ab)) AS names,
                                   count(DISTINCT party_ab) AS parties
                                 FROM place_tcp GROUP BY {DIVISION}) d USING ({DIVISION})
            GROUP BY ALL))""",
        CAND,
        PP_TCP,
    ),
    "div_pp_tcp_wide": query(
        f"""SELECT *, "ALP" + "LP" AS total, {pct('"ALP"', '("ALP" + "LP")')} AS "percent_ALP",
  {pct('"LP"', '("ALP" + "LP")')} AS "percent_LP"
FROM (SELECT {DIVISION}, polling_place, sum(tcp_votes) FILTER (WHERE party_ab = 'ALP') AS "ALP",
        sum(tcp_votes) FILTER (WHERE party_ab = 'LP') AS "LP"
      FROM cand WHERE tcp_votes IS NOT NULL AND party_ab IN ('ALP', 'LP') GROUP BY {DIVISION}, polling_place)"""
    ),
    "div_summary": query(
        f"""SELECT {DIVISION}, surname, given_nm, party_ab, elected, historic_elected AS historic, {TWO_DIGITS},
  {share('total_votes', 'election, division_id', 2)} AS percent
FROM detail WHERE candidate_id <> '999'
UNION ALL
SELECT {DIVISION}, surname, given_nm, party_ab, '', '', {TWO_DIGITS}, round(percent, 2) FROM informal_rows""",
        CAND,
        typed("votes"),
        INFORMAL_ROWS,
    ),
    "div_summary_tcp": tcp_percent(2),
    "ordinary_by_candidate": query(
        f"""SELECT {DIVISION}, candidate_id, {na('votes', 'early <> 1')} AS ordinary, {na('votes', 'early = 1')} AS ppo
FROM cand WHERE type = 'Ordinary' GROUP BY {DIVISION}, candidate_id"""
    ),
    "pp_by_party": query(f"SELECT {PLACE}, party_ab, votes FROM place_parties", CAND, LABELLED),
    "pp_by_party_wide": query(
        f"""SELECT {PLACE}, {party_columns([*PARTY_COLUMNS, 'Informal'], 'votes', True)}, {other_parties('votes', True)},
  {zero('votes', 'is_coalition')} AS group_coalition,
  {zero('votes', "party_ab NOT IN ('ALP', 'GRN', 'Informal') AND NOT is_coalition")} AS group_others,
  {zero('votes', "party_ab <> 'Informal'")} AS total_formal, {zero('votes')} AS total_pp
FROM place_parties GROUP BY {PLACE}""",
        CAND,
        LABELLED,
    ),
    "pp_by_party_percent": query(
        f"""SELECT p.{PLACE.replace(', ', ', p.')}, p.party_ab, {pct('p.votes', 'f.formal')} AS percent
FROM place_parties p JOIN (SELECT {PLACE}, sum(votes) AS formal FROM place_parties WHERE party_ab <> 'Informal'
                           GROUP BY {PLACE}) f
  ON p.election = f.election AND p.division_id = f.division_id AND p.polling_place = f.polling_place
  AND p.polling_place_id IS NOT DISTINCT FROM f.polling_place_id
WHERE p.party_ab <> 'Informal'""",
        CAND,
        LABELLED,
    ),
    "pp_party_groups": query(groups(PLACE), CAND, LABELLED),
    "pp_party_groups_legacy": query(
        groups(PLACE, LEGACY, "with_last"), CAND, LABELLED, WITH_LAST,
    ),
    "pp_party_groups_legacy_one": query(
        f"SELECT * FROM ({groups(PLACE, LEGACY, 'with_last')}) WHERE election = 2007 AND division_nm = 'NATION_1'",
        CAND,
        LABELLED,
        WITH_LAST,
    ),
    "pp_by_party_percent_legacy": query(
        f"""SELECT p.{PLACE.replace(', ', ', p.')}, p.party_ab, {pct('p.votes', 'f.formal')} AS percent
FROM place_parties p LEFT JOIN (SELECT {PLACE}, sum(votes) AS formal FROM with_last WHERE {LEGACY} GROUP BY {PLACE}) f
  ON p.election = f.election AND p.division_id = f.division_id AND p.polling_place = f.polling_place
  AND p.polling_place_id IS NOT DISTINCT FROM f.polling_place_id
WHERE p.party_ab <> 'Informal'""",
        CAND,
        LABELLED,
        WITH_LAST,
    ),
    "div_party_groups_legacy": query(groups(DIVISION, LEGACY, "with_last"), CAND, LABELLED, WITH_LAST),
    "state_primary_pct_legacy": legacy_primary("election, state_ab"),
    "nat_primary_pct_legacy": legacy_primary("election"),
    "pp_party_groups_pct": query(
        f"SELECT {PLACE}, {', '.join(f'{pct(c, 'total_formal')} AS {c}' for c in S.PARTY_GROUPS)} FROM g",
        CAND,
        LABELLED,
        f"g AS ({groups(PLACE)})",
    ),
    "div_by_party": query(
        f"SELECT {DIVISION}, party_ab, sum(votes) AS votes FROM place_parties GROUP BY ALL", CAND, LABELLED
    ),
    "div_party_groups": query(groups(DIVISION), CAND, LABELLED),
    "div_votes_by_type": query("SELECT * FROM div_types", CAND, DIV_TYPES),
    "div_votes_by_type_pct": query(
        "SELECT election, division_id, state_ab, division_nm, "
        + ", ".join(f"{pct(c, 'total_votes')} AS {c}" for c in [*S.TYPE_COLUMNS, "total_ordinary"])
        + " FROM div_types",
        CAND,
        DIV_TYPES,
    ),
    "nat_type_by_year": national_types(percentage=False, skip_missing=False),
    "nat_type_by_year_pct": national_types(percentage=True, skip_missing=False),
    "nat_type_by_year_skip_missing": national_types(percentage=False, skip_missing=True),
    "nat_type_by_year_skip_missing_pct": national_types(percentage=True, skip_missing=True),
    "state_primary_by_group": primary("election, state_ab", percentage=False),
    "state_primary_pct": primary("election, state_ab", percentage=True),
    "national_primary_by_group": primary("election", percentage=False),
    "nat_primary_by_year": primary("election", percentage=False, start=2007),
    "nat_primary_by_year_pct": primary("election", percentage=True),
    "pp_distance": query("SELECT * FROM moves", PP, movement(legacy=False)),
    "pp_distance_legacy": query("SELECT * FROM moves", PP, movement(legacy=True)),
    "pp_status_counts": query(
        "SELECT status, count(*) AS places FROM moves GROUP BY status", PP, movement(legacy=False)
    ),
    "pp_geocode_changes": query(
        f"""SELECT polling_place_id, polling_place_nm_x, polling_place_nm_y, lat_x AS latitude_x, lat_y AS latitude_y,
  long_x AS longitude_x, long_y AS longitude_y, round({km('lat_x', 'long_x', 'lat_y', 'long_y')}, 6) AS distance
FROM (SELECT x.polling_place_id, x.polling_place_nm AS polling_place_nm_x, y.polling_place_nm AS polling_place_nm_y,
        TRY_CAST(x.latitude AS DOUBLE) AS lat_x, TRY_CAST(x.longitude AS DOUBLE) AS long_x,
        TRY_CAST(y.latitude AS DOUBLE) AS lat_y, TRY_CAST(y.longitude AS DOUBLE) AS long_y
      FROM pp x JOIN pp y ON x.polling_place_id = y.polling_place_id AND x.election = 2013 AND y.election = 2016
      WHERE x.latitude <> y.latitude OR x.longitude <> y.longitude)
WHERE lat_x IS NOT NULL AND lat_y IS NOT NULL AND long_x IS NOT NULL AND long_y IS NOT NULL""",
        PP,
    ),
    "pp_tcp_swing": swing("LP"),
    "pp_tcp_swing_alp": swing("ALP"),
    "check_division_totals": query(
        f"""SELECT c.election, c.state_ab, c.division_id, c.division_nm, c.total_cand, p.total_pp,
  c.total_cand - p.total_pp AS difference
FROM (SELECT {DIVISION}, {na('votes')} AS total_cand FROM cand GROUP BY {DIVISION}) c
LEFT JOIN (SELECT election, division_id, {na('tpp_total_votes')} AS total_pp FROM pp GROUP BY 1, 2) p
  ON c.election = p.election AND c.division_id = p.division_id""",
        CAND,
        PP,
    ),
    "check_state_informal": query(
        "SELECT election, state_ab, informal, sum(votes) AS votes FROM cand GROUP BY 1, 2, 3"
    ),
    "check_candidate_type": query(
        f"SELECT {DIVISION}, surname, type, sum(votes) AS votes FROM cand GROUP BY ALL"
    ),
    "check_candidate_declaration": query(
        f"SELECT {DIVISION}, surname, polling_place, sum(votes) AS votes FROM cand "
        "WHERE type = 'Declaration' GROUP BY ALL"
    ),
    "check_division_candidate_totals": query(
        f"SELECT {DIVISION}, sum(votes) AS total_cand FROM cand GROUP BY {DIVISION}"
    ),
    "check_tpp_totals": query(
        f"""SELECT *, tpp_coalition_votes + tpp_alp_votes AS total FROM (
  SELECT election, division_nm, {na_list(['tpp_coalition_votes', 'tpp_alp_votes', 'tpp_total_votes'])}
  FROM pp GROUP BY election, division_nm)""",
        PP,
    ),
}

ORACLES["build_cand_base_bucketed"] = ORACLES["build_cand_base"]
