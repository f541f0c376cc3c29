import gzip

import pytest

from frames import cand_table, pp_table, records
from tallyframe.functions.missing import number
from tallyframe.sources import registry, store
from tallyframe.sources.result_files import (
    FileFacts, inspect_files, landed_path, read_header, scan_family, scan_files, snake_case,
)

BANNERED = """2016 election banner, with a comma
StateAb,DivisionID,PartyAb,Votes
NSW,101,,5
NSW,101,"",7
NSW,102,NA,x
NSW
"""


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_scan_drops_banner_and_header_and_keeps_blank_text(spark, tmp_path):
    rows = scan_files(spark, [write(tmp_path / "a.csv", BANNERED)])
    assert rows.columns == ["state_ab", "division_id", "party_ab", "votes"]
    assert {dtype for _, dtype in rows.dtypes} == {"string"}
    found = sorted((r["division_id"], r["party_ab"] or repr(r["party_ab"]), r["votes"]) for r in rows.collect())
    assert found == [("", "''", ""), ("101", "''", "5"), ("101", "''", "7"), ("102", "None", "x")]
    numbers = sorted(r["n"] or 0 for r in rows.select(number("votes").alias("n")).collect())
    assert numbers == [0, 0, 5.0, 7.0]


def test_a_row_that_names_a_column_is_no_header(spark, tmp_path):
    path = write(tmp_path / "n.csv", "b\nSurname,Votes\nSurname,5\nOther,6\n")
    assert sorted(r["surname"] for r in scan_files(spark, [path]).collect()) == ["Other", "Surname"]


def test_blanks_around_header_names(spark, tmp_path):
    path = write(tmp_path / "t.csv", "b\nStateAb ,Votes\nNSW,5\n")
    assert records(scan_files(spark, [path])) == [{"state_ab": "NSW", "votes": "5"}]


def test_quoted_line_breaks(spark, tmp_path):
    broken = write(tmp_path / "l.csv", 'b\nPlace,Votes\n"Town\nHall",1\nEast,2\n')
    whole = write(tmp_path / "w.csv", "b\nPlace,Votes\nWest,3\n")
    rows = sorted(records(scan_files(spark, [broken, whole])), key=lambda r: r["votes"])
    assert [(r["place"], r["votes"]) for r in rows] == [("Town\nHall", "1"), ("East", "2"), ("West", "3")]


def test_every_file_of_a_scan_loses_its_own_banner_and_header(spark, tmp_path):
    paths = [write(tmp_path / f"{i}.csv", f"banner {i}\nA,B\n{i},x\n") for i in range(3)]
    assert sorted(r["a"] for r in scan_files(spark, paths).collect()) == ["0", "1", "2"]


def test_files_with_other_headers_are_united_by_name(spark, tmp_path):
    one = write(tmp_path / "1.csv", "b\nA,B\n1,2\n")
    two = write(tmp_path / "2.csv", "b\nB,A,C\n3,4,5\n")
    rows = sorted(records(scan_files(spark, [one, two])), key=lambda r: r["a"])
    assert rows == [{"a": "1", "b": "2", "c": None}, {"a": "4", "b": "3", "c": "5"}]


def test_quotes_and_commas_inside_fields(spark, tmp_path):
    path = write(tmp_path / "q.csv", 'b\nSurname,PartyNm\n"O""Hara","Greens, The"\n')
    assert records(scan_files(spark, [path])) == [{"surname": 'O"Hara', "party_nm": "Greens, The"}]


def test_unnamed_and_repeated_columns(spark, tmp_path):
    path = write(tmp_path / "u.csv", "b\n,Swing,Swing,Votes,Swing\n,1,2,3,4\nz,5,6,7,8\n")
    rows = sorted(records(scan_files(spark, [path])), key=lambda r: r["x"])
    assert rows == [
        {"x": "", "swing": "1", "swing_1": "2", "votes": "3", "swing_2": "4"},
        {"x": "z", "swing": "5", "swing_1": "6", "votes": "7", "swing_2": "8"},
    ]


def test_file_without_header_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="no header"):
        read_header(spark, write(tmp_path / "short.csv", "only a banner\n"))


@pytest.mark.parametrize(
    ("published", "name"),
    [
        ("DivisionID", "division_id"), ("DivisionId", "division_id"), ("PartyAb1", "party_ab1"),
        ("Liberal/National Coalition Votes", "liberal_national_coalition_votes"), ("StateAb", "state_ab"),
        ("Liberal.National.Coalition.Votes", "liberal_national_coalition_votes"),
    ],
)
def test_snake_case(published, name):
    assert snake_case(published) == name


def test_family_by_state_and_election(spark, tmp_path):
    for election in (2013, 2016):
        event = registry.event_id(election)
        for state in ("NSW", "VIC"):
            path = tmp_path / str(event) / f"Votes-{event}-{state}.csv"
            write(path, f"banner\nStateAb,Votes\n{state},{election}\n")
    rows = scan_family(spark, str(tmp_path), "Votes", (2013, 2016), by_state=True, states=("NSW", "VIC"))
    found = sorted((r["election"], r["state_ab"], r["votes"]) for r in rows.collect())
    assert found == [(2013, "NSW", "2013"), (2013, "VIC", "2013"), (2016, "NSW", "2016"), (2016, "VIC", "2016")]


def test_landed_path():
    assert landed_path("s3://bucket/results/", 20499, "Votes-20499") == "s3://bucket/results/20499/Votes-20499.csv"


def test_unknown_election_is_refused():
    with pytest.raises(ValueError, match="unknown election 1999"):
        registry.event_id(1999)


def test_elections_from():
    assert registry.elections_from(2010) == [2010, 2013, 2016]
    with pytest.raises(ValueError, match="no cand table"):
        registry.elections_from(2001)
    with pytest.raises(ValueError, match="unknown election"):
        registry.elections_from(2005)


def test_registry_table(spark):
    rows = {r["election"]: r["event_id"] for r in registry.elections_table(spark).collect()}
    assert rows == {2016: 20499, 2013: 17496, 2010: 15508, 2007: 13745, 2004: 12246, 2001: 10822}


def test_election_slice_checks_its_arguments(spark):
    tables = {"cand": cand_table(spark, [{"election": 2013}, {"election": 2016}])}
    assert registry.election_slice(tables, "cand", 2013).count() == 1
    with pytest.raises(ValueError, match="unknown table"):
        registry.election_slice(tables, "seats", 2013)
    with pytest.raises(ValueError, match="no pp table for 2010"):
        registry.election_slice(tables, "pp", 2010)


def test_store_round_trip_replaces_only_written_elections(spark, tmp_path):
    root = str(tmp_path / "tables")
    first = pp_table(spark, [{"election": 2013, "polling_place_id": "1"}, {"election": 2016, "polling_place_id": "2"}])
    store.write_tables({"pp": first}, root)
    store.write_tables({"pp": pp_table(spark, [{"election": 2016, "polling_place_id": "3"}])}, root)
    stored = store.read_tables(spark, root, ("pp",))["pp"]
    assert sorted((r["election"], r["polling_place_id"]) for r in stored.collect()) == [(2013, "1"), (2016, "3")]


def test_slice_of_a_stored_table_reads_one_partition(spark, tmp_path):
    root = str(tmp_path / "tables")
    store.write_tables({"pp": pp_table(spark, [{"election": 2013}, {"election": 2016}])}, root)
    part = registry.election_slice(store.read_tables(spark, root, ("pp",)), "pp", 2016)
    assert len(part.inputFiles()) == 2  # before pruning
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(election" in plan


def test_exactly_the_second_record_is_the_header(spark, tmp_path):
    one = write(tmp_path / "1.csv", "b\nSurname\nSmith\nSurname\nJones\n\"Surname\"\nSurname \n")
    two = write(tmp_path / "2.csv", 'b\nA,B\n"A",B\nA,B\nx,A\n')
    assert sorted(r["surname"] for r in records(scan_files(spark, [one]))) == ["Jones", "Smith", "Surname", "Surname", "Surname "]
    assert sorted((r["a"], r["b"]) for r in records(scan_files(spark, [two]))) == [("A", "B"), ("A", "B"), ("x", "A")]


def test_header_rows_of_files_with_line_breaks(spark, tmp_path):
    path = write(tmp_path / "l.csv", 'b\nPlace,Votes\n"Town\nPlace,Votes\nHall",1\nPlace,Votes\nEast,2\n')
    found = sorted((r["place"], r["votes"]) for r in records(scan_files(spark, [path])))
    assert found == [("East", "2"), ("Place", "Votes"), ("Town\nPlace,Votes\nHall", "1")]


def test_folders_of_part_files_and_awkward_names(spark, tmp_path):
    for k in range(3):
        write(tmp_path / "a folder%20é" / f"part-{k}.csv", f"banner\nA,B\n{k},x\nA,B\n")
    write(tmp_path / "a folder%20é" / "_SUCCESS", "")
    facts = inspect_files(spark, [str(tmp_path / "a folder%20é")])
    assert list(facts.values()) == [FileFacts(("A", "B"), False, 6)]


def test_compressed_files(spark, tmp_path):
    path = tmp_path / "z.csv.gz"
    path.write_bytes(gzip.compress(b"b\nA,B\n1,2\n"))
    assert records(scan_files(spark, [str(path)])) == [{"a": "1", "b": "2"}]


def test_one_job_looks_at_any_number_of_files(spark, tmp_path):
    paths = [write(tmp_path / f"{i}.csv", f"b\nA,B{i % 3}\n{i},x\n") for i in range(12)]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("looking", "")
    try:
        scanned = scan_files(spark, paths)
        jobs = len(tracker.getJobIdsForGroup("looking"))
        facts = inspect_files(spark, paths)
        before = len(tracker.getJobIdsForGroup("looking"))
        scan_files(spark, paths, facts=facts)
        assert len(tracker.getJobIdsForGroup("looking")) == before
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 2  # adaptive execution runs the two stages of a grouping as a job each
    assert scanned.count() == 12


def test_only_lines_that_may_be_headers_are_split_into_fields(spark, tmp_path):
    """Splitting is the dear part; a line of more fields than the splitter takes shows whether it was tried."""
    path = write(tmp_path / "wide.csv", "b\nA,B\n1,2\n" + "," * 30_000 + '\n"A",B\n')
    other = write(tmp_path / "other.csv", "b\nC,D,E\n1,2,3\n")
    facts = inspect_files(spark, [path, other])
    assert facts == {path: FileFacts(("A", "B"), False, 2), other: FileFacts(("C", "D", "E"), False, 1)}
