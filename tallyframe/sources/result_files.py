"""Published result files: CSV with a banner line, then a header line; every column is text.

Files are read from a landed directory or object store. A path may be one file or a folder of part files that
share a header.
"""

from __future__ import annotations

import csv
import re
from collections import defaultdict
from collections.abc import Callable, Collection, Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.missing import text_field
from tallyframe.schemas import STATES
from tallyframe.sources.registry import event_id

Layout = Callable[[str, int, str], str]


def landed_path(root: str, event: int, name: str) -> str:
    """Where a file named ``name`` of an event lies under ``root``."""
    return f"{root.rstrip('/')}/{event}/{name}.csv"


def snake_case(header: str) -> str:
    """``DivisionID``, ``DivisionId`` -> division_id; ``Liberal/National Coalition Votes`` -> snake case too."""
    words = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", header.strip())
    return re.sub(r"[^0-9A-Za-z]+", "_", words).strip("_").lower()


#: Longest line that a header may be.
HEADER_BYTES = 1 << 20


def read_header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The second line of a file, split into column names as published. For a folder, that of its first part file. The
    driver reads the two lines through the file system; no job runs."""
    context = spark.sparkContext
    hadoop, conf = context._jvm.org.apache.hadoop, context._jsc.hadoopConfiguration()
    at = hadoop.fs.Path(path)
    files = at.getFileSystem(conf)
    if files.getFileStatus(at).isDirectory():
        parts = [status.getPath() for status in files.listStatus(at)]
        at = min((part for part in parts if part.getName()[0] not in "._"), key=lambda part: part.getName(), default=None)
    lines = []
    if at is not None:
        codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
        stream = files.open(at)
        reader = hadoop.util.LineReader(codec.createInputStream(stream) if codec else stream)
        line = hadoop.io.Text()
        while len(lines) < 2 and reader.readLine(line, HEADER_BYTES) > 0:
            lines.append(line.toString())
        reader.close()
    if len(lines) < 2:
        raise ValueError(f"{path} has no header line below its banner")
    return tuple(next(csv.reader([lines[1]])))


@dataclass(frozen=True)
class FileFacts:
    """What has to be known of a file before it is read: its header, whether quoted fields go over several lines, and in
    how many rows, the header among them, every field is the name of its column."""

    header: tuple[str, ...]
    line_breaks: bool
    header_rows: int


def inspect_files(spark: SparkSession, paths: Iterable[str], line_breaks: bool | None = None) -> dict[str, FileFacts]:
    """The facts of each path. One job looks at all files, and one more at those with line breaks, if there are any;
    ``line_breaks`` says whether there are, None looks. The facts can be kept and given to a scan of the same files.

    The job reads lines as text: a line with an odd number of quotes is a field that goes on, and only lines that are the
    header but for their quotes are split into fields.
    """
    paths = list(paths)
    if not paths:
        return {}
    headers = {path: read_header(spark, path) for path in paths}
    kinds = sorted(set(headers.values()))
    bare = F.replace("value", F.lit('"'), F.lit(""))
    # A condition, since the fields of an "and" are taken out as a common part and so split on every line, for every kind.
    may_be = [F.when(bare == ",".join(kind).replace('"', ""), _is_header(_fields("value", kind), kind)) for kind in kinds]
    odd = (F.length("value") - F.length(bare)) % 2 == 1
    broken, rows = _per_path(spark, spark.read.text(paths), paths, odd, may_be)
    if line_breaks is not None:
        broken = dict.fromkeys(paths, line_breaks)
    several = [path for path in paths if broken[path]]
    for kind in kinds if several else []:  # a line of these may be a part of a field
        own = [path for path in several if headers[path] == kind]
        if own:
            table = _as_text(spark, kind, own, True)
            _, counted = _per_path(spark, table, own, F.lit(False), [_is_header([F.col(c) for c in table.columns], kind)])
            rows.update({path: {kinds.index(kind): counted[path][0]} for path in own})
    return {path: FileFacts(headers[path], broken[path], rows[path][kinds.index(headers[path])]) for path in paths}


def _per_path(spark: SparkSession, table: DataFrame, paths: list[str], flag: Column, counts: list[Column]):
    """Per path, whether the flag holds in any row, and how often each of the conditions holds."""
    sums = [F.count_if(condition).alias(f"n{k}") for k, condition in enumerate(counts)]
    found = table.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.coalesce(F.bool_or(flag), F.lit(False)).alias("flag"), *sums)
    context = spark.sparkContext
    conf, new_path = context._jsc.hadoopConfiguration(), context._jvm.org.apache.hadoop.fs.Path

    def place(at) -> tuple[str, str, str]:
        uri = at.toUri()
        return uri.getScheme(), uri.getAuthority(), uri.getPath()

    given = [new_path(path) for path in paths]
    roots = {place(at.getFileSystem(conf).makeQualified(at)): path for at, path in zip(given, paths)}
    flags = dict.fromkeys(paths, False)
    totals = {path: dict.fromkeys(range(len(counts)), 0) for path in paths}
    for row in found.collect():  # a row for each file
        at = new_path(context._jvm.java.net.URI(row.file))
        while place(at) not in roots:  # a part file lies in the folder that was given
            at = at.getParent()
        path = roots[place(at)]
        flags[path] |= row.flag
        for k in totals[path]:
            totals[path][k] += row[f"n{k}"]
    return flags, totals


def _fields(line: str, header: tuple[str, ...]) -> list[Column]:
    schema = ", ".join(f"c{k} string" for k in range(len(header)))
    split = F.from_csv(F.col(line), schema, {"escape": '"'})
    return [split[f"c{k}"] for k in range(len(header))]


def _is_header(fields: list[Column], header: tuple[str, ...]) -> Column:
    return reduce(and_, (F.coalesce(field, F.lit("")) == name for field, name in zip(fields, header)))


def column_names(header: tuple[str, ...]) -> list[str]:
    """Column names of a header: snake case, unnamed columns ``x``, repeats numbered."""
    names: list[str] = []
    for published in header:
        base = snake_case(published) or "x"
        repeats = sum(name == base or re.fullmatch(rf"{base}_\d+", name) is not None for name in names)
        names.append(f"{base}_{repeats}" if base in names else base)
    return names


def _scan(spark: SparkSession, header: tuple[str, ...], facts: dict[str, FileFacts]) -> DataFrame:
    """Rows of files with one header. Files with quoted line breaks are read whole, one task each; all others are
    split.

    Of each file exactly one row goes that is the header. Such rows are all alike, so it does not matter which: all
    of them are left out, and those there were too many are put back.
    """
    parts = [([path for path, fact in facts.items() if fact.line_breaks is whole], whole) for whole in (True, False)]
    rows = _unite([_read_csv(spark, header, paths, whole) for paths, whole in parts if paths])
    files = sum(max(1, fact.header_rows) for fact in facts.values()) - len(facts)
    if not files:
        return rows
    again = [text_field(F.lit(value)).alias(name) for value, name in zip(header, rows.columns)]
    return rows.unionByName(spark.range(files).select(*again))


def _as_text(spark: SparkSession, header: tuple[str, ...], paths: list[str], whole: bool) -> DataFrame:
    schema = T.StructType([T.StructField(name, T.StringType()) for name in column_names(header)])
    return (
        spark.read.schema(schema)
        .option("header", True)  # takes off the banner of each file
        .option("enforceSchema", True)
        .option("escape", '"')
        .option("multiLine", whole)
        .csv(paths)
    )


def _read_csv(spark: SparkSession, header: tuple[str, ...], paths: list[str], whole: bool) -> DataFrame:
    rows = _as_text(spark, header, paths, whole)
    is_header = _is_header([F.col(name) for name in rows.columns], header)
    return rows.where(~is_header).select(*[text_field(name).alias(name) for name in rows.columns])


def _unite(scans: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def scan_files(
    spark: SparkSession, paths: Iterable[str], line_breaks: bool | None = None, facts: dict[str, FileFacts] | None = None
) -> DataFrame:
    """All rows of the given files as text, columns in snake case, missing columns NULL.

    Files with the same header are one scan; different headers are united by column name. ``line_breaks`` says
    whether quoted fields go over several lines; None looks. ``facts`` of ``inspect_files`` spare looking at all.
    """
    paths = list(paths)
    facts = inspect_files(spark, paths, line_breaks) if facts is None else facts
    by_header: dict[tuple[str, ...], dict[str, FileFacts]] = defaultdict(dict)
    for path in paths:
        by_header[facts[path].header][path] = facts[path]
    return _unite([_scan(spark, header, same) for header, same in by_header.items()])


def family_paths(
    root: str,
    family: str,
    elections: Collection[int],
    by_state: bool = False,
    states: Collection[str] = STATES,
    layout: Layout = landed_path,
) -> dict[str, int]:
    """The election of each path of a file family."""
    suffixes = [f"-{state}" for state in states] if by_state else [""]
    return {
        layout(root, event, f"{family}-{event}{suffix}"): election
        for election in elections
        for event in [event_id(election)]
        for suffix in suffixes
    }


def scan_family(
    spark: SparkSession,
    root: str,
    family: str,
    elections: Collection[int],
    by_state: bool = False,
    states: Collection[str] = STATES,
    layout: Layout = landed_path,
    line_breaks: bool | None = None,
    facts: dict[str, FileFacts] | None = None,
) -> DataFrame:
    """A file family over several elections, tagged with ``election``; ``by_state`` unites the per-state files.

    ``line_breaks`` and ``facts`` as in ``scan_files``.
    """
    paths = family_paths(root, family, elections, by_state, states, layout)
    facts = inspect_files(spark, paths, line_breaks) if facts is None else facts
    scans: dict[tuple[int, tuple[str, ...]], dict[str, FileFacts]] = defaultdict(dict)
    for path, election in paths.items():
        scans[election, facts[path].header][path] = facts[path]
    return _unite(
        [_scan(spark, header, same).withColumn("election", F.lit(election)) for (election, header), same in scans.items()]
    )
