"""Repeated substrings across a corpus, found over a difference cover of its suffixes.

The sampled suffixes are chosen by content: a position is an anchor if the least hash of the 16-byte strings in the 208
bytes from it on stands first or last among them. Any 400 bytes hold an anchor within the first 193 positions whose 208
bytes lie inside, and equal strings hold their anchors at the same places: so two equal 400-byte strings always have a
sampled suffix at one and the same offset, which is what a difference cover is for.

Suffixes at anchors are named by their first 208 bytes. The remaining suffixes join that of the first anchor after them:
an anchor and the positions before it back to the last anchor form a unit, named by all bytes that their 400-byte
strings span. Units of one name are equal in all their strings. Units of one anchor name but several unit names are
brought together, and their prefixes are compared one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.batches import U64, flat, id_and_text, mix, read_table, runs, span_hashes, window_hashes
from tallyframe.llm.filters import bitmap, may_hold
from tallyframe.session import stored

LENGTH = 400
#: Window of an anchor, and the strings hashed within: 2 * WINDOW - PIECE must not exceed LENGTH.
WINDOW, PIECE = 208, 16
#: Units of one anchor name that one task compares; those of commoner names are compared string by string in a shuffle.
GROUP_UNITS = 1 << 14
#: Units that a task compares in one call, at about; those of one name always lie together.
LOT_UNITS = 1 << 12


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    size = 1
    out = values
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Units:
    """The units of a run of texts: row, anchor, first and last start (in bytes of the whole), and hashes.

    Most of the time goes into hashes: ``keys`` and ``names`` give them of the units that are wanted alone.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        width = WINDOW - PIECE + 1
        if len(data) < LENGTH:
            none = np.zeros(0, dtype=np.int64)
            self.row = self.anchor = self.first = self.last = none
            return
        hashed = window_hashes(data, PIECE)
        least = _least(hashed, width)
        chosen = (hashed[: len(least)] == least) | (hashed[width - 1 :] == least)
        anchor = np.flatnonzero(chosen)
        row = np.searchsorted(offsets, anchor, side="right") - 1
        inside = anchor + WINDOW <= offsets[row + 1]
        anchor, row = anchor[inside], row[inside]
        before = np.append(-1, anchor[:-1])
        first = np.where(np.append(-1, row[:-1]) == row, before + 1, offsets[row])
        last = np.minimum(anchor, offsets[row + 1] - LENGTH)
        # Starts further off than any 400 bytes allow belong to no string of that length.
        first = np.maximum(first, anchor - (LENGTH - WINDOW))
        kept = last >= first
        self.row, self.anchor, self.first, self.last = row[kept], anchor[kept], first[kept], last[kept]

    def keys(self, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Names of the anchors."""
        return span_hashes(self.data, self.anchor[which], self.anchor[which] + WINDOW)

    def names(self, which: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Names of the units with these anchor names."""
        first, lead = self.first[which], self.anchor[which] - self.first[which]
        spanned = span_hashes(self.data, first, self.last[which] + LENGTH)
        return mix(spanned + lead.astype(np.uint64) * U64(0x9E3779B97F4A7C15) + keys)


def _ids(tids: pa.Array) -> np.ndarray:
    """A number for each text's digest."""
    return np.frombuffer(b"".join(tids.to_pylist()), dtype="<u8").reshape(-1, 2)[:, 0] if len(tids) else np.zeros(0, np.uint64)


def _unit_ids(tids: np.ndarray, row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return mix(tids[row] + anchor.astype(np.uint64) * U64(0xD1342543DE82EF95))


def _count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in runs(batch):
            keys, counts = np.unique(Units(*flat(part.column("text"))).keys(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])


def _emit_units(alive):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch):
                units = Units(*flat(part.column("text")))
                keys = units.keys()
                kept = np.flatnonzero(may_hold(alive.value, keys))
                keys = keys[kept]
                row, base = units.row[kept], units.offsets[units.row[kept]]
                own = _unit_ids(_ids(part.column("tid")), row, units.anchor[kept] - base)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("tid").take(pa.array(row)),
                        pa.array((units.first[kept] - base).astype(np.int32)),
                        pa.array((units.last[kept] - base).astype(np.int32)),
                        pa.array(keys.view(np.int64)),
                        pa.array(units.names(kept, keys).view(np.int64)),
                        pa.array(own.view(np.int64)),
                    ],
                    names=["tid", "first", "last", "key", "name", "unit"],
                )

    return run


def _emit_contexts(wanted, common, hot: bool):
    """For one unit of each name that is wanted: its bytes, or for commoner keys the hashes of all its strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch):
                units = Units(*flat(part.column("text")))
                base = units.offsets[units.row]
                own = _unit_ids(_ids(part.column("tid")), units.row, units.anchor - base)
                kept = np.flatnonzero(may_hold(wanted.value, own))
                key = units.keys(kept)
                of_kind = may_hold(common.value, key) == hot
                kept, key = kept[of_kind], key[of_kind]
                first, last = units.first[kept], units.last[kept]
                name, once = np.unique(units.names(kept, key), return_index=True)
                first, last, key = first[once], last[once], key[once]
                if hot:
                    lengths = last - first + 1
                    starts = np.repeat(first - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
                    values = pa.ListArray.from_arrays(
                        pa.array(np.append(0, np.cumsum(lengths)), pa.int32()),
                        pa.array(window_hashes(units.data, LENGTH)[starts].view(np.int64)),
                    )
                else:
                    values = pa.array([units.data[a : b + LENGTH].tobytes() for a, b in zip(first, last)], pa.binary())
                lead = (units.anchor[kept][once] - first).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(name.view(np.int64)), pa.array(lead), values],
                    names=["key", "name", "lead", "strings" if hot else "context"],
                )

    return run


def _compared(group: pd.DataFrame) -> pd.DataFrame:
    """Among units of each anchor name: of each, the starts (counted from its first) whose string another one has."""
    group = group.drop_duplicates("name")
    names, leads, keys = group["name"].to_numpy(), group["lead"].to_numpy(), group["key"].to_numpy().view(np.uint64)
    lengths = np.array([len(c) for c in group["context"]], dtype=np.int64)
    data = np.frombuffer(b"".join(group["context"]), dtype=np.uint8)
    base = np.concatenate([[0], np.cumsum(lengths)])
    counts = lengths - LENGTH + 1
    unit = np.repeat(np.arange(len(names)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = base[unit] + start
    hashes = window_hashes(data, LENGTH)[at]
    hashes = mix(hashes + (leads[unit] - start).astype(np.uint64) * U64(0x9E3779B97F4A7C15) + keys[unit])
    _, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(times[which] > 1)
    # neighbouring starts of one unit make a run
    fresh = np.ones(len(hit), dtype=bool)
    fresh[1:] = (unit[hit][1:] != unit[hit][:-1]) | (start[hit][1:] != start[hit][:-1] + 1)
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(hit)) - 1 if len(hit) else begin
    return pd.DataFrame({"name": names[unit[hit[begin]]], "low": start[hit[begin]], "high": start[hit[end]]})


def _split(held, with_spans: bool):
    """Texts that may have spans, or the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(held.value, _ids(batch.column("tid"))) == with_spans))

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of texts with their removed spans (start, end in bytes)."""
    for batch in batches:
        for part in runs(batch):
            data, offsets = flat(part.column("text"))
            covered = np.zeros(len(data) + 1, dtype=np.int32)
            spans = part.column("spans")
            counts = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            each = spans.flatten()
            base = np.repeat(offsets[:-1], counts)
            np.add.at(covered, base + each.field("low").to_numpy(), 1)
            np.add.at(covered, base + each.field("high").to_numpy() + LENGTH, -1)
            gone = np.cumsum(covered)[:-1] > 0
            rows = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                out = gone[a:b]
                begins = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum())
                rows.append((b - a, int(out.sum()), begins, hashlib.sha256(data[a:b][~out].tobytes()).hexdigest()))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )


def _untouched(held):
    """Results of texts that have no spans for sure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _split(held, False)(batches):
            none = pa.nulls(batch.num_rows, SPANS)
            yield from _cut(iter([pa.RecordBatch.from_arrays([*batch.columns, none], names=[*batch.schema.names, "spans"])]))

    return run


SPANS = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(tid, spans) for every distinct text with a 400-byte string that also starts elsewhere in ``docs`` (tid, text);
    spans are runs (low, high) of the starts of such strings, in bytes."""
    sc = docs.sparkSession.sparkContext
    counted = docs.select("text").mapInArrow(_count_keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    alive = sc.broadcast(bitmap(counted.where("n > 1"), "key"))
    schema = "tid binary, first int, last int, key long, name long, unit long"
    units = stored(docs.mapInArrow(_emit_units(alive), schema), "units")
    names = units.groupBy("key", "name").agg(F.count("*").alias("n"), F.min("unit").alias("unit"))
    names = stored(names, "names")
    keys = names.groupBy("key").agg(F.count("*").alias("names")).where("names > 1")
    mixed = names.join(keys, "key")
    wanted = sc.broadcast(bitmap(mixed, "unit"))
    lots = max(1, -(-mixed.count() // LOT_UNITS))
    common = sc.broadcast(bitmap(keys.where(F.col("names") > GROUP_UNITS), "key"))

    contexts = docs.mapInArrow(_emit_contexts(wanted, common, False), "key long, name long, lead int, context binary")
    lot = F.pmod(F.col("key"), F.lit(lots)).alias("lot")  # many anchor names in one call
    few = contexts.groupBy(lot).applyInPandas(_compared, "name long, low int, high int")
    listed = docs.mapInArrow(_emit_contexts(wanted, common, True), "key long, name long, lead int, strings array<long>")
    strings = stored(listed.select("name", F.posexplode("strings").alias("low", "string")), "strings")
    several = strings.groupBy("string").agg(F.min("name").alias("a"), F.max("name").alias("b")).where("a < b")
    many = strings.join(several.select("string"), "string").select("name", "low", F.col("low").alias("high"))
    whole = names.where("n > 1").select("name", F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"))
    found = whole.unionByName(few).unionByName(many.distinct())

    placed = units.select("tid", "first", "last", "name").distinct().join(found, "name").select(
        "tid",
        F.when(F.col("low").isNull(), F.col("first")).otherwise(F.col("first") + F.col("low")).alias("low"),
        F.when(F.col("low").isNull(), F.col("last")).otherwise(F.col("first") + F.col("high")).alias("high"),
    )
    return placed.groupBy("tid").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans and kept_sha256, after removal of every
    byte covered by a 400-byte string that also starts anywhere else in the corpus.

    Texts are UTF-8 bytes; matches do not cross rows. A null text counts as an empty one, from which nothing goes.
    Rows are kept one for one: two equal rows repeat each other, whatever their doc_id. Other columns are not read.
    """
    sc = docs.sparkSession.sparkContext
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = id_and_text(docs).select("doc_id", text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("tid"))
    spans = stored(repeated_spans(keyed.select("tid", "text")), "spans")
    numbered = spans.select(  # the first eight bytes of the digest, as a little-endian number
        F.conv(F.reverse(F.regexp_replace(F.hex(F.substring("tid", 1, 8)), "(.)(.)", "$2$1")), 16, -10).cast("long").alias("number")
    )
    held = sc.broadcast(bitmap(numbered, "number"))
    same = "doc_id long, text string, tid binary"
    touched = keyed.mapInArrow(_split(held, True), same).join(spans, "tid", "left").select("doc_id", "text", "spans")
    # One Python worker to a task: texts without spans are told apart and cut in one function.
    return touched.mapInArrow(_cut, RESULT).unionByName(keyed.mapInArrow(_untouched(held), RESULT))


def op10_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of repeats from all documents; nulls, empties and repeats are as for ``remove_repeats``."""
    return remove_repeats(read_table(spark, sf_dir, "documents"))
