"""Near-duplicate documents: fast similarity sketches, banding, and exact verification on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.batches import flat, id_and_text, read_table, runs, shingles
from tallyframe.llm.components import components
from tallyframe.llm.fast_sketch import band_keys, sketches
from tallyframe.llm.filters import MAX_BITS, asking, bitmap, may_hold, sent_round
from tallyframe.session import release, stored

SKETCH_SIZE = 256
ROWS_PER_BAND = 6
#: Members of a bucket that one task compares with each other at a time.
CHUNK = 1024
BANDS = SKETCH_SIZE // ROWS_PER_BAND
#: Buckets of so many members are compared together with the others of their hub, BANDS of them at most.
SMALL_BUCKET = CHUNK // BANDS


def _sketched(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for part in runs(batch):
                sets = shingles(*flat(part.column("text")), words)
                keys = band_keys(sketches(sets, SKETCH_SIZE), ROWS_PER_BAND).view(np.int64)
                filled = np.array([len(s) > 0 for s in sets], dtype=bool)
                bands = keys.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(
                            pa.array(np.concatenate([[0], np.cumsum(filled * bands)]), pa.int32()),
                            pa.array(keys[filled].reshape(-1), pa.int64()),
                        ),
                    ],
                    names=["doc_id", "n_shingles", "set_id", "bands"],
                )

    return run


def _shingled(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch):
                sets = shingles(*flat(part.column("text")), words)
                at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                arrays = [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))]
                yield pa.RecordBatch.from_arrays(arrays, names=["node", "shingles"])

    return run


def _linked(percent: int):
    """Compares the members of one block of a bucket and returns links that hold its similar members together."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        nodes, side = block["node"].to_numpy(), block["side"].to_numpy()
        sets = [np.asarray(s, dtype=np.int64) for s in block["shingles"]]
        sizes = np.array([len(s) for s in sets])
        _, group = np.unique(block["component"].to_numpy(), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[column]
        common = np.zeros((len(sets), len(sets)), dtype=np.float64)
        width = max(1, int((counts > 1).sum()))
        step = 4096
        for low in range(0, width, step):  # only shingles that two members have can count
            inside = (shared >= low) & (shared < low + step)
            dense = np.zeros((len(sets), step), dtype=np.float32)
            dense[owner[inside], shared[inside] - low] = 1
            common += dense @ dense.T
        union = sizes[:, None] + sizes[None, :] - common
        similar = 100 * common >= percent * union
        similar &= (side[:, None] != side[None, :]) if (side > 0).any() else True
        similar &= group[:, None] != group[None, :]  # the rest is linked already
        links = []
        for i, j in zip(*np.nonzero(np.triu(similar, 1))):
            if group[i] != group[j]:
                group[group == group[j]] = group[i]
                links.append((nodes[i], nodes[j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of at least the wanted documents.

    Up to MAX_BITS / 16 of them are picked out by a bitmap of hashed ids, so that texts are not shuffled; a
    document let through by chance does no harm. More are picked out by a join.
    """
    schema = "node long, shingles array<long>"
    if 16 * wanted.count() > MAX_BITS:
        return docs.join(wanted, "doc_id", "left_semi").mapInArrow(_shingled(words), schema)
    mark = F.xxhash64("doc_id").alias("mark")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(mark), "mark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def picked():
            for batch in batches:
                yield batch.filter(pa.array(may_hold(shared.value, batch.column("mark").to_numpy())))

        return _shingled(words)(picked())

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text", mark).mapInArrow(run, schema)


def _still_apart(shared: DataFrame, found: DataFrame) -> DataFrame:
    """The blocks (merged, group, low, high) in which members of buckets (bucket, node, hub, size) have yet to be compared,
    with the component that each was found in; ``found`` leaves out nodes without a link.

    Similar documents meet in many buckets, mostly with the same hub. The small buckets of a hub are therefore one group and
    one block, in which each member stands once. A larger bucket is a group of its own, cut into blocks of two chunks of
    members; so is each bucket of a hub that has more than BANDS, being an id with several texts. Of buckets with the same
    members, one is compared.
    """
    placed = shared.where("size > 2").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = (
        placed.groupBy("bucket", "hub", "size")
        .agg(
            F.min("component").alias("low"), F.max("component").alias("high"),
            F.bit_xor(F.xxhash64("node")).alias("mark"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("mark2"),
        )
        .where("low < high")
        .groupBy("hub", "size", "mark", "mark2")  # the hub is the least member
        .agg(F.min("bucket").alias("bucket"))
    )
    small = F.col("size") <= SMALL_BUCKET
    merging = apart.where(small).groupBy("hub").agg(F.count("*").alias("buckets")).where(F.col("buckets") <= BANDS)
    apart = apart.join(merging, "hub", "left").select("bucket", (small & F.col("buckets").isNotNull()).alias("merged"))
    group, chunks = F.when(F.col("merged"), F.col("hub")).otherwise(F.col("bucket")), F.ceil(F.col("size") / CHUNK)
    split = (
        placed.join(apart, "bucket")
        .select(
            "merged", group.alias("group"), "node", "component",
            F.when(F.col("merged"), 1).otherwise(chunks).cast("int").alias("chunks"),
        )
        .distinct()
        .withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    )
    return split.select(
        "merged", "group", "node", "component", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    ).select(
        "merged", "group", "node", "component",
        F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"),
        F.when(F.col("chunk") > F.col("other"), 1).when(F.col("chunk") < F.col("other"), 0).otherwise(-1).alias("side"),
    )


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| over their sets of distinct runs of ``words``
    words (lower case, split at blanks; a shorter text has its whole word sequence as its only shingle).
    component_id is the smallest doc_id that links reach, kept says that it is the document's own.

    Equal sets are one node from the start. Nodes that share a band are candidates: each is checked against the
    least node of its bucket on full sets. A bucket whose members then still lie in several components is compared
    in blocks, member by member; so no pair that shares a band goes unchecked unless it is connected already.
    With bands of 6 of 256 coordinates, a pair at 0.8 shares none with probability 3e-6, at 0.85 2e-9.

    Null or blank texts have no shingles and are linked with nothing. Rows without doc_id take no part: their
    component_id is null and kept is true. Rows that repeat a doc_id are one node; each gives a row. An empty table
    gives an empty result; other columns are not read.
    """
    docs = id_and_text(docs)
    schema = "doc_id long, n_shingles long, set_id binary, bands array<long>"
    sketched = stored(docs.mapInArrow(_sketched(words), schema), "sketches")
    taking_part = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    filled = sketched.where(taking_part)
    sets = stored(filled.groupBy("set_id").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "sets")

    # Buckets of nodes that share a band, with the least node of each. Rows that repeat an id and its text are one node.
    # Sketches are moved only of sets that may have copies, to leave these out.
    of_copies = filled.select("doc_id", "set_id").join(sets.where("copies > 1").select("set_id", "node"), "set_id")
    copies = stored(of_copies.where("doc_id <> node").select(F.col("doc_id").alias("node"), "set_id"), "copies")
    repeated = filled.groupBy("doc_id", "set_id").agg(F.count("*").alias("times")).where("times > 1")
    some_repeat = not repeated.isEmpty()
    all_rows, copied = filled.select(F.col("doc_id").alias("node"), "set_id", "bands"), asking(sets.where("copies > 1"), "set_id")
    firsts = all_rows.where(copied("set_id")).join(copies, ["node", "set_id"], "left_anti")
    if some_repeat:
        firsts = firsts.dropDuplicates(["node", "set_id"])
    carriers = all_rows.where(~copied("set_id")).unionByName(firsts)
    members = carriers.select("node", F.explode("bands").alias("bucket"))
    hubs = (
        members.groupBy("bucket")
        .agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count("*").alias("size"))
        .where("hub < last")
        .select("bucket", "hub", "size")
    )
    shared = stored(members.join(hubs, "bucket"), "buckets", replaces=[copies])

    wanted = shared.select(F.col("node").alias("doc_id")).distinct()
    full = stored(_sets_of(docs, wanted, words), "shingles")
    if some_repeat:
        full = stored(full.dropDuplicates(["node", "shingles"]), "shingles", replaces=[full])

    # Joins move the sets that they need and few others, however many there are.
    pairs = stored(shared.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    of_a = full.toDF("a", "of_a").where(asking(pairs.select("a").distinct(), "a")("a"))
    of_b = full.toDF("b", "of_b").where(asking(pairs.select("b").distinct(), "b")("b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    checked = of_b.join(sent_round(pairs), "b").join(of_a, "a").where(
        100 * both >= percent * (F.size("of_a") + F.size("of_b") - both)
    )
    repeated_ids = (  # a doc_id with several texts joins their sets
        filled.groupBy("doc_id").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low < high")
        .select("doc_id").join(filled.select("doc_id", "set_id"), "doc_id").join(sets, "set_id").where("doc_id <> node")
        .select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()
    )
    links = stored(checked.select("a", "b"), "checked", replaces=[pairs])
    found = components(links)
    release(links)

    # Buckets whose members are still apart: every pair of members, in blocks.
    blocks = stored(_still_apart(shared, found), "blocks")
    in_blocks = asking(blocks.select("node").distinct(), "node")
    more = (
        full.where(in_blocks("node")).join(sent_round(blocks), "node")
        .select("merged", "group", "low", "high", "node", "component", "side", "shingles")
        .groupBy("merged", "group", "low", "high")
        .applyInPandas(_linked(percent), "a long, b long")
    )
    held = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    linked = components(held.unionByName(more).unionByName(repeated_ids))
    release(shared, full, found, blocks)

    named = sets.join(linked, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    return (
        sketched.select("doc_id", "n_shingles", F.when(taking_part, F.col("set_id")).alias("set_id"))
        .join(named, "set_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component", "doc_id").alias("component_id"),
            F.coalesce("component", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
        )
    )


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents on runs of two words, at 0.8; see ``near_duplicates`` for awkward rows."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=2, percent=80)
