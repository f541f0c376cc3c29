"""Bounded samples of labelled documents, for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def remainder(n: int, id_col: str = "doc_id"):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


#: Parts that the documents of a label are ranked in before the first of all parts are ranked together.
PARTS = 256


def labelled_sample(
    docs: DataFrame, labelled: DataFrame, label: str, per_label: int, max_bytes: int
) -> list[tuple[str, object]]:
    """Up to ``per_label`` rows (text, label) of every label and about ``max_bytes`` of text per label, in an order that
    depends on doc_id alone; of a label whose documents are all larger, the smallest. ``labelled`` has doc_id, size (of
    the text) and the label; rows with a null among them are left out, and of rows that repeat a doc_id and label the
    shortest counts.

    Ids and sizes are ranked first, in parts; only the chosen texts are read and come to the driver, one for each id and
    size.
    """
    usable = labelled.select("doc_id", "size", F.col(label).alias("label")).dropna()
    usable = usable.groupBy("doc_id", "label").agg(F.min("size").alias("size"))
    usable = usable.withColumn("mark", F.xxhash64("doc_id"))
    for within in (["label", F.pmod(F.xxhash64("mark"), F.lit(PARTS))], ["label"]):
        order = W.partitionBy(*within).orderBy("mark", "doc_id")
        usable = usable.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_label)
    ranked = usable.collect()
    chosen, room = [], {}
    for row in sorted(ranked, key=lambda r: (str(r.label), r.rank)):
        left = room.get(row.label, max_bytes)
        if row.size <= left:
            chosen.append(row)
            room[row.label] = left - row.size
    for row in sorted(ranked, key=lambda r: (str(r.label), r.size, r.rank)):
        if row.label not in room:
            chosen.append(row)
            room[row.label] = 0
    if not chosen:
        return []
    # At most per_label rows a label, so they may go to every task.
    wanted = docs.sparkSession.createDataFrame([(r.doc_id, r.size) for r in chosen], "doc_id long, size long").distinct()
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.octet_length("text").cast("long").alias("size"))
    texts = texts.join(F.broadcast(wanted), ["doc_id", "size"]).groupBy("doc_id", "size").agg(F.min("text").alias("text"))
    text_of = {(r.doc_id, r.size): r.text for r in texts.collect()}
    found = sorted((str(r.label), r.doc_id, text_of[r.doc_id, r.size], r.label) for r in chosen)
    return [(text, label) for _, _, text, label in found]


def sized(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, size of the text in bytes, and further columns; never the text itself."""
    return docs.select("doc_id", F.octet_length("text").alias("size"), *columns)
