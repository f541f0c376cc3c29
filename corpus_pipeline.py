"""Preparation of a training corpus in stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import bpe, decontamination, quality, secrets
from tallyframe.llm.batches import read_table
from tallyframe.llm.filters import asking, sent_round
from tallyframe.llm.near_dedup import near_duplicates
from tallyframe.session import stored

#: The stages rest on trained models, edit distances and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``docs`` themselves, rejects go; so do null, empty and blank texts."""
    return quality.keep_good(docs, quality.train(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates (runs of five words, 0.8) the document with the smallest doc_id stays. Rows that
    repeat a doc_id and its text become one; rows without doc_id stay."""
    rows = near_duplicates(docs).where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("odd_id"))
    rows = rows.agg(F.count("*").alias("times"), F.count_if("kept").alias("kept"))
    odd = stored(rows.where("times > 1 OR kept <> 1"), "odd")
    # Most texts belong to ids of one row that stays, and are not moved.
    doc_id = F.col("doc_id").cast("long")
    may_be_odd = asking(odd, "odd_id")(doc_id)
    asked, same = docs.where(may_be_odd), doc_id == F.col("odd_id")
    out = docs.where(~may_be_odd).unionByName(asked.join(sent_round(odd.where("kept <> 1")), same, "left_anti"))
    several = odd.where("kept > 1")
    if several.isEmpty():
        return out
    return out.unionByName(asked.join(several, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which an item of ``benchmark`` occurs go."""
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text becomes a mark; n_chars follows."""
    return secrets.redact(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the bytes they decode to."""
    return bpe.round_trip(docs, with_ids=True)


STAGES = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("bpe_encoding", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the rows of the last one. What a stage kept is written and read again as the next
    one's documents, and deleted once that has written its own. Null, empty and repeated texts are treated as the stages
    say, an empty table gives no rows, and further columns go along to the last stage but one."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", replaces=[docs])
    return STAGES[-1][1](spark, docs, sf_dir)
