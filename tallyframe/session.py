"""Spark session for local runs, and the folder shared by driver and executors."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and benchmarks. On a cluster, pass your own session to the queries instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyframe")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


#: Every map task keeps a size for each partition, and the driver all of them, so there cannot be any number.
MOST_PARTITIONS = 50_000


SHUFFLED = {"vote types": 0.002, "places": 3.1, "place shares": 6.3, "swing": 0.9}


def cluster_settings(input_bytes: int, partition_bytes: int = 64 * 1024**2, shuffled: float = 1.0) -> dict[str, str]:
    """SQL settings for a job over ``input_bytes``, of which it shuffles a ``shuffled`` share; pass them to the session
    builder.

    What is shuffled is what map-side sums leave, which differs a thousandfold between queries (SHUFFLED); a job over 100
    TB that shuffles a five-hundredth of it needs no more partitions than one of 200 GB. Partitions are of
    ``partition_bytes`` up to MOST_PARTITIONS of them; beyond they grow, and spill: split such a job by election.

    Adaptive execution merges small shuffle partitions and splits skewed ones, but cannot split an evenly large
    shuffle further, so the number to start from has to fit the data. Shuffled sums carry many repeated names and
    grow several-fold when read back, so partitions larger than this spill.
    """
    shuffle_bytes = max(1, round(input_bytes * shuffled))
    partition_bytes = max(partition_bytes, -(-shuffle_bytes // MOST_PARTITIONS))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        # A join hashes instead of sorting where every partition of one side turns out small enough.
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": str(64 * 1024**2),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(max(200, -(-shuffle_bytes // partition_bytes))),
        "spark.sql.session.timeZone": "UTC",
    }


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder path that driver and executors share; it is deleted when the driver ends.

    The parent is ``spark.checkpoint.dir``, or the checkpoint folder set on the context. A temporary folder serves
    only where neither names any and the master is local.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = context_dir.get() if context_dir.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = _local_root()
    folder = f"{root.rstrip('/')}/tallyframe-{uuid.uuid4().hex}-{purpose}"
    _made.append((spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), folder))
    return folder


def stored(
    table: DataFrame, purpose: str, partition_by: tuple[str, ...] = (), replaces: Iterable[DataFrame] = ()
) -> DataFrame:
    """The table written to a new shared folder and read back: its lineage ends there, so a lost executor costs
    no more than the stage that runs. Stored tables that it ``replaces`` are released once it is written."""
    folder = shared_folder(table.sparkSession, purpose)
    table.write.partitionBy(*partition_by).parquet(folder)
    read = table.sparkSession.read.schema(table.schema).parquet(folder)
    read._shared_folder = folder
    release(*replaces)
    return read


def release(*tables: DataFrame) -> None:
    """Delete the folders behind tables that ``stored`` gave, now that nothing reads them any more. Neither they nor what
    is derived from them can be read afterwards; other tables are left alone."""
    for table in tables:
        folder = getattr(table, "_shared_folder", None)
        if folder:
            remove_shared_folders(folder)


_made: list[tuple] = []


@lru_cache(maxsize=1)
def _local_root() -> str:
    root = tempfile.mkdtemp(prefix="tallyframe-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


@atexit.register
def remove_shared_folders(under: str = "") -> None:
    """Delete every folder handed out so far, or those whose path holds a text. Tables read from them are gone afterwards."""
    for made in [m for m in _made if under in m[2]]:
        _made.remove(made)
        jvm, conf, folder = made
        with contextlib.suppress(Exception):  # the JVM may have ended
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
