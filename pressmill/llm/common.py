"""What the operators of this folder share: reading tables, cutting lineage, links to classes."""

from __future__ import annotations

import ctypes
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> None:
    """Sees to a checkpoint folder: the one the cluster names, or a new local one in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    context.setCheckpointDir(named)


def cut(frame: DataFrame) -> DataFrame:
    """The frame, stored in the shared checkpoint folder; Spark removes it with its last reference."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


#: Bytes that a batch for Python holds at most, and the session's setting for it with Spark's own value.
BATCH_BYTES, BATCH_SETTING, BATCH_DEFAULT = 1 << 22, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Small batches for Python, unless the session has chosen its own: they lie in the JVM and in Python at once."""
    if spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def give_back() -> None:
    """Returns free memory of a Python worker to the machine; an executor keeps idle workers for later."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to trim


def classes(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(node, root)`` for every node of the undirected links; root is the smallest node it reaches.

    Alternates the large-star and small-star steps (Kiveris and others, 2014) until nothing changes.
    Each step only groups links by node and takes a minimum, and a node never gathers its neighbours,
    so a star of any size is as good as a chain. The number of steps grows with the logarithm of the
    longest path.
    """
    spark = links.sparkSession
    edges = cut(
        links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
        .where(F.col("a") != F.col("b")).distinct()
    )
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("low_of"), F.least("a", "low").alias("low"))
        # large star: what lies above a node is linked to the lowest of the node's neighbours
        large = (
            both.where(F.col("b") > F.col("a")).join(low, F.col("a") == F.col("low_of"))
            .select(F.col("b").alias("a"), F.col("low").alias("b")).where("a != b").distinct()
        )
        # small star: a node and what lies below it are linked to the lowest of them
        floor = large.groupBy(F.col("a").alias("low_of")).agg(F.min("b").alias("low"))
        joined = large.join(floor, F.col("a") == F.col("low_of"))
        small = (
            joined.select("b", "low").withColumnRenamed("b", "a").withColumnRenamed("low", "b")
            .unionAll(joined.select("a", F.col("low").alias("b"))).where("a != b").distinct()
        )
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
