"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of rows that go to a Python worker at a time: Spark counts rows, and rows may be long texts.
BATCH_BYTES = 8 << 20


def give_back() -> None:
    """Returns what a Python worker has freed to the system: workers are kept for later stages, which may need the memory elsewhere."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def given_back(batches_of: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function of batches, which gives memory back at its end."""

    def work(batches: Iterator) -> Iterator:
        yield from batches_of(batches)
        give_back()

    return work


def shared_folder(spark: SparkSession) -> None:
    """Batches for Python workers are bounded by bytes, and checkpoints go to the folder the cluster names in spark.checkpoint.dir.

    Only a local session, whose executors are this machine, may do without: it gets a temporary folder. A cluster that
    names none is an error, as its executors share no folder of one machine.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Removes a folder, wherever it is, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Links a task takes in a round; few links need few tasks, whatever the session's number of shuffle partitions.
TASK_LINKS = 200_000


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return int(row[0]), int(row[1] or 0)


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """From links (a, b) to (node, component), the component being its smallest node; nodes without links are absent.

    Each round hooks every node's larger neighbours, then its smaller ones, to its smallest neighbour, until nothing
    changes, after a number of rounds that grows with the logarithm of the longest chain. All steps are aggregations
    and equi-joins on links, whose number never grows; a node with very many links is one hot join key, which Spark
    splits. Each round ends in a checkpoint, so lost executors cost a round at most.
    """
    shared_folder(links.sparkSession)
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct().checkpoint()
    before = _state(edges)
    for _ in range(most_rounds):
        tasks = max(4, -(-before[0] // TASK_LINKS))
        edges = edges.coalesce(tasks)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks).distinct().coalesce(tasks)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").coalesce(tasks).distinct()
        edges = small.coalesce(tasks).checkpoint()
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    tops = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
