"""Session and table helpers shared by all queries."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and bench runs; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("ledgerloom")
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("LEDGERLOOM_DRIVER_MEMORY", "8g"),
    }
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; columns and filters reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_place(spark: SparkSession) -> str:
    """The checkpoint folder that the session names in spark.checkpoint.dir.

    A local session without one gets a temporary folder; a cluster without one is an error, as its executors share none.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


def held(df: DataFrame) -> DataFrame:
    """The rows as they are now, in the shared folder."""
    shared_place(df.sparkSession)
    return df.checkpoint()
