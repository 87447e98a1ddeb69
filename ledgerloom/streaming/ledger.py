"""Ledgers and stateful findings: batch forms over state tables, and their Structured Streaming counterparts.

A ledger here is a table. In batches, state is joined and written anew; in streams, Spark keeps it: a watermark bounds
what is remembered, and sinks commit before the state does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def finding_states(previous: DataFrame, current: DataFrame, key: str, urgency: str) -> DataFrame:
    """new, escalated, ongoing or resolved, by key (T5); a lower urgency number is more urgent."""
    p, c = previous.select(key, F.col(urgency).alias("__p")), current.select(key, F.col(urgency).alias("__c"))
    state = F.when(F.col("__c").isNull(), "resolved").when(F.col("__p").isNull(), "new").when(F.col("__c") < F.col("__p"), "escalated").otherwise("ongoing")
    return p.join(c, key, "full").select(key, state.alias("state"))


def next_ledger(ledger: DataFrame, current: DataFrame, key: str, urgency: str, today: str) -> DataFrame:
    """The ledger after a run (RC14): keys seen now, with first_seen kept; keys not seen are forgotten and would be new again."""
    old = ledger.select(key, F.col("first_seen").alias("__first"))
    return current.join(old, key, "left").select(key, F.col(urgency), F.coalesce("__first", F.lit(today)).alias("first_seen"), F.lit(today).alias("last_seen"))


def failure_counts(ledger: DataFrame, run: DataFrame, source: str, failed: str, escalate_at: int = 3) -> DataFrame:
    """Consecutive failures by source after a run, and whether they call for action (T6); success resets to 0."""
    old = ledger.select(source, F.col("failures").alias("__n"))
    n = F.when(F.col(failed), F.coalesce("__n", F.lit(0)) + 1).otherwise(F.lit(0))
    return run.join(old, source, "left").select(source, n.alias("failures"), (n >= escalate_at).alias("action"))


def snapshot(prior: DataFrame, fresh: DataFrame, key: str, day: str, run_date: str, days: int = 21) -> DataFrame:
    """Prior and fresh items, the fresh one winning, no older than `days` (T4, U3, RC16); blank keys and dates go."""
    both = prior.withColumn("__gen", F.lit(0)).unionByName(fresh.withColumn("__gen", F.lit(1)))
    alive = both.filter(F.col(key).isNotNull() & (F.col(key) != "") & F.try_to_date(day, "yyyy-MM-dd").isNotNull())
    alive = alive.filter(F.datediff(F.lit(run_date).cast("date"), F.try_to_date(day, "yyyy-MM-dd")) <= days)
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__gen"), F.desc(day)))
    return alive.withColumn("__k", newest).filter("__k = 1").drop("__gen", "__k")


def load_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ledger, or an empty one where none was ever written."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def new_items(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """A stream without what came before under the same key within `late`."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def window_counts(stream: DataFrame, time: str, key: str, width: str, slide: str | None, late: str) -> DataFrame:
    """Counts by key and window, each sent once the watermark has passed its end."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width, slide), key).agg(F.count("*").alias("n"))


def commit_each_batch(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame], None], ledger: Callable[[DataFrame], None]) -> StreamingQuery:
    """Runs `write` and then `ledger` on each micro-batch of what is there (K15, T2): a failed write leaves the ledger as it was."""

    def both(batch: DataFrame, _: int) -> None:
        write(batch)
        ledger(batch)

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
