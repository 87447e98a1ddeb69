"""Places in a total order, and values carried along one, without sorting a table in one task.

Rows are dealt into ranges of the order and held there; each range is then sorted by itself, and what it needs of the
ranges before it (a count, a last value) is one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import held


def ranged(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """The rows with `__part`, their range of the order; held, so ranges don't change any more."""
    return held(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))


def numbered(rows: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """Adds the place of each row in the order, from 1."""
    parts = ranged(rows, order)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = parts.groupBy("__part").agg(F.count("*").alias("__rows")).select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.withColumn("__local", local).join(F.broadcast(offsets), "__part").withColumn(name, (F.col("__before") + F.col("__local")).cast("long")).drop("__part", "__local", "__before")


def carried(rows: DataFrame, order: list[Column | str], value: Column, name: str) -> DataFrame:
    """Adds the greatest value so far in the order, this row's included, nulls left out."""
    parts = ranged(rows.withColumn("__value", value), order)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    tops = parts.groupBy("__part").agg(F.max("__value").alias("__top")).select("__part", F.max("__top").over(before).alias("__carry"))
    here = F.max("__value").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return parts.withColumn("__here", here).join(F.broadcast(tops), "__part").withColumn(name, F.greatest("__here", "__carry")).drop("__part", "__value", "__here", "__carry")
