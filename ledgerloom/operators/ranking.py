"""Orders, pages, slots and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.ordered import numbered


def rank_of(column: str, order: list[str], default: int) -> Column:
    """Place of a value in a listed order."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(column)), F.lit(0)), F.lit(default)).cast("int")


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` from 1 (W6): a top-n, as no page is taken from the whole sorted table."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def slots(rows: DataFrame, group: str, wanted: str, order: list[str], size: int) -> DataFrame:
    """Fills `size` slots (O6): the first claimant of a slot gets it; holes are filled from the rest in order."""
    w = Window.partitionBy(group)
    claim = F.when(F.col(wanted).between(1, size), F.col(wanted))
    claimed = rows.withColumn("__claim", claim).withColumn("__k", F.row_number().over(Window.partitionBy(group, "__claim").orderBy(*order)))
    claimed = claimed.withColumn("slot", F.when(F.col("__claim").isNotNull() & (F.col("__k") == 1), F.col("__claim")))
    taken = F.array_sort(F.collect_set("slot").over(w))
    holes = F.array_except(F.sequence(F.lit(1), F.lit(size)), taken)
    rest = claimed.withColumn("__holes", holes).withColumn("__n", F.row_number().over(Window.partitionBy(group, F.col("slot").isNull()).orderBy(*order)))
    placed = F.coalesce("slot", F.when(F.col("__n") <= F.size("__holes"), F.get("__holes", F.col("__n") - 1)))
    return rest.withColumn("slot", placed).filter("slot IS NOT NULL").select(*rows.columns, "slot")


def stratified(rows: DataFrame, strata: list[str], key: str, n: int, seed: int) -> DataFrame:
    """n rows, one from each stratum in turn, largest stratum first (O7); the draw is a hash of key and seed."""
    sizes = rows.groupBy(*strata).agg(F.count("*").alias("__size"))
    w = Window.partitionBy(*strata).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
    drawn = rows.withColumn("round", F.row_number().over(w)).filter(F.col("round") <= n).join(sizes, strata)
    return drawn.orderBy("round", F.desc("__size"), *strata).limit(n).drop("__size")


def rotation(rows: DataFrame, order: list[str], day: int, budget: int) -> DataFrame:
    """The `budget` rows whose turn it is on a day of the year, round robin."""
    placed = numbered(rows, order, "__i")
    turn = F.pmod(F.col("__i") - 1 - F.lit(day * budget), F.lit(max(1, placed.count())))
    return placed.withColumn("turn", turn).filter(F.col("turn") < budget).withColumn("turn", F.col("turn").cast("int")).drop("__i")
