"""Sequences: deltas, states, islands, streaks, running totals and bounded folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lag_delta(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds delta to the previous row; null where either side is."""
    return rows.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(order)))


def movement_state(value: Column, delta: Column, tolerance: float) -> Column:
    """no data, start, stall, advance or retro."""
    return F.when(value.isNull(), "no-data").when(delta.isNull(), "start").when(F.abs(delta) <= tolerance, "stall").when(delta > 0, "advance").otherwise("retro")


def neighbour_mean(rows: DataFrame, key: str, order: str, value: str, below: float) -> DataFrame:
    """Adds the mean of the neighbours that exist, and whether the value is under `below` of it."""
    w = Window.partitionBy(key).orderBy(order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    have = before.isNotNull().cast("int") + after.isNotNull().cast("int")
    mean = F.when(have > 0, (F.coalesce(before, F.lit(0)) + F.coalesce(after, F.lit(0))) / have)
    return rows.withColumn("neighbours", mean).withColumn("is_low", F.coalesce(F.col(value) < below * F.col("neighbours"), F.lit(False)))


def islands(rows: DataFrame, key: list[str], order: str, inside: Column) -> DataFrame:
    """Maximal runs of consecutive rows where `inside` holds: first, last, rows."""
    w = Window.partitionBy(*key).orderBy(order)
    marked = rows.withColumn("__in", F.coalesce(inside, F.lit(False)))
    marked = marked.withColumn("__run", F.sum((~F.col("__in")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.filter("__in").groupBy(*key, "__run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("rows")).drop("__run")


def transition(previous: Column, current: Column) -> Column:
    """What became of a tri-state value: 'CURRENT', a date as text, or null."""
    return (
        F.when(previous.isNull() & current.isNull(), "still unavailable")
        .when(previous.isNull(), "reopened")
        .when(current.isNull(), "went unavailable")
        .when((previous == "CURRENT") & (current == "CURRENT"), "still current")
        .when(current == "CURRENT", "became current")
        .when(previous == "CURRENT", "left current")
        .when(previous == current, "unchanged")
        .when(previous < current, "advanced")
        .otherwise("retrogressed")
    )


def best_of_group(rows: DataFrame, key: str, score: str, ties: list[str]) -> DataFrame:
    """The row of highest score; among equals the first by `ties` (W7, trap B3)."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct((-F.col(score)).alias("s"), *ties)).alias("__r")).select(key, "__r.*")


def streaks(rows: DataFrame, key: str, order: list[str], hit: Column) -> DataFrame:
    """Adds `streak`: how many hits in a row end here; 0 on a miss."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.withColumn("__hit", hit).withColumn("__run", F.sum((~F.col("__hit")).cast("int")).over(w))
    inner = Window.partitionBy(key, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return run.withColumn("streak", F.sum(F.col("__hit").cast("int")).over(inner)).drop("__hit", "__run")


def capped_top(rows: DataFrame, group: str, order: list[Column], sub: str, labels: str, total: int, per_sub: int, per_label: int) -> DataFrame:
    """A greedy pick in order (W15): stop at `total`; skip an item whose sub is full, or all of whose labels are full.

    A skipped item uses no quota, so ranks alone can't tell; it is a fold. Few items come to it, though: what is full stays
    full, so of the items of one sub and one set of labels only the first `per_sub` can be taken. Of those with one set of
    labels at most `total` are taken, and at most `total` meet a full sub (total / per_sub full subs with per_sub items
    each) before the labels or the whole are full; so the first 2 * total decide. Uses built-in functions only.
    """
    kind = F.array_join(F.array_sort(F.array_distinct(labels)), "\u0001")
    rows = rows.withColumn("__kind", kind).withColumn("__k", F.row_number().over(Window.partitionBy(group, sub, "__kind").orderBy(*order))).filter(F.col("__k") <= per_sub)
    rows = rows.withColumn("__k", F.row_number().over(Window.partitionBy(group, "__kind").orderBy(*order))).filter(F.col("__k") <= 2 * total).drop("__kind", "__k")
    item = F.struct(*order, F.struct(*[c for c in rows.columns if c != group]).alias("__item"), F.col(sub).alias("__sub"), F.col(labels).alias("__labels"))
    start = F.struct(F.array().cast(f"array<struct<{', '.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in rows.schema if f.name != group)}>>").alias("taken"), F.create_map().cast("map<string,int>").alias("used"))

    def used(acc: Column, key: Column) -> Column:
        return F.coalesce(F.try_element_at(acc["used"], key), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        sub_key = F.concat(F.lit("s:"), x["__sub"])
        open_label = F.exists(x["__labels"], lambda l: used(acc, F.concat(F.lit("l:"), l)) < per_label)
        take = (F.size(acc["taken"]) < total) & (used(acc, sub_key) < per_sub) & open_label
        keys = F.concat(F.array(sub_key), F.transform(F.array_distinct(x["__labels"]), lambda l: F.concat(F.lit("l:"), l)))
        raised = F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), (used(acc, k) + 1).alias("value"))))
        kept = F.map_filter(acc["used"], lambda k, v: ~F.array_contains(keys, k))
        return F.when(take, F.struct(F.concat(acc["taken"], F.array(x["__item"])).alias("taken"), F.map_concat(kept, raised).alias("used"))).otherwise(acc)

    folded = rows.groupBy(group).agg(F.aggregate(F.array_sort(F.collect_list(item)), start, step).alias("acc"))
    return folded.select(group, F.posexplode("acc.taken").alias("place", "__item")).select(group, "place", "__item.*")


def ring(rows: DataFrame, key: str, order: list[str], value: str, size: int) -> DataFrame:
    """The last `size` values of each key that differ from the one before (T8), oldest first."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = rows.withColumn("__before", F.lag(value).over(w)).withColumn("__n", F.row_number().over(w)).filter((F.col("__n") == 1) | ~F.col(value).eqNullSafe(F.col("__before")))
    newest = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(o) for o in order]))
    last = changed.withColumn("__k", newest).filter(F.col("__k") <= size)
    return last.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("__k")).alias("k"), F.col(value).alias("v")))), lambda s: s["v"]).alias("history"))


def matrix(rows: DataFrame, key: str, column: str, value: str, columns: list) -> DataFrame:
    """One row a key with a column for each listed value of `column`."""
    return rows.groupBy(key).pivot(column, columns).agg(F.max(value))


def chart_kind(value: Column) -> Column:
    """kind (dated, current, gap) and for gaps the reason: unavailable for U, else none."""
    dated = F.try_to_date(value, "yyyy-MM-dd").isNotNull()
    kind = F.when(value == "CURRENT", "current").when(dated, "dated").otherwise("gap")
    return F.struct(kind.alias("kind"), F.when(kind == "gap", F.when(value == "U", "unavailable").otherwise("none")).alias("reason"))


def segments(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Runs of dated values as key, first, last, n, shape: segment, or point for a run of one; each current value is a marker of
    its own, and gaps and markers break runs (W17)."""
    rows = rows.withColumn("kind", chart_kind(F.col(value))["kind"])
    by = Window.partitionBy(key).orderBy(order)
    broken = rows.withColumn("run", F.sum(F.when(F.lag("kind").over(by).eqNullSafe("dated") & (F.col("kind") == "dated"), 0).otherwise(1)).over(by))
    drawn = broken.filter("kind <> 'gap'").groupBy(key, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), F.first("kind").alias("kind"))
    return drawn.select(key, "first", "last", "n", F.when(F.col("kind") == "current", "marker").when(F.col("n") > 1, "segment").otherwise("point").alias("shape"))


def scenario(has_data: Column, day: Column, cutoff: Column, near_days: float = 0.04 * 365.25) -> Column:
    """nodata, nopd, current, unavailable or project of a date against a tri-state cutoff."""
    behind = F.datediff(day, F.try_to_date(cutoff, "yyyy-MM-dd"))
    return F.when(~has_data, "nodata").when(day.isNull(), "nopd").when(cutoff == "CURRENT", "current").when(cutoff.isNull(), "unavailable").when(behind <= near_days, "current").otherwise("project")
