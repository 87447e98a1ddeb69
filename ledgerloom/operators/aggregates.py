"""Aggregations of records work: shares, crosstabs, lift, quorum, medians, suppressed counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import held


def counts_with_share(rows: DataFrame, key: str, blank: str = "(blank)") -> DataFrame:
    """Rows of each key with their share of all; null and empty keys have one label (A1)."""
    named = F.coalesce(F.when(F.trim(F.col(key)) != "", F.col(key)), F.lit(blank))
    counted = rows.groupBy(named.alias(key)).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # one row a key


def rates(rows: DataFrame, key: str, flags: dict[str, Column], at_least: int) -> DataFrame:
    """n and the rate of each flag by key, of keys with enough rows (A4)."""
    measures = [F.avg(flag.cast("int")).alias(name) for name, flag in flags.items()]
    return rows.groupBy(key).agg(F.count("*").alias("n"), *measures).filter(F.col("n") >= at_least)


def dual_grain(tokens: DataFrame, doc: str, token: str) -> DataFrame:
    """docs and occurrences of each token (A6): counted within a document first, so the second shuffle is smaller."""
    per_doc = tokens.groupBy(token, doc).agg(F.count("*").alias("k"))
    return per_doc.groupBy(token).agg(F.count("*").alias("docs"), F.sum("k").alias("occurrences"))


def lift(tokens: DataFrame, doc: str, token: str, labels: DataFrame, label: str, at_least: int) -> DataFrame:
    """docs, rate and lift of a 0/1 label given a token, over labelled documents (A8); lift 0 where the base is 0."""
    base = labels.agg(F.avg(label).alias("base"))
    per = tokens.select(doc, token).distinct().join(labels, doc).groupBy(token).agg(F.count("*").alias("docs"), F.avg(label).alias("rate")).filter(F.col("docs") >= at_least)
    joined = per.crossJoin(F.broadcast(base))  # one row
    return joined.select(token, "docs", F.round("rate", 6).alias("rate"), F.round(F.when(F.col("base") > 0, F.col("rate") / F.col("base")).otherwise(0.0), 6).alias("lift"))


def quorum(votes: DataFrame, cell: list[str], value: str, source: str) -> DataFrame:
    """Agreement over sources, null being a value like any other (A11): value, confidence, sources."""
    seen = F.coalesce(F.col(value), F.lit("∅"))
    grouped = votes.groupBy(*cell).agg(F.count_distinct(source).alias("sources"), F.count_distinct(seen).alias("values"), F.max(value).alias("__v"))
    confidence = F.when(F.col("values") > 1, "low").when(F.col("sources") > 1, "high").otherwise("medium")
    return grouped.select(*cell, F.when(F.col("values") == 1, F.col("__v")).alias("value"), confidence.alias("confidence"), "sources")


#: Different values of a range when quantiles are looked for.
RANGE_VALUES = 200_000


def exact_quantiles(rows: DataFrame, key: list[str], value: str, shares: list[float], range_values: int = RANGE_VALUES) -> DataFrame:
    """key, share, quantile: exact quantiles of each group's values that are not null, between two values in proportion.

    Equal values are counted before they move. The counts are cut into ranges of (key, value), so a group of any size lies in as
    many ranges as it needs; the ranges' sums tell which of them holds a quantile, and only those are put in order. key may be
    empty: the whole table is a group. A group without values gives no row.
    """
    keyed = rows.select(F.struct(*key, F.lit(0).alias("__one")).alias("k"), F.col(value).alias("v")).filter("v IS NOT NULL")
    counted = keyed.groupBy("k", "v").agg(F.count("*").alias("n"))
    counted = held(counted)
    ranges = max(1, -(-counted.count() // range_values))
    placed = held(counted.repartitionByRange(ranges, "k", "v").withColumn("part", F.spark_partition_id()))
    parts = placed.groupBy("k", "part").agg(F.sum("n").alias("n"))
    along = Window.partitionBy("k").orderBy("part")
    parts = parts.withColumn("before", F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy("k")))
    wanted = parts.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("h", F.col("share") * (F.col("total") - 1))
    ends = F.array(F.struct(F.floor("h").alias("place"), F.lit(0).alias("upper")), F.struct(F.ceil("h").alias("place"), F.lit(1).alias("upper")))
    wanted = wanted.withColumn("end", F.explode(ends)).filter((F.col("end.place") >= F.col("before")) & (F.col("end.place") < F.col("before") + F.col("n")))
    wanted = wanted.select("k", "part", "before", "share", "h", "end.place", "end.upper")
    inside = Window.partitionBy("k", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = placed.join(wanted.select("k", "part").distinct(), ["k", "part"], "left_semi").withColumn("upto", F.sum("n").over(inside))
    met = ordered.join(wanted, ["k", "part"]).filter((F.col("place") >= F.col("before") + F.col("upto") - F.col("n")) & (F.col("place") < F.col("before") + F.col("upto")))
    side = lambda u: F.max(F.when(F.col("upper") == u, F.col("v"))).cast("double")
    found = met.groupBy("k", "share", "h").agg(side(0).alias("low"), side(1).alias("high"))
    return found.select(*[F.col("k")[c].alias(c) for c in key], "share", (F.col("low") + (F.col("h") - F.floor("h")) * (F.col("high") - F.col("low"))).alias("quantile"))


def exact_median(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """n (all rows) and the median of the values that are not negative, rounded half to even (A12, traps B17 and B19)."""
    counts = rows.groupBy(*key).agg(F.count("*").alias("n"))
    medians = exact_quantiles(rows.filter(F.col(value) >= 0), key, value, [0.5]).select(*key, F.bround("quantile").cast("long").alias("median"))
    return counts.join(medians, key)


def suppressed_band(counted: DataFrame, group: str, count: str, below: int = 11) -> DataFrame:
    """Sum of counts where small ones are known only as 1 to 10: low, high and whether the band is narrow."""
    known, hidden = F.sum(F.when(F.col(count) >= below, F.col(count)).otherwise(0)), F.count_if((F.col(count) > 0) & (F.col(count) < below))
    banded = counted.groupBy(group).agg(known.alias("known"), hidden.alias("suppressed"))
    low, high = F.col("known") + F.col("suppressed"), F.col("known") + (below - 1) * F.col("suppressed")
    return banded.select(group, "known", "suppressed", low.alias("low"), high.alias("high"), (high - low < F.greatest(F.lit(50.0), 0.01 * high)).alias("is_point"))


def all_or_null_sum(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """The sum if every row of the key has a value, else null."""
    return rows.groupBy(key).agg(F.when(F.count(value) == F.count("*"), F.sum(value)).alias("total"))


def fingerprint(rows: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """First 16 hex digits of the SHA-1 of a key's sorted entries (A24); entries of one key are few."""
    entry = F.concat_ws("=", *[F.col(p).cast("string") for p in parts])
    return rows.groupBy(key).agg(F.substring(F.sha1(F.array_join(F.array_sort(F.collect_list(entry)), "|")), 1, 16).alias("fingerprint"))


def unpivot_ranked(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Flags counted over all rows, one row a flag that occurs, with its rank."""
    one = rows.agg(*[F.count_if(flag).alias(name) for name, flag in flags.items()])
    long = one.unpivot([], list(flags), "flag", "n").filter("n > 0")
    return long.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "flag")))
