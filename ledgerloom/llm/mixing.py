"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source's documents stand in a shuffled order; one pass after another over that order makes the source's queue. The
virtual finish time of a document in a pass is the words of the queue up to its end, divided by the source's weight.
Sorted by that time over all sources and cut at the total budget, the queues give each source its weighted share; a
source whose queue ends leaves its share to the others by weight.

Running sums are built over ranges. In a source: over ranges of the shuffle, then within each, so a source that holds a
third of all rows is no single task. Over all sources: virtual time is cut into TIME_RANGES ranges, whose words are added
up; only the range in which the budget ends is sorted, as all before it are taken whole and none behind it. Words lie
evenly in virtual time, so no range is large. What the mix takes follows from the place of this cut alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.components import shared_folder

#: Ranges of the shuffle in each source, by the first three hex digits of the order key.
RANGE_DIGITS = 3
TIME_RANGES = 4096


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, most_passes: int) -> DataFrame:
    """One row a source (columns source, size): weight, virtual end of its queue and target.

    Weights go to the sources by name, null last, and repeat. The table of sources, one row each, is sorted in one task that
    spills; the rows of documents never meet there.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    listed = listed.withColumn("full", (F.col("size") * most_passes).cast("double")).withColumn("ends", F.col("full") / F.col("weight"))
    # At the virtual time where this source's queue ends: what the queues that have ended hold, and the weight of the rest.
    everything = Window.partitionBy()
    by_end = Window.orderBy("ends", F.col("source").asc_nulls_last())
    listed = listed.withColumn("total", F.sum("size").over(everything) * F.lit(float(budget)))
    before = by_end.rowsBetween(Window.unboundedPreceding, -1)
    listed = listed.withColumn("ended", F.coalesce(F.sum("full").over(before), F.lit(0.0)))
    listed = listed.withColumn("going", F.sum("weight").over(by_end.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    # The cut lies before this source's end if the shares would use up the budget by then.
    listed = listed.withColumn("cut_here", F.when(F.col("ended") + F.col("ends") * F.col("going") >= F.col("total"), (F.col("total") - F.col("ended")) / F.col("going")))
    listed = listed.withColumn("cut", F.max("cut_here").over(everything))
    return listed.withColumn("target", F.when(F.col("cut").isNull(), F.col("full")).otherwise(F.least(F.col("full"), F.col("cut") * F.col("weight")))).select("source", F.col("size").alias("source_size"), "weight", "cut", "target")


def _queued(sized: DataFrame, starts: DataFrame) -> DataFrame:
    """Adds ends, the words of the source's queue up to each row's end in the first pass, and the columns of starts."""
    inside = Window.partitionBy("queue", "range").orderBy("key", "doc", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sized.withColumn("inside", F.sum("size").over(inside)).join(starts, ["queue", "range"]).withColumn("ends", F.col("inside") + F.col("before"))


def finish_time(number: Column) -> Column:
    """Virtual finish time in a pass, from 0."""
    return (number * F.col("source_size") + F.col("ends")) / F.col("weight")


def budget_cut(queued: DataFrame, budget: float, most_passes: int) -> tuple[float, str]:
    """Virtual finish time and queue of the last document that the total budget holds, in the order of both.

    Sends TIME_RANGES sums and the cut itself to the driver.
    """
    entries = queued.filter("size > 0").select("size", "queue", F.explode(F.array(*[finish_time(F.lit(p)) for p in range(most_passes)])).alias("time"))
    total, latest = queued.agg(F.coalesce(F.sum("size"), F.lit(0)), F.max(finish_time(F.lit(most_passes - 1)))).first()
    allowed, nothing = total * budget, (-1.0, "")
    if not total:
        return nothing
    ranged = entries.withColumn("slot", F.floor(F.col("time") / F.lit(float(latest)) * TIME_RANGES))
    before = cut = 0
    for slot, words in sorted(ranged.groupBy("slot").agg(F.sum("size")).collect()):  # TIME_RANGES + 1 rows at most
        cut = slot
        if before + words > allowed:
            break
        before += words
    else:
        return float("inf"), ""
    order = Window.partitionBy("slot").orderBy("time", "queue").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = ranged.filter(F.col("slot") == cut).withColumn("words", F.sum("size").over(order) + F.lit(before)).filter(F.col("words") <= allowed)
    last = held.agg(F.max(F.struct("time", "queue")).alias("last")).first().last
    if last is None:  # the range starts beyond the budget: the cut is the last entry before it
        last = ranged.filter(F.col("slot") < cut).agg(F.max(F.struct("time", "queue")).alias("last")).first().last
    return nothing if last is None else (last.time, last.queue)


def _mixed(rows: DataFrame, weights: tuple[float, ...], budget: float, most_passes: int, seed: int, again: bool) -> DataFrame:
    """From (row, doc, text, source): row, size, source_size, target, weight, ends and epochs. With `again`, rows are not
    checkpointed with the counts but read once more."""
    shared_folder(rows.sparkSession)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc").cast("string"), F.lit("")), F.coalesce(F.md5("text"), F.lit(""))))
    queue = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    sized = rows.select("row", word_count(F.col("text")).alias("size"), key.alias("key"), queue.alias("queue"), "doc")
    sized = sized.withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    if again:
        counts = sized.drop("row").checkpoint()
    else:
        counts = sized = sized.checkpoint()
    ranges = counts.groupBy("queue", "range").agg(F.sum("size").alias("words"))
    sizes = ranges.groupBy("queue").agg(F.sum("words").alias("size")).withColumn("source", F.when(F.col("queue") != "n", F.expr("substring(queue, 2)")))
    targets = source_targets(sizes.select("source", "size"), weights, budget, most_passes)
    targets = targets.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("queue"), "source_size", "weight", "target")
    so_far = Window.partitionBy("queue").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("queue", "range", F.coalesce(F.sum("words").over(so_far), F.lit(0)).alias("before")).join(targets, "queue").checkpoint()
    queued = _queued(counts.drop("row"), starts).select("queue", "size", "ends", "source_size", "weight").checkpoint()
    time, last = budget_cut(queued, budget, most_passes)
    taken = lambda p: (F.col("size") > 0) & ((finish_time(F.lit(p)) < time) | (finish_time(F.lit(p)) == time) & (F.col("queue") <= last))
    epochs = sum((taken(p).cast("int") for p in range(1, most_passes)), taken(0).cast("int"))
    return _queued(sized, starts).select("row", "size", "source_size", "target", "weight", "ends", epochs.alias("epochs"))


def _struct(docs: DataFrame, kept: list[str], doc_id: str, text: str, source: str) -> DataFrame:
    """The rows as one struct, so their column names meet no helper's, beside what the mix looks at."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"), F.col(source).cast("string").alias("source"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, most_passes: int = 2, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep_text: bool = True) -> DataFrame:
    """Adds size, source_size, target, epochs (how often the mix takes the document, 0 included), taken (words, repeats
    counted) and virtual_time (finish time of its first pass). Null sources are one source; null texts have size 0 and are
    not taken.

    A document's pass is taken if its virtual finish time lies before the cut, where the total budget of words is used up;
    so the mix falls short of the budget by less than one document, and a source of its target by less than one of its own
    documents and its share of that rest. Order within a source is by a hash of seed, id and text: reruns agree, and repeated
    rows, which tie, are alike. The input may have columns of any names; those that have one of the new names are replaced.
    An empty table gives an empty table. The counts are checkpointed; with keep_text the texts are read again.
    """
    docs = docs.drop("size", "source_size", "target", "epochs", "taken", "virtual_time")
    rows = _struct(docs, [c for c in docs.columns if keep_text or c != text], doc_id, text, source)
    mixed = _mixed(rows, weights, budget, most_passes, seed, keep_text)
    return mixed.select("row.*", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"), finish_time(F.lit(0)).alias("virtual_time"))


def mixture(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, most_passes: int = 2, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each document as often as it is taken, sorted by virtual finish time over all partitions.

    Returns the columns of the input; rows of one document differ in nothing, as a repeat is the same text again.
    """
    mixed = _mixed(_struct(docs, docs.columns, doc_id, text, source), weights, budget, most_passes, seed, True).filter("epochs > 0")
    times = F.filter(F.transform(F.sequence(F.lit(0), F.lit(most_passes - 1)), finish_time), lambda _, i: i < F.col("epochs"))
    return mixed.select("row", F.explode(times).alias("time")).repartitionByRange("time").sortWithinPartitions("time").select("row.*")


SQL = r"""
WITH sized AS (
  SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')) AS k
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS size FROM sized GROUP BY source),
weighted AS (SELECT source, size, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1] AS w FROM sizes),
ending AS (SELECT *, 2.0::DOUBLE * size AS cap, 2.0::DOUBLE * size / w AS ends, sum(size) OVER () * 1.5::DOUBLE AS total FROM weighted),
shares AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY ends, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended,
         sum(w) OVER (ORDER BY ends, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS going FROM ending),
cuts AS (SELECT max((total - ended) / going) AS cut FROM shares WHERE ended + ends * going >= total),
targets AS (SELECT source, size AS source_size, CASE WHEN cut IS NULL THEN cap ELSE least(cap, cut * w) END AS target FROM shares CROSS JOIN cuts),
queued AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ended FROM sized),
finishing AS (
  SELECT r, q.source, q.size, (pass * t.source_size + ended) / w AS time
  FROM queued q JOIN weighted ON q.source IS NOT DISTINCT FROM weighted.source JOIN targets t ON q.source IS NOT DISTINCT FROM t.source
  CROSS JOIN (VALUES (0), (1)) AS passes(pass) WHERE q.size > 0),
sorted AS (SELECT *, sum(size) OVER (ORDER BY time, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS words FROM finishing),
mixed AS (SELECT r, sum(size)::BIGINT AS taken FROM sorted WHERE words <= (SELECT max(total) FROM ending) GROUP BY r)
SELECT q.doc_id, q.size, t.source_size, t.target, coalesce(taken, 0) AS taken
FROM sized q JOIN targets t ON q.source IS NOT DISTINCT FROM t.source LEFT JOIN mixed ON q.r = mixed.r
"""
