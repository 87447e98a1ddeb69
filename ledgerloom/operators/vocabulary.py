"""The vocabulary of clauses, derived from the corpus: verbs with their measured signals, objects, frames.

Nothing names a verb in advance. What a clause does is read from counts: how often the verb stands in capitals, at the
edges of a document, negated, and how much more often its documents carry the remand title than all do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.mining import clause_score, resolve_scope
from ledgerloom.session import held

REMAND = "REMAND ORDER"
#: Rows of a table that may be sent to all tasks; a larger one is joined by a shuffle.
MOST_SENT = 1_000_000


def lookup(rows: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """Left join with a vocabulary, which goes to the rows if it has at most MOST_SENT entries."""
    small = words.limit(MOST_SENT + 1).count() <= MOST_SENT
    return rows.join(F.broadcast(words) if small else words, key, "left")


def verbs(found: DataFrame, labels: DataFrame, floor: int = 20) -> DataFrame:
    """One row a verb of at least `floor` documents: docs, occurrences, caps_ratio, edge_share, negated_ratio, remand_lift and
    occurrences by scope (A6, A7, A8).

    found: doc_id, verb, caps, negated, scope, place (0 to 1); labels: doc_id, title, one row a document of the corpus. Counts
    are added up per document and verb first, so the title is joined to those rows.
    """
    one = lambda test: F.count_if(test).alias
    scope = F.col("scope")
    per = found.groupBy("doc_id", "verb").agg(
        F.count("*").alias("occurrences"), one(F.col("caps"))("caps"), one(F.col("negated"))("negated"), one((F.col("place") < 0.15) | (F.col("place") > 0.75))("edge"),
        one(scope == "partial")("scope_partial"), one(scope == "full")("scope_full"), one(scope == "unknown")("scope_unknown"),
    )
    remanded = F.coalesce((F.col("title") == REMAND).cast("int"), F.lit(0))
    summed = ["occurrences", "caps", "negated", "edge", "scope_partial", "scope_full", "scope_unknown"]
    per = per.join(labels.select("doc_id", remanded.alias("remanded")), "doc_id", "left")
    table = per.groupBy("verb").agg(F.count("*").alias("docs"), F.sum(F.coalesce("remanded", F.lit(0))).alias("remanded"), *[F.sum(c).alias(c) for c in summed]).filter(F.col("docs") >= floor)
    base = labels.agg(F.avg(remanded).alias("base"))  # one row
    table = table.crossJoin(F.broadcast(base))
    lift = F.when(F.col("base") > 0, F.col("remanded") / F.col("docs") / F.col("base")).otherwise(0.0)
    ratio = lambda c: F.round(F.col(c) / F.col("occurrences"), 4)
    return table.select("verb", "docs", "occurrences", ratio("caps").alias("caps_ratio"), ratio("edge").alias("edge_share"), ratio("negated").alias("negated_ratio"), F.round(lift, 3).alias("remand_lift"), "scope_partial", "scope_full", "scope_unknown")


def objects(found: DataFrame, labels: DataFrame, floor: int = 10) -> DataFrame:
    """object, docs, deny_rate (share of its documents whose petition was denied) of objects in `floor` documents."""
    per = found.select("doc_id", "object").distinct().join(labels.select("doc_id", "petition"), "doc_id", "left")
    return per.groupBy("object").agg(F.count("*").alias("docs"), F.round(F.count_if(F.col("petition") == "denied") / F.count("*"), 4).alias("deny_rate")).filter(F.col("docs") >= floor)


def frame_table(found: DataFrame, floor: int = 20) -> DataFrame:
    """verb, object, scope, docs of the frames in `floor` documents."""
    return found.groupBy("doc_id", "verb", "object").agg(F.min("scope").alias("scope")).groupBy("verb", "object").agg(F.min("scope").alias("scope"), F.count("*").alias("docs")).filter(F.col("docs") >= floor)


def residual(found: DataFrame, floor: int = 20, object_floor: int = 10) -> DataFrame:
    """One row: what the floors leave out (A10): frames and their document counts, and how much the kept objects cover."""
    frames = found.select("doc_id", "verb", "object").distinct().groupBy("verb", "object").count()
    rest = frames.agg(F.count_if(F.col("count") < floor).alias("frames_below"), F.coalesce(F.sum(F.when(F.col("count") < floor, F.col("count"))), F.lit(0)).alias("occurrences_below"))
    own = found.select("doc_id", "object").distinct().groupBy("object").count()
    cover = own.agg(F.count_if(F.col("count") >= object_floor).alias("objects_kept"), F.round(F.coalesce(100.0 * F.sum(F.when(F.col("count") >= object_floor, F.col("count")).otherwise(0)) / F.sum("count"), F.lit(0.0)), 4).alias("coverage"))
    return rest.crossJoin(cover)  # one row each


def write(found: DataFrame, labels: DataFrame, folder: str, floor: int = 20, object_floor: int = 10) -> None:
    """The vocabulary as three JSON tables and a summary under a folder (K3); existing ones are replaced."""
    found = held(found)
    parts = {"verbs": verbs(found, labels, floor), "objects": objects(found, labels, object_floor), "frames": frame_table(found, floor), "summary": residual(found, floor, object_floor)}
    for name, table in parts.items():
        table.write.mode("overwrite").json(f"{folder}/{name}")


def operative_clause(found: DataFrame, verb_table: DataFrame, object_table: DataFrame) -> DataFrame:
    """The clause that decides a document, one row each (D5, W7): doc_id, verb, object, negated, scope, score.

    Clauses of known verbs other than grant and deny count; the highest score wins, the earliest of ties; a winner that
    is never in capitals and hardly moves the title is dropped without a runner-up.
    """
    known = lookup(found.filter(~F.col("verb").rlike("^(grant|den[iy])")), verb_table.select("verb", "caps_ratio", "remand_lift"), "verb").filter(F.col("caps_ratio").isNotNull())
    known = lookup(known, object_table.select("object", "deny_rate"), "object")
    edge = (F.col("place") < 0.15) | (F.col("place") > 0.75)
    scored = known.withColumn("score", F.round(clause_score(F.col("caps_ratio"), F.col("caps"), edge, F.col("remand_lift")), 6))
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "place", "verb", "object"))).filter("n = 1")
    best = best.filter((F.col("caps_ratio") > 0) | (F.col("remand_lift") >= 2))
    return best.select("doc_id", "verb", "object", "negated", resolve_scope(F.col("verb"), F.col("deny_rate"), F.col("scope")).alias("scope"), "score")


def relative_place(begin: Column, text: Column) -> Column:
    """Where in its text a clause begins, from 0 to 1."""
    return begin / F.greatest(F.length(text), F.lit(1))
