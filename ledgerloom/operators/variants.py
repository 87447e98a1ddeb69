"""JSON documents whose values may be of any type, as variants: get, set, parent, flatten, regroup, compare.

A path is member names and places in arrays joined by dots: `a.b.0.c`. Its leaves are values that hold nothing: texts, numbers, booleans,
null, and empty objects and arrays. Member names hold no dots; a document with one that does is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import held


def parent(path: Column) -> Column:
    """The path above; null at the top."""
    return F.when(F.instr(path, ".") > 0, F.regexp_replace(path, r"\.[^.]*$", ""))


def leaf(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def pointer(path: str) -> str:
    """A path as the engine's own functions take it."""
    steps = (f"[{part}]" if part.isdigit() else "['" + part.replace("'", "\\'") + "']" for part in path.split("."))
    return "$" + "".join(steps)


def get(document: Column, path: str, kind: str = "variant") -> Column:
    """(found, value) of a path in a variant: found is true for a JSON null too, whose value is null as any other kind. A value that can't be
    of the kind is null."""
    at = F.variant_get(document, pointer(path), "variant")
    return F.struct(at.isNotNull().alias("found"), F.try_variant_get(document, pointer(path), kind).alias("value"))


def _kind(value: Column) -> Column:
    """object, array or plain; empty objects and arrays are plain."""
    shown = F.to_json(value)
    first = F.substring(shown, 1, 1)
    return F.when(shown.isin("{}", "[]"), "plain").when(first == "{", "object").when(first == "[", "array").otherwise("plain")


def flatten(documents: DataFrame, key: str, document: str) -> DataFrame:
    """key, path, value (a variant) and kinds of all leaves of variants; a null document has none.

    kinds tells of each step from the top whether it is a member (o) or a place (a), so that leaves can be grouped again. Documents are taken
    apart a level at a time, in as many rounds as the deepest has levels; each round ends in a checkpoint.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(key).alias("k"), F.lit("").alias("path"), F.lit("").alias("kinds"), F.col(document).alias("v")).filter("v IS NOT NULL")
    # Documents are dealt out first, as a small file of them is one task and would stay one in each round.
    rows = held(rows.repartition("k").withColumn("kind", _kind(F.col("v"))))
    out = rows.filter("kind = 'plain'")
    while not (open_ := rows.filter("kind <> 'plain'")).isEmpty():
        inside = open_.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "name", "value"))
        name = F.when(F.col("kind") == "array", F.col("pos").cast("string")).otherwise(F.col("name"))
        safe = F.when(F.contains(name, F.lit(".")), F.raise_error(F.concat(F.lit("a member name with a dot: "), name)).cast("string")).otherwise(name)
        step = F.when(F.col("kind") == "array", "a").otherwise("o")
        rows = inside.select("k", F.when(F.col("path") == "", safe).otherwise(F.concat_ws(".", "path", safe)).alias("path"), F.concat("kinds", step).alias("kinds"), F.col("value").alias("v"))
        rows = held(rows.withColumn("kind", _kind(F.col("v"))))
        out = out.unionByName(rows.filter("kind = 'plain'"))
    return out.select(F.col("k").alias(key), "path", F.col("v").alias("value"), "kinds")


def regroup(leaves: DataFrame, key: str) -> DataFrame:
    """key, document: canonical JSON texts, members in order of names, of leaves (key, path, value, kinds), the deepest level first."""
    rows = held(leaves.select(F.col(key).alias("k"), "path", "kinds", F.to_json("value").alias("text")))
    while (deepest := rows.agg(F.max(F.length("kinds"))).first()[0]) or 0:
        here = rows.filter(F.length("kinds") == deepest)
        here = here.select("k", F.coalesce(parent(F.col("path")), F.lit("")).alias("path"), leaf(F.col("path")).alias("name"), F.substring("kinds", 1, deepest - 1).alias("kinds"), F.substring("kinds", deepest, 1).alias("step"), "text")
        place = F.when(F.col("step") == "a", F.col("name").try_cast("int"))
        # One object or array at a time: what a document's own value holds.
        members = here.groupBy("k", "path", "kinds", "step").agg(F.sort_array(F.collect_list(F.struct(place.alias("n"), "name", "text"))).alias("m"))
        objects = F.concat(F.lit("{"), F.array_join(F.transform("m", lambda x: F.concat(F.get(F.split(F.to_json(F.array(x["name"])), "^\\[|\\]$"), F.lit(1)), F.lit(":"), x["text"])), ","), F.lit("}"))
        arrays = F.concat(F.lit("["), F.array_join("m.text", ","), F.lit("]"))
        made = members.select("k", "path", "kinds", F.when(F.col("step") == "a", arrays).otherwise(objects).alias("text"))
        rows = held(rows.filter(F.length("kinds") < deepest).unionByName(made))
    return rows.select(F.col("k").alias(key), F.col("text").alias("document"))


def assign(leaves: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Leaves after changes (key, path, value as JSON text): a change takes the place of all at or below its path; a null value takes it away.

    A change whose parent is missing, or is a leaf, is an error (Q5): only members of objects are added.
    """
    new = changes.select(F.col(key).alias("k"), F.col("path").alias("p"), F.parse_json("value").alias("new"))
    own = leaves.select(F.col(key).alias("k"), "path", "value", "kinds")
    # Each leaf with all paths above it; a change is looked up among them.
    parts = F.split("path", r"\.")
    lines = own.withColumn("above", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))))
    gone = lines.join(new.select("k", F.col("p").alias("above")), ["k", "above"], "left_semi").select("k", "path").distinct()
    depth = F.size(F.split("p", r"\."))
    holders = lines.filter(F.col("above") != F.col("path")).select("k", F.col("above").alias("parent"), F.substring("kinds", F.lit(1), F.size(F.split("above", r"\."))).alias("upto"), F.substring("kinds", F.size(F.split("above", r"\.")) + 1, F.lit(1)).alias("step")).distinct()
    placed = new.withColumn("parent", parent(F.col("p"))).join(holders, ["k", "parent"], "left")
    lost = F.raise_error(F.concat(F.lit("no object above "), F.col("p"))).cast("string")
    kinds = F.when(F.col("parent").isNull(), "o").when(F.col("step") == "o", F.concat("upto", F.lit("o"))).when((F.col("step") == "a") & leaf(F.col("p")).rlike("^[0-9]+$"), F.concat("upto", F.lit("a"))).otherwise(lost)
    added = placed.select("k", F.col("p").alias("path"), F.col("new").alias("value"), kinds.alias("kinds"), depth.alias("d")).filter("value IS NOT NULL")
    kept = own.join(gone, ["k", "path"], "left_anti")
    # A new value may itself be an object: it is taken apart below its path.
    whole = flatten(added.select(F.struct("k", "path", "kinds").alias("k"), "value"), "k", "value").select("k.k", F.concat_ws(".", "k.path", F.nullif("path", F.lit(""))).alias("path"), "value", F.concat("k.kinds", "kinds").alias("kinds"))
    return kept.unionByName(whole).select(F.col("k").alias(key), "path", "value", "kinds")


def same(a: Column, b: Column) -> Column:
    """Whether two variants hold the same JSON: types count, so 1 is not "1", and null equals null; the order of members does not, as
    variants keep them sorted."""
    return F.to_json(a).eqNullSafe(F.to_json(b))
