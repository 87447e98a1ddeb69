"""Audits, gated changes and leak checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import whole_value


def series_audit(rows: DataFrame, key: str, month: str, value: str, legal: Column) -> DataFrame:
    """Violations (rule, key, detail): duplicate months, illegal values and gaps (Q1)."""
    index = F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int")
    twice = rows.groupBy(key, month).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate").alias("rule"), F.col(key), F.col(month).alias("detail"))
    wrong = rows.filter(~F.coalesce(legal, F.lit(False))).select(F.lit("illegal").alias("rule"), F.col(key), F.col(month).alias("detail"))
    step = index - F.lag(index).over(Window.partitionBy(key).orderBy(month))
    gaps = rows.select(key, month).distinct().withColumn("__step", step).filter("__step > 1").select(F.lit("gap").alias("rule"), F.col(key), F.col(month).alias("detail"))
    return twice.unionByName(wrong).unionByName(gaps)


def series_shape(records: DataFrame, key: str, months: str, values: str) -> DataFrame:
    """Violations (rule, key, detail) of series kept as two lists: missing or empty, of different lengths, months out of order (Q1)."""
    m, v = F.coalesce(months, F.array().cast("array<string>")), F.coalesce(F.size(values), F.lit(0))
    missing = F.when((F.size(m) == 0) | (v <= 0), F.struct(F.lit("missing").alias("rule"), F.lit("").alias("detail")))
    lengths = F.when((F.size(m) != v) & (F.size(m) > 0) & (v > 0), F.struct(F.lit("length").alias("rule"), F.concat_ws("/", F.size(m).cast("string"), v.cast("string")).alias("detail")))
    turned = F.filter(F.zip_with(F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0))), F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0))), lambda a, b: F.struct((a > b).alias("t"), b.alias("b"))), lambda x: x["t"])
    order = F.when(F.size(turned) > 0, F.struct(F.lit("unsorted").alias("rule"), F.get(turned, F.lit(0))["b"].alias("detail")))
    return records.select(F.col(key), F.inline(F.array_compact(F.array(missing, lengths, order)))).select("rule", key, "detail")


def dead_branches(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """name, n of each value that a rule may give, 0 for those it never gave; and of values that it may not give, as unlisted (Q8)."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n")).withColumnRenamed(column, "name")
    listed = rows.sparkSession.createDataFrame([(n,) for n in names], "name string")
    return counts.join(F.broadcast(listed.withColumn("listed", F.lit(True))), "name", "full").select("name", F.coalesce("n", F.lit(0)).alias("n"), F.col("listed").isNotNull().alias("listed"))


def source_registry(registry: DataFrame, findings: DataFrame, source: str, path: str) -> DataFrame:
    """Findings with their source's tier and whether it may be fetched (X4), and `covered`: whether what it covers (exact paths or all below
    them) holds the finding's path. registry: source_id, tier, coverage (paths), auto_fetchable; a source that is not in it covers nothing."""
    known = F.broadcast(registry.select(F.col("source_id").alias(source), "tier", "coverage", "auto_fetchable"))  # a registry is a short list
    joined = findings.join(known, source, "left")
    held_ = F.exists("coverage", lambda c: (F.col(path) == c) | F.startswith(F.col(path), F.concat(c, F.lit("."))))
    return joined.withColumn("covered", F.coalesce(held_, F.lit(False))).withColumn("auto_fetchable", F.coalesce("auto_fetchable", F.lit(False))).drop("coverage")


def methodology(stored: DataFrame, strict: DataFrame, loose: DataFrame, key: str, counts: list[str], median: str) -> DataFrame:
    """One row: how each definition agrees with the stored quarters and which is chosen (Q3, RC6)."""

    def verdict(computed: DataFrame, name: str) -> DataFrame:
        c = computed.select(key, *[F.col(x).alias(f"c_{x}") for x in [*counts, median]])
        j = stored.join(c, key)
        allowed = F.greatest(F.lit(1.0), F.bround(0.005 * sum(F.col(x) for x in counts)))
        off = [F.abs(F.col(x) - F.col(f"c_{x}")) for x in counts]
        same_median = F.col(median).eqNullSafe(F.col(f"c_{median}"))
        exact = same_median
        within = same_median
        for d in off:
            exact, within = exact & (d == 0), within & (d <= allowed)
        level = F.when(F.count("*") == 0, "mismatch").when(F.every(exact), "exact").when(F.every(within), "within").otherwise("mismatch")
        return j.agg(level.alias(name))

    both = verdict(strict, "strict").crossJoin(verdict(loose, "loose"))  # one row each
    chosen = F.when(F.col("strict") == "exact", "strict").when(F.col("loose") == "exact", "loose").when(F.col("strict") == "within", "strict").when(F.col("loose") == "within", "loose").otherwise("none")
    return both.withColumn("chosen", chosen)


def dispose(findings: DataFrame, protected: list[str], segment: str, drift: list[str]) -> DataFrame:
    """Adds category, eligible and flip by the nine rungs of the ladder (Q4, RC5).

    Columns read: path, found, tier, confidence, human_only, exists, current, verified.
    """
    path = F.col("path")
    out = path.rlike(segment)
    for prefix in protected:
        out = out | F.startswith(path, F.lit(prefix))
    same = F.col("exists") & F.col("found").eqNullSafe(F.col("current"))
    differs = F.col("exists") & ~F.col("found").eqNullSafe(F.col("current"))
    leaf = F.substring_index(path, ".", -1)
    rungs = [
        (out, "out_of_scope"),
        (F.col("human_only"), "auto_fetchable_false"),
        (F.col("confidence") == "low", "low_confidence"),
        (same, "no_change"),
        (F.col("verified").eqNullSafe(True) & differs, "unexpected_change"),
        (F.col("verified").eqNullSafe(False) & (F.col("tier") == 1), "verification_transition"),
        ((~F.col("exists") | F.col("current").isNull()) & F.col("found").isNotNull(), "new_coverage"),
        (leaf.isin(*drift), "expected_change"),
    ]
    category = F.lit("unexpected_change")
    for test, name in reversed(rungs):
        category = F.when(test, name).otherwise(category)
    eligible = F.col("category").isin("verification_transition", "new_coverage", "expected_change")
    return findings.withColumn("category", category).withColumn("eligible", eligible).withColumn("flip", F.col("category") == "verification_transition")


def leaks(records: DataFrame, texts: list[str], own: str) -> DataFrame:
    """Records of which some text still holds their own value, in any case, where no letter or digit adjoins it (Q6); there must be
    none. The column `leaks` names the texts. A blank value is none."""
    pattern = whole_value(F.col(own))
    found = F.array_compact(F.array(*[F.when(F.regexp_like(t, pattern), t) for t in texts]))
    return records.filter(F.trim(own) != "").withColumn("leaks", found).filter(F.size("leaks") > 0)


def population(rows: DataFrame) -> DataFrame:
    """column, filled: how many rows have a value that is not blank, one row a column."""
    counts = rows.agg(*[F.count_if(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")).alias(c) for c in rows.columns])
    return counts.unpivot([], rows.columns, "column", "filled")


def quarter_audit(records: DataFrame, quarter: str, numbers: list[str]) -> DataFrame:
    """Violations (rule, detail) of a table of fiscal quarters: repeats, inner gaps, and values that are no whole numbers (Q2).

    The numbers come as texts; null counts as none.
    """
    index = F.substring(quarter, 3, 4).try_cast("int") * 4 + F.substring(quarter, 8, 1).try_cast("int") - 1
    label = lambda n: F.concat(F.lit("FY"), F.floor(n / 4).cast("string"), F.lit("Q"), (F.pmod(n, F.lit(4)) + 1).cast("string"))
    twice = records.groupBy(quarter).count().filter("count > 1").select(F.lit("duplicate").alias("rule"), F.col(quarter).alias("detail"))
    span = records.agg(F.min(index).alias("a"), F.max(index).alias("z")).filter("a IS NOT NULL").select(F.explode(F.sequence("a", "z")).alias("n"))
    gaps = span.join(records.select(index.alias("n")).distinct(), "n", "left_anti").select(F.lit("gap").alias("rule"), label(F.col("n")).alias("detail"))
    wrong = records.select(quarter, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in numbers])).alias("v"))
    wrong = wrong.filter(~F.coalesce(F.col("v.value").rlike(r"^-?[0-9]+$"), F.lit(False))).select(F.lit("type").alias("rule"), F.concat_ws(": ", quarter, "v.name").alias("detail"))
    return twice.unionByName(gaps).unionByName(wrong)


def staleness(last: Column, expected: Column) -> Column:
    """Quarters that a newest quarter lies behind the expected one, 0 if none (Q12)."""
    index = lambda q: F.substring(q, 3, 4).try_cast("int") * 4 + F.substring(q, 8, 1).try_cast("int")
    return F.greatest(F.lit(0), index(expected) - index(last))


def identical_tables(rows: DataFrame, table: str, cells: list[str]) -> DataFrame:
    """table, same_as: extracted tables that hold the same rows as one with a smaller name, however ordered, which says that one was read
    twice (Q9). Rows are compared as a bag by count and sums of digests; no table is gathered in one place."""
    row = F.sha2(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}), 256)
    sums = [F.sum(F.conv(F.substring(row, at, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{at}") for at in (1, 13, 25, 37)]
    digests = rows.groupBy(table).agg(F.count("*").alias("n"), *sums)
    first = F.min(table).over(Window.partitionBy("n", "s1", "s13", "s25", "s37"))
    return digests.select(table, first.alias("same_as")).filter(F.col(table) != F.col("same_as"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows."""
    both = a.withColumn("__side", F.lit(1)).unionByName(b.withColumn("__side", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum("__side").alias("d")).filter("d <> 0").isEmpty()


def health(figures: dict[str, Column]) -> Column:
    """parse_ok (some figure was read) and notes, one for each that was not (Q10)."""
    notes = F.array_compact(F.array(*[F.when(c.isNull(), f"{n} is null") for n, c in figures.items()]))
    ok = F.lit(False)
    for c in figures.values():
        ok = ok | c.isNotNull()
    return F.struct(ok.alias("parse_ok"), notes.alias("notes"))


def forbid(rows: DataFrame, names: list[str]) -> DataFrame:
    """The rows, or an error if a column that must not be there is, in any case of letters."""
    found = sorted({n.lower() for n in names} & {c.lower() for c in rows.columns})
    if found:
        raise ValueError(f"forbidden columns: {', '.join(found)}")
    return rows


def flat_variables(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Exactly the named columns as texts, blank for null; a column that is missing is an error (P25)."""
    lacking = sorted(set(names.values()) - set(rows.columns))
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in names.items()])


def column_difference(records: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """key, side, name: names of a record that only the first or only the second of two maps has, such as a row of a CSV and of a JSON
    file (J26)."""
    only = lambda a, b, side: F.transform(F.array_except(F.map_keys(a), F.map_keys(b)), lambda n: F.struct(F.lit(side).alias("side"), n.alias("name")))
    return records.select(key, F.inline(F.concat(only(first, second, "first"), only(second, first, "second"))))


def leaf_in(path: Column, names: list[str]) -> Column:
    """Whether a path's last part is one of the names."""
    return F.substring_index(path, ".", -1).isin(*names)


def quorum_changes(quorum: DataFrame, store: DataFrame) -> DataFrame:
    """What resolved cells (path, value, confidence) would change in a store (path, value): path, old, new, existed.

    Unresolved cells, of low confidence, are skipped; equal values, null with null, are no change.
    """
    joined = quorum.filter("confidence <> 'low'").join(store.select("path", F.col("value").alias("old"), F.lit(True).alias("there")), "path", "left")
    return joined.filter(~(F.col("there").isNotNull() & F.col("old").eqNullSafe(F.col("value")))).select("path", "old", F.col("value").alias("new"), F.coalesce("there", F.lit(False)).alias("existed"))


def tallies(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """One row with the count of each name and of all others."""
    value = F.coalesce(F.col(column), F.lit(""))
    return rows.agg(*[F.count_if(value == n).alias(n) for n in names], F.count_if(~value.isin(*names)).alias("other"))


def fenced_json(text: Column, member: str) -> Column:
    """The first fenced JSON block of a text whose object has a member, or null."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)```json\s*\n(.*?)\n```"), F.lit(1))
    return F.get(F.filter(blocks, lambda b: F.get_json_object(b, f"$.{member}").isNotNull()), F.lit(0))


def leaves(documents: DataFrame, key: str, json: str, paths: list[str]) -> DataFrame:
    """key, path, value of the paths that a JSON document has; a path is names joined by dots."""
    found = F.array(*[F.struct(F.lit(p).alias("path"), F.get_json_object(json, "$." + p).alias("value")) for p in paths])
    return documents.select(key, F.inline(F.filter(found, lambda f: f["value"].isNotNull())))


def subtree_digest(store: DataFrame, prefixes: list[str]) -> DataFrame:
    """prefix, digest of all (path, value) at or below each protected prefix, in order of paths."""
    owner = F.array(*[F.when((F.col("path") == p) | F.startswith("path", F.lit(p + ".")), p) for p in prefixes])
    own = store.select(F.explode(F.array_compact(owner)).alias("prefix"), F.sha1(F.concat_ws("\x01", "path", F.coalesce("value", F.lit("\x02")))).alias("leaf"))
    # Order does not matter to a sum of leaf digests, so no subtree is gathered in one place.
    number = F.conv(F.substring("leaf", 1, 15), 16, 10).cast("decimal(38,0)")
    return own.groupBy("prefix").agg(F.count("*").alias("n"), F.sum(number).cast("string").alias("digest"))


def guarded_apply(store: DataFrame, changes: DataFrame, run_date: str, preserved: list[str]) -> DataFrame:
    """The store (path, value) after changes (path, value, flip), one a path (Q5).

    A change needs its parent: some path with the same parent, or the parent's own. One with `flip` turns its parent's
    `verified` from false to true. meta.version gets the next patch number and meta.last_verified the run's date. Changes
    without a parent, and any difference in a preserved subtree, are errors; nothing is returned then.
    """
    from ledgerloom.functions.text import next_patch

    parent = F.regexp_replace("path", r"\.[^.]+$", "")
    orphans = changes.withColumn("parent", parent).filter(F.instr("path", ".") > 0).join(store.select(parent.alias("parent")).distinct(), "parent", "left_anti")
    if not orphans.isEmpty():
        raise ValueError("a change whose parent is missing")
    flips = changes.filter("flip").select(F.concat(parent, F.lit(".verified")).alias("path")).distinct().withColumn("flipped", F.lit(True))
    after = store.join(changes.select("path", F.col("value").alias("new"), F.lit(True).alias("set")), "path", "full").join(flips, "path", "left")
    value = F.when(F.col("set"), F.col("new")).when(F.col("flipped") & (F.col("value") == "false"), "true").otherwise(F.col("value"))
    value = F.when(F.col("path") == "meta.version", next_patch(F.col("value"))).when(F.col("path") == "meta.last_verified", run_date).otherwise(value)
    after = after.select("path", value.alias("value"))
    if not same_rows(subtree_digest(store, preserved), subtree_digest(after, preserved)):
        raise ValueError("a preserved subtree would change")
    return after


def append_once(history: DataFrame, entry: DataFrame, month: str) -> DataFrame:
    """The history with an entry's months that it does not have yet (Q11)."""
    return history.unionByName(entry.join(history.select(month), month, "left_anti").select(*history.columns))


def page_age(stamp: Column, as_of: str, days: int) -> Column:
    """ACTION for a stamp that is missing or older than `days`, else OK."""
    age = F.datediff(F.lit(as_of).cast("date"), stamp)
    return F.when(stamp.isNull() | (age > days), "ACTION").otherwise("OK")


def audit_sections(rows: DataFrame, sections: dict[str, tuple[Column, Column, float]]) -> DataFrame:
    """section, checked, bad, share, ok for each named check (of which rows, what is wrong, largest share of wrong ones), in one
    pass (Q8)."""
    counts = [c for name, (of, wrong, _) in sections.items() for c in (F.count_if(of).alias(f"{name}__n"), F.count_if(of & wrong).alias(f"{name}__bad"))]
    one = rows.agg(*counts)
    listed = F.array(*[F.struct(F.lit(name).alias("section"), F.col(f"{name}__n").alias("checked"), F.col(f"{name}__bad").alias("bad"), F.lit(float(most)).alias("most")) for name, (_, _, most) in sections.items()])
    share = F.coalesce(F.try_divide(F.col("bad").cast("double"), F.col("checked").cast("double")), F.lit(0.0))
    return one.select(F.inline(listed)).select("section", "checked", "bad", F.round(share, 6).alias("share"), (share <= F.col("most")).alias("ok"))


def handled(items: DataFrame, kind: str, handlers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The union of what each kind's handler makes of its items (X1); handlers return the same columns, kinds without one an
    error naming them."""
    unknown = [r[0] for r in items.filter(~F.coalesce(F.col(kind), F.lit("")).isin(*handlers)).select(kind).distinct().limit(5).collect()]
    if unknown:
        raise ValueError(f"no handler for {', '.join(map(str, unknown))}")
    parts = [make(items.filter(F.col(kind) == name)) for name, make in handlers.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def same_value(a: Column, b: Column) -> Column:
    """Equality of JSON values in which null equals null and lists are compared item by item, white space apart."""
    plain = lambda c: F.when(F.trim(c).startswith("["), F.to_json(F.from_json(c, "array<string>"))).otherwise(F.trim(c))
    return plain(a).eqNullSafe(plain(b))
