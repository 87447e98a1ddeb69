"""Tables read from laid-out text: sections between headings, columns by offset, rows that must fill every column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.dates import let


def section(text: Column, start: str, stop: str) -> Column:
    """The text between the first heading and the next stop heading behind it, or the rest; null without the heading."""
    at = F.regexp_instr(text, F.lit(start))
    rest = F.regexp_replace(F.substring(text, at, F.length(text)), f"^{start}", "")
    end = F.regexp_instr(rest, F.lit(stop))
    return F.when(at > 0, F.when(end > 0, F.substring(rest, F.lit(1), end - 1)).otherwise(rest))


def column_order(header: Column, markers: list[tuple[str, str]]) -> Column:
    """Names of the columns whose marker stands in the header lines, by its leftmost offset."""
    def leftmost(pattern: str) -> Column:
        return F.array_min(F.filter(F.transform(header, lambda line: F.regexp_instr(line, F.lit(pattern))), lambda x: x > 0))

    at = [F.struct(leftmost(pattern).alias("at"), F.lit(name).alias("name")) for name, pattern in markers]
    return F.transform(F.array_sort(F.filter(F.array(*at), lambda m: m["at"].isNotNull())), lambda m: m["name"])


def canonical(label: Column, aliases: dict[str, str]) -> Column:
    """The name that a label, in any case, is known by; null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), F.lower(F.trim(label)))


def row_category(label: Column, rules: list[tuple[str, str]]) -> Column:
    """The category of the first anchored pattern that matches; null for sub-rows and others."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(label.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


def table_rows(pages: DataFrame, key: str, slice_: Column, markers: list[tuple[str, str]], labels: dict[str, str], token: str, header_lines: int = 12) -> DataFrame:
    """Cells of a laid-out table: key, category, column, token, and `problem` for rows that don't fill the columns.

    A row starts with a label (pattern: category) at the line's start; the columns come from the lines above the first row. A
    row with more or fewer tokens than columns gives one reject, never a guess; of rows with one category the first stands.
    """
    label = r"(?i)^\s*(" + "|".join(labels) + r")\b"

    def read(line: Column) -> Column:
        """A line's label, or blank, and the tokens behind it; in lines without a label nothing is sought."""
        name = F.lower(F.regexp_extract(line, label, 1))
        return F.struct(name.alias("label"), F.when(name != "", F.regexp_extract_all(F.regexp_replace(line, label, ""), F.lit(token), F.lit(1))).alias("tokens"))

    def laid_out(lines: Column, rows: Column) -> Column:
        first = F.array_position(F.transform(rows, lambda r: F.coalesce(F.size(r["tokens"]) > 0, F.lit(False))), True).cast("int")
        header = F.slice(lines, F.greatest(F.lit(1), first - header_lines), F.least(F.lit(header_lines), first - 1))
        body = lambda order: F.transform(F.filter(F.slice(rows, first, F.size(rows)), lambda r: r["label"] != ""), lambda r, i: F.struct(i.alias("at"), order.alias("order"), canonical(r["label"], labels).alias("category"), r["tokens"].alias("tokens")))
        return F.when(first > 0, let(column_order(header, markers), lambda order: F.when(F.size(order) > 0, body(order))))

    # Lines are split and read once, rows leave in one piece, and one pass over them gives cells and rejects.
    every = let(F.split(slice_, "\n"), lambda lines: let(F.transform(lines, read), lambda rows: laid_out(lines, rows)))
    rows = pages.select(F.col(key).alias("key"), F.inline(every))
    fits = F.size("tokens") == F.size("order")
    first = F.row_number().over(Window.partitionBy("key", "category", "fits").orderBy("at"))
    kept = rows.withColumn("fits", fits).withColumn("n", first).filter("n = 1 OR NOT fits")
    cells = F.transform(F.arrays_zip(F.col("order").alias("column"), F.col("tokens").alias("token")), lambda c: F.struct(c["column"].alias("column"), c["token"].alias("token"), F.lit(None).cast("string").alias("problem")))
    problem = F.format_string("%d tokens for %d columns", F.size("tokens"), F.size("order"))
    reject = F.array(F.struct(F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("token"), problem.alias("problem")))
    return kept.select(F.col("key").alias(key), "category", F.inline(F.when(F.col("fits"), cells).otherwise(reject)))


def row_lookup(rows: Column, needles: dict[str, str]) -> Column:
    """values (a map by name) and notes: for each needle the value of the first row (label, value) whose label holds it, in any
    case; each missing one on its own has a null and a note (P27)."""
    hit = lambda needle: F.filter(rows, lambda r: F.contains(F.lower(r["label"]), F.lit(needle)))
    values = F.map_from_arrays(F.array(*map(F.lit, needles)), F.array(*[F.get(hit(n), F.lit(0))["value"] for n in needles.values()]))
    notes = F.array_compact(F.array(*[F.when(F.size(hit(n)) == 0, f"{name}: no row with '{n}'") for name, n in needles.items()]))
    return F.struct(values.alias("values"), notes.alias("notes"))


def findings(cells: DataFrame, key: str, grid: str) -> DataFrame:
    """key, path, found from a map of maps: one finding a cell, named by its keys."""
    outer = cells.select(key, F.explode(grid).alias("row", "own"))
    return outer.select(key, "row", F.explode("own").alias("column", "found")).select(key, F.concat_ws(".", "row", "column").alias("path"), "found")
