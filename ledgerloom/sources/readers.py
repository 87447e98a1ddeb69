"""Readers of the formats that public records come in (S*)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html import unescape
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import dates, text
from ledgerloom.sources.markup import html_tables, page_events  # noqa: F401

# Namespace of spreadsheet parts, as the format fixes it.
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id (file name without its ending), text: one row a file, in order of names."""
    read = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt")
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1)
    return read.select(F.url_decode(name).alias("doc_id"), F.col("value").alias("text")).orderBy("doc_id")


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """Header names lower-cased and trimmed, values trimmed, empty ones null."""
    read = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return read.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.strip().lower()) for c in read.columns])


def json_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file that holds an array, or an object with the array under `data`."""
    whole = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", f"struct<data:array<struct<{schema}>>>")["data"]
    plain = F.from_json("value", f"array<struct<{schema}>>")
    rows = F.when(F.ltrim("value").startswith("["), plain).otherwise(wrapped)
    return whole.select(F.inline(rows))


def nested_series(spark: SparkSession, path: str) -> DataFrame:
    """month, chart, category, country, token from an object nested in that order."""
    whole = spark.read.text(path, wholetext=True)
    months = whole.select(F.explode(F.from_json("value", "map<string,map<string,map<string,map<string,string>>>>")).alias("month", "m"))
    charts = months.select("month", F.explode("m").alias("chart", "c"))
    categories = charts.select("month", "chart", F.explode("c").alias("category", "k"))
    return categories.select("month", "chart", "category", F.explode("k").alias("country", "token"))


_XML_NAMES = frozenset(("amp", "lt", "gt", "quot", "apos"))


def _feed_rows(feed: str) -> Iterator[tuple]:
    """title, link, published and source of a feed's items, tags by their names whatever their namespaces; those before a break in the
    feed's form if it has one."""
    known = lambda m: m[0] if m[1] in _XML_NAMES else unescape(m[0]) if unescape(m[0]) != m[0] else f"&amp;{m[1]};"
    parser = ElementTree.XMLPullParser(("start", "end"))
    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    try:
        parser.feed(re.sub(r"&(\w+);", known, feed.lstrip("\ufeff \t\r\n")))
        events = parser.read_events()
        depth = 0
        for event, element in events:
            if local(element) not in ("item", "entry"):
                continue
            depth += 1 if event == "start" else -1
            if event == "end" and depth == 0:
                yield _feed_item(element, local)
                element.clear()
    except ElementTree.ParseError:
        return


def _feed_item(item: ElementTree.Element, local: Callable) -> tuple:
    texts: dict[str, str] = {}
    links: list[tuple[bool, str]] = []
    for child in item:
        name, value = local(child), "".join(child.itertext()).replace("\xa0", " ").strip()
        if name == "link":
            target = value or child.get("href")
            if target:
                links.append((child.get("rel") not in (None, "alternate"), target))
        elif value:
            texts.setdefault(name, value)
    when = next((texts[n] for n in ("pubDate", "published", "updated", "date") if n in texts), None)
    return texts.get("title"), min(links, key=lambda x: x[0])[1] if links else None, when, texts.get("source")


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """title, link, published, source of the items of RSS 2.0 and the entries of Atom feeds, byte order marks or not.

    A feed is one row, as feeds are short, and is read by events: namespaces, CDATA and attributes are the format's own. Named entities of
    HTML count as their characters. A feed that breaks off gives the items before.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for feed in batch.column(0).to_pylist() for row in _feed_rows(feed or "")]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["title", "link", "published", "source"])

    items = spark.read.text(path, wholetext=True).select("value").mapInArrow(read, "title string, link string, published string, source string")
    return items.select(*[F.nullif(text.strip_html(F.col(c)), F.lit("")).alias(c) if c in ("title", "source") else F.col(c) for c in items.columns])


def listing_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, href, title, date of a listing's rows that link to a PDF and carry a date (S17); others are left out."""
    rows = pages.select(key, F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<(li|tr)\b[^>]*>(.*?)</\1>"), F.lit(2))).alias("r"))
    href = F.regexp_extract("r", r"(?i)<a\b[^>]*href=[\"']([^\"']+\.pdf)[\"']", 1)
    title = text.bare_title(text.strip_html(F.regexp_extract("r", r"(?is)<a\b[^>]*>(.*?)</a>", 1)))
    dated = F.get(dates.prose_dates(text.strip_html(F.col("r"))), F.lit(0))["date"]
    return rows.select(key, href.alias("href"), title.alias("title"), dated.alias("date")).filter((F.col("href") != "") & F.col("date").isNotNull())


def tree_matches(spark: SparkSession, folder: str, endings: list[str], skip: list[str], patterns: dict[str, str]) -> DataFrame:
    """path, pattern, line, text of each line of a tree's files that a named pattern finds (S27); folders in `skip` are left out."""
    read = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    wanted = read.filter(F.col("path").rlike(r"\.(" + "|".join(endings) + ")$"))
    for name in skip:
        wanted = wanted.filter(~F.contains("path", F.lit(f"/{name}/")))
    lines = wanted.select("path", F.posexplode(F.split("value", "\n")).alias("at", "text"))
    found = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), n) for n, p in patterns.items()]))
    return lines.select("path", F.explode(found).alias("pattern"), (F.col("at") + 1).alias("line"), "text")


def page_index(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, kind, section, title, anchor of a page's headings, questions and glossary terms (S28): each stands in the last
    section heading before it."""
    tags = r"(?is)<(h2|h3|dt)\b([^>]*)>(.*?)</\1>"
    found = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(tags), F.lit(0))).alias("at", "t"))
    name = F.lower(F.regexp_extract("t", tags, 1))
    shown, anchor = text.strip_html(F.regexp_extract("t", tags, 3)), F.regexp_extract("t", r"(?i)^<[^>]*\bid=[\"']([^\"']+)", 1)
    above = F.last(F.when(name == "h2", shown), True).over(Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kind = F.when(name == "h2", "section").when(name == "h3", "question").otherwise("term")
    return found.select(key, kind.alias("kind"), above.alias("section"), shown.alias("title"), F.nullif(anchor, F.lit("")).alias("anchor")).filter(F.col("title") != "")


def first_readable(spark: SparkSession, csv_path: str, json_path: str, schema: str) -> tuple[DataFrame, str]:
    """The CSV table, or the JSON manifest where there is no CSV; with the name of what was read."""
    path_of, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    place = path_of(csv_path)
    if place.getFileSystem(conf).exists(place):
        return csv_table(spark, csv_path), "csv"
    return json_manifest(spark, json_path, schema), "json"


def country_tables(spark: SparkSession, paths: dict[str, str], month: str, target: str) -> tuple[DataFrame, dict[str, str]]:
    """One CSV a country as one table with `country`, and each one's status: ok, stale, unavailable.

    A table whose newest month lies before the target is stale and gives no rows. Countries are a short list.
    """
    path_of, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    kept, status = [], {}
    for country, path in paths.items():
        if not path_of(path).getFileSystem(conf).exists(path_of(path)):
            status[country] = "unavailable"
            continue
        table = csv_table(spark, path).withColumn("country", F.lit(country))
        newest = table.agg(F.max(month)).first()[0]
        status[country] = "ok" if newest is not None and newest >= target else "stale"
        if status[country] == "ok":
            kept.append(table)
    if not kept:
        raise ValueError(f"no table is up to date: {status}")
    out = kept[0]
    for table in kept[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out, status


def pasted(body: Column) -> Column:
    """What a pasted text is: link, bulletin (rows of cutoffs), wait (a duration), month (a scheduling month), or other."""
    lines = F.size(F.regexp_extract_all(body, F.lit(r"(?im)^\s*(?:1st|2nd|3rd|4th|5th)\b.*\b(?:\d{1,2}[A-Z]{3}\d{2}|C|U)\b"), F.lit(0)))
    return F.when(text.only_link(body).isNotNull(), "link").when(lines > 0, "bulletin").when(dates.duration_days(F.lower(body)).isNotNull(), "wait").when(dates.scheduling_month(body).isNotNull(), "month").otherwise("other")


def ordinal_year(year: Column) -> Column:
    """Number of a year in a listing that counts back from 2026 as 1; null outside 1 to 22."""
    number = 2027 - year
    return F.when(number.between(1, 22), number)


def table_by_header(tables: DataFrame, key: str, needed: list[str], caption: str = "") -> DataFrame:
    """Body rows, as maps by header name, of each page's first table whose header has all the names and whose caption starts
    so, in any case (P26, P15)."""
    heads = tables.filter("row = 0").filter(F.startswith(F.lower("caption"), F.lit(caption.lower())))
    for name in needed:
        heads = heads.filter(F.exists("cells", lambda c: F.contains(F.lower(c), F.lit(name.lower()))))
    first = heads.groupBy(key).agg(F.min_by(F.struct("table", F.col("cells").alias("names")), "table").alias("h")).select(key, "h.*")
    body = tables.filter("row > 0").join(first, [key, "table"])
    fits = F.size("cells") == F.size("names")  # rows of another arity are never shifted into place
    return body.select(key, "row", F.when(fits, F.map_from_arrays("names", "cells")).alias("record"), (~fits).alias("rejected"))


def _cells(blob: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """sheet, row number and cell texts of a workbook; whole numbers never read '1.0'."""
    with zipfile.ZipFile(io.BytesIO(blob)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for part in si if part.tag != f"{_SHEET}rPh" for t in part.iter(f"{_SHEET}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"):
            part = targets[sheet.get(_RELATION)].lstrip("/")
            tree = ElementTree.fromstring(book.read(part if part.startswith("xl/") else f"xl/{part}"))
            for row in tree.iter(f"{_SHEET}row"):
                cells: list[str] = []
                for cell in row.iter(f"{_SHEET}c"):
                    column = 0
                    for letter in re.match(r"[A-Z]*", cell.get("r") or "")[0]:
                        column = column * 26 + ord(letter) - 64
                    cells += [""] * (column - 1 - len(cells))
                    value = cell.find(f"{_SHEET}v")
                    raw = value.text or "" if value is not None else "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
                    if cell.get("t") == "s":
                        raw = shared[int(raw)]
                    elif cell.get("t", "n") == "n" and re.fullmatch(r"-?\d+\.0+", raw):
                        raw = raw.split(".")[0]
                    cells.append(raw)
                yield sheet.get("name"), int(row.get("r") or 0), cells


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """file, sheet, row, cells of all sheets of XLSX files (S12); each file is one task's, in memory."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select(F.col("_metadata.file_name").alias("file"), "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, blob in zip(batch["file"], batch["content"]):
                yield pd.DataFrame([(name, *row) for row in _cells(bytes(blob))], columns=["file", "sheet", "row", "cells"])

    return files.mapInPandas(read, "file string, sheet string, row int, cells array<string>")


def header_rows(cells: DataFrame, needed: list[str], within: int = 12) -> DataFrame:
    """The first row of each sheet, of its first `within`, that holds all the names."""
    found = cells.filter(F.col("row") <= within)
    for name in needed:
        found = found.filter(F.exists("cells", lambda c: F.lower(F.trim(c)) == name.lower()))
    first = F.row_number().over(Window.partitionBy("file", "sheet").orderBy("row"))
    return found.withColumn("__n", first).filter("__n = 1").select("file", "sheet", F.col("row").alias("header_row"), F.col("cells").alias("names"))


def named_rows(cells: DataFrame, needed: list[str]) -> DataFrame:
    """file, sheet, row and the needed columns by header name, never by position (S11); a sheet without them is an error."""
    heads = header_rows(cells, needed)
    lacking = cells.select("file", "sheet").distinct().join(heads, ["file", "sheet"], "left_anti").limit(5).collect()
    if lacking:
        raise ValueError(f"{', '.join(needed)} not found in {', '.join(f'{r.file}:{r.sheet}' for r in lacking)}")
    body = cells.join(heads, ["file", "sheet"]).filter(F.col("row") > F.col("header_row"))
    place = lambda name: F.array_position(F.transform("names", lambda c: F.lower(F.trim(c))), F.lit(name.lower()))
    return body.select("file", "sheet", "row", *[F.get("cells", (place(n) - 1).cast("int")).alias(n) for n in needed])


def sheet_year(cells: DataFrame) -> DataFrame:
    """file, sheet, year: the first year from 1990 to 2100 in a sheet's first rows or else its name."""
    year = r"\b(199\d|20\d\d|2100)\b"
    top = cells.filter(F.col("row") <= 12).withColumn("y", F.regexp_extract(F.array_join("cells", " "), year, 1))
    return top.groupBy("file", "sheet").agg(F.min_by("y", F.when(F.col("y") != "", F.col("row"))).alias("y")).select("file", "sheet", F.coalesce("y", F.nullif(F.regexp_extract("sheet", year, 1), F.lit(""))).try_cast("int").alias("year"))


def text_layer(glyphs: DataFrame, page: str, x: str, y: str, run: str, tolerance: float = 3.0) -> DataFrame:
    """Lines of a page from positioned runs (S25): a line is what lies within `tolerance` below its first run, left to right.

    The first run of a line fixes its place, so lines don't drift; that is a fold over one page's runs.
    """
    item = F.struct((-F.col(y)).alias("down"), F.col(x).alias("x"), F.col(run).alias("r"))
    none = F.struct(F.lit(None).cast("double").alias("top"), F.lit(-1).alias("line"), F.array().cast("array<struct<line:int,x:double,r:string>>").alias("out"))

    def step(acc: Column, g: Column) -> Column:
        same = acc["top"].isNotNull() & (g["down"] - acc["top"] <= tolerance)
        line = F.when(same, acc["line"]).otherwise(acc["line"] + 1)
        return F.struct(F.when(same, acc["top"]).otherwise(g["down"]).cast("double").alias("top"), line.alias("line"), F.concat(acc["out"], F.array(F.struct(line.alias("line"), g["x"].cast("double").alias("x"), g["r"].alias("r")))).alias("out"))

    folded = glyphs.groupBy(page).agg(F.aggregate(F.array_sort(F.collect_list(item)), none, step)["out"].alias("g"))
    placed = folded.select(page, F.inline("g"))
    ordered = F.array_sort(F.collect_list(F.struct("x", "r")))
    return placed.groupBy(page, "line").agg(F.array_join(F.transform(ordered, lambda g: g["r"]), " ").alias("text"))
