import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import readers, sinks
from ledgerloom.sources.store import Store


def test_text_csv_and_json(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "A 1.txt").write_text("one\ntwo\n")
    assert [tuple(r) for r in readers.text_files(spark, str(tmp_path / "t")).collect()] == [("A 1", "one\ntwo\n")]
    (tmp_path / "x.csv").write_text(' Name ,VALUE\n" a ",1\nb,\n')
    assert [tuple(r) for r in readers.csv_table(spark, str(tmp_path / "x.csv")).collect()] == [("a", "1"), ("b", None)]
    for wrap in (lambda rows: rows, lambda rows: {"data": rows}):
        (tmp_path / "m.json").write_text(json.dumps(wrap([{"k": 1, "v": "x"}, {"k": 2}])))
        assert [tuple(r) for r in readers.json_manifest(spark, str(tmp_path / "m.json"), "k:int,v:string").collect()] == [(1, "x"), (2, None)]
    (tmp_path / "n.json").write_text(json.dumps({"2024-01": {"fad": {"A": {"X": "C", "Y": "01JAN20"}}}}))
    assert sorted(tuple(r) for r in readers.nested_series(spark, str(tmp_path / "n.json")).collect()) == [("2024-01", "fad", "A", "X", "C"), ("2024-01", "fad", "A", "Y", "01JAN20")]


def test_feed_and_html_tables(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A &amp; B</title><link>u</link><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item></channel></rss>")
    row = readers.feed_items(spark, str(tmp_path / "f.xml")).first()
    assert (row.title, row.link, row.source) == ("A & B", "u", None)
    html = "<table><tr><th>x</th></tr></table><!-- <table><tr><td>no</td></tr></table> --><table><tr><th>Area</th><th>Number</th></tr><tr><td>a<br>b</td><td>3</td></tr><tr><td>lone</td></tr></table>"
    tables = readers.html_tables(spark.createDataFrame([(1, html), (2, None)], "k int, html string"), "k", "html")
    got = {r.row: (r.record, r.rejected) for r in readers.table_by_header(tables, "k", ["area", "number"]).collect()}
    assert got == {1: ({"Area": "a\nb", "Number": "3"}, False), 2: (None, True)}


def _book(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Case</t></si><si><r><t>Sta</t></r><r><t>tus</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>note</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2" t="s"><v>0</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>D</t></is></c><c r="C3"><v>12.0</v></c></row></sheetData></worksheet>')
    path.write_bytes(out.getvalue())


def test_workbooks_by_header_name(spark, tmp_path):
    _book(tmp_path / "b.xlsx")
    cells = readers.workbooks(spark, str(tmp_path))
    assert cells.count() == 3
    assert [tuple(r) for r in readers.named_rows(cells, ["case", "status"]).select("row", "case", "status").collect()] == [(3, "12", "D")]
    with pytest.raises(ValueError, match="missing"):
        readers.named_rows(cells, ["missing"])
    assert [r.year for r in readers.sheet_year(cells).collect()] == [None]


def test_text_layer(spark):
    # 98 is within 3 of the run above it, but not of the line's first run.
    runs = [(1, 5.0, 100.0, "b"), (1, 1.0, 101.5, "a"), (1, 9.0, 98.0, "d"), (1, 1.0, 90.0, "c")]
    glyphs = spark.createDataFrame(runs, "page int, x double, y double, run string")
    assert [r.text for r in readers.text_layer(glyphs, "page", "x", "y", "run").orderBy("line").collect()] == ["a b", "d", "c"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", "t2"), (1, None, "t1")], "k int, v string, at string")
    lines = lambda name: [json.loads(r.value) for r in spark.read.text(str(tmp_path / name)).collect()]
    sinks.write_envelope(rows, str(tmp_path / "e"), 3, ["k"])
    assert lines("e/header") == [{"fields": ["k", "v", "at"], "schema_version": 3, "n_records": 2}]
    assert sorted(lines("e/records"), key=lambda r: r["k"]) == [{"k": 1, "v": None, "at": "t1"}, {"k": 2, "v": "b", "at": "t2"}]
    sinks.write_columnar(rows, str(tmp_path / "l"), ["k"])
    assert lines("l/header")[0]["fields"] == ["k", "v", "at"] and sorted(lines("l/records"), key=str) == [["1", None, "t1"], ["2", "b", "t2"]]
    pages = spark.createDataFrame([("q", "A", "s", "u", "b" * 900), ("a", "A", "s", "u", "x"), ("q", " ", "s", "v", "y")], "kind string, title string, section string, url string, body string")
    sinks.write_search_index(pages, str(tmp_path / "i"))
    assert lines("i/records") == [{"kind": "a", "title": "A", "section": "s", "url": "u", "body": "x"}]
    sinks.write_csv(rows, str(tmp_path / "c"), ["k"])
    assert readers.csv_table(spark, str(tmp_path / "c")).columns == ["k"]
    path = str(tmp_path / "p")
    assert sinks.write_if_changed(rows, path, None)
    later = rows.withColumn("at", F.lit("now")).repartition(3)
    assert not sinks.write_if_changed(later, path, spark.read.parquet(path), ["at"])
    assert sinks.digest(rows) != sinks.digest(later) and sinks.digest(rows.limit(0)) == "0:0:0:0:0"
    # The new rows may be read from the table they replace.
    stored = spark.read.parquet(path)
    assert sinks.write_if_changed(stored.filter("k = 1"), path, stored) and spark.read.parquet(path).count() == 1
    findings = spark.createDataFrame([("a", "ACTION", "t1"), ("b", "WATCH", "t1")], "id string, level string, seen string")
    assert sinks.write_report(findings, str(tmp_path / "r"), "id", "level")
    assert not sinks.write_report(findings.withColumn("seen", F.lit("t2")), str(tmp_path / "r"), "id", "level")
    assert sinks.write_report(findings.filter("id = 'a'"), str(tmp_path / "r"), "id", "level")


def test_gated_and_joint_sinks(spark, tmp_path):
    rows = spark.range(3)
    bad = lambda d: d.filter("id = 2")
    path = str(tmp_path / "g")
    assert len(sinks.write_gated(rows, path, bad, dry_run=False)) == 1 and Store(spark, path).state().version == 0
    assert sinks.write_gated(rows.filter("id < 2"), path, bad) == [] and Store(spark, path).state().version == 0
    assert sinks.write_gated(rows.filter("id < 2"), path, bad, dry_run=False) == [] and Store(spark, path).read("rows").count() == 2
    both = {"a": rows, "b": rows}
    sinks.write_tables(both, str(tmp_path / "j"), {"a": F.col("id") >= 0})
    with pytest.raises(ValueError):
        sinks.write_tables({"a": rows.limit(1), "b": rows}, str(tmp_path / "j"), {"b": F.col("id") > 0})
    assert Store(spark, str(tmp_path / "j")).read("a").count() == 3
    # A move that fails brings back what stood there.
    for name in ("a", "b"):
        rows.write.parquet(str(tmp_path / "m" / name))
    with pytest.raises(Exception):
        sinks._replace(spark, {str(tmp_path / "m/b"): str(tmp_path / "m/a"), str(tmp_path / "m/none"): str(tmp_path / "m/c")})
    assert spark.read.parquet(str(tmp_path / "m/a")).count() == 3


def test_atom_listings_events_trees_and_fallbacks(spark, tmp_path):
    (tmp_path / "a.xml").write_text('\ufeff<feed><entry><title><![CDATA[X & Y]]></title><link href="h"/><updated>2024-01-02</updated></entry></feed>')
    row = readers.feed_items(spark, str(tmp_path / "a.xml")).first()
    assert (row.title, row.link, row.published) == ("X & Y", "h", "2024-01-02")
    html = '<p>intro</p><ul><li><a href="/d/JAN1.pdf">One (PDF, 12 KB)</a> January 2, 2024</li><li><a href="/x.html">no</a> January 3, 2024</li><li><a href="/y.pdf">undated</a></li></ul><table><caption>Times</caption><tr><td>c</td></tr></table><h2 id="s">Sec</h2><h3 id="q-1">Why?</h3>end<dl><dt>Term</dt></dl>'
    pages = spark.createDataFrame([(1, html), (2, None)], "k int, html string")
    assert [(r.href, r.title, str(r.date)) for r in readers.listing_rows(pages, "k", "html").collect()] == [("/d/JAN1.pdf", "One", "2024-01-02")]
    assert [(r.kind, r.text.split()[0]) for r in readers.page_events(pages, "k", "html").orderBy("at").collect()] == [("text", "intro"), ("table", "Times"), ("text", "Sec")]
    assert sorted((r.kind, r.section, r.title, r.anchor) for r in readers.page_index(pages, "k", "html").collect()) == [("question", "Sec", "Why?", "q-1"), ("section", "Sec", "Sec", "s"), ("term", "Sec", "Term", None)]
    assert [r.caption for r in readers.html_tables(pages, "k", "html").collect()] == ["Times"]
    for name, body in (("t/a.py", "x\nTODO me\n"), ("t/skip/b.py", "TODO"), ("t/c.md", "TODO")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    assert [(r.pattern, r.line) for r in readers.tree_matches(spark, str(tmp_path / "t"), ["py"], ["skip"], {"todo": "TODO"}).collect()] == [("todo", 2)]
    (tmp_path / "in.csv").write_text("month,v\n2024-01,1\n")
    (tmp_path / "ch.csv").write_text("month,v\n2023-01,1\n")
    table, status = readers.country_tables(spark, {"in": str(tmp_path / "in.csv"), "ch": str(tmp_path / "ch.csv"), "mx": str(tmp_path / "mx.csv")}, "month", "2024-01")
    assert status == {"in": "ok", "ch": "stale", "mx": "unavailable"} and [r.country for r in table.collect()] == ["in"]
    (tmp_path / "m.json").write_text('[{"k": 1}]')
    assert readers.first_readable(spark, str(tmp_path / "none.csv"), str(tmp_path / "m.json"), "k:int")[1] == "json"
    assert readers.first_readable(spark, str(tmp_path / "in.csv"), str(tmp_path / "m.json"), "k:int")[1] == "csv"
    said = spark.createDataFrame([(" https://x.org/a ",), ("1st 01JAN20 C\n2nd C C",), ("1.5 months",), ("Sep-2024",), ("what",)], "t string")
    assert [r[0] for r in said.select(readers.pasted(F.col("t"))).collect()] == ["link", "bulletin", "wait", "month", "other"]
    assert [r[0] for r in spark.range(2004, 2028).select(readers.ordinal_year(F.col("id"))).collect()] == [None, *range(22, 0, -1), None]


def test_feeds_with_namespaces_sections_and_breaks(spark, tmp_path):
    rss = """\ufeff<?xml version="1.0"?><rss xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:a="http://www.w3.org/2005/Atom"><channel><title>Feed</title>
      <item><title><![CDATA[One </item> & <b>bold</b>]]></title><a:link rel="self" href="self"/><link>u1</link><dc:date>2024-01-02</dc:date><source url="x">S &eacute;</source></item>
      <item><dc:title>Two&nbsp;&unknown;</dc:title><link>u2</link><pubDate>Mon</pubDate><dc:date>later</dc:date></item><item/></channel></rss>"""
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">T &lt;i&gt;x&lt;/i&gt;</title><link rel="edit" href="e"/><link href="h"/><updated>d2</updated><published>d1</published></entry><entry><title>broken</entry>"""
    (tmp_path / "r.xml").write_text(rss)
    (tmp_path / "a.xml").write_text(atom)
    (tmp_path / "n.xml").write_text("no feed")
    got = [tuple(r) for r in readers.feed_items(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([("One & bold", "u1", "2024-01-02", "S é"), ("Two &unknown;", "u2", "Mon", None), (None, None, None, None), ("T x", "h", "d1", None)], key=str)
