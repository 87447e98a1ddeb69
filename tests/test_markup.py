"""Pages by hand: nested tables, cells that stay open, tags in comments, broken ends."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.sources import markup, readers


def tables(html):
    return [(t.number, t.parent, t.caption, t.rows) for t in markup.PageReader().read(html).tables]


@pytest.mark.parametrize(
    "html, want",
    [
        ("<table><tr><td>1<table><tr><td>x</td></tr></table></td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>", [(0, None, None, [["1\nx", "2"], ["3", "4"]]), (1, 0, None, [["x"]])]),
        ("<table><tr><td>a<td>b<tr><td>c<th>d</table>", [(0, None, None, [["a", "b"], ["c", "d"]])]),
        ("<TABLE border=1><caption>T &amp; <b>U</b></caption><!-- <tr><td>no</td></tr> --><thead><tr><th>h</thead><tbody><tr><td>v</tbody></TABLE>", [(0, None, "T & U", [["h"], ["v"]])]),
        ("<table><tr><td><script>'</td><td>'</script>s</td></tr></table>", [(0, None, None, [["s"]])]),
        ("<table><tr><td>in<table><tr><td>deep<table><tr><td>deeper</table></table>out<td>next</table>", [(0, None, None, [["in\ndeep\ndeeper\nout", "next"]]), (1, 0, None, [["deep\ndeeper"]]), (2, 1, None, [["deeper"]])]),
        ("<table><td>no row<td>two</table>", [(0, None, None, [["no row", "two"]])]),
        ("<table><tr><td>never ends", [(0, None, None, [["never ends"]])]),
        ("</table></td><td>stray</td><tr><table><tr><td>1</td></tr></table></table>", [(0, None, None, [["1"]])]),
        ("<table><tr><td><p>a<p>b<br>c<ul><li>d<li>e</ul></td><td a='>'>f</td></tr></table>", [(0, None, None, [["a\nb\nc\nd\ne", "f"]])]),
        ("<table><tr><td>1</td></div></tr></p><td>2</td></table>", [(0, None, None, [["1"], ["2"]])]),
        ("<table><tr></tr><tr><td></td><td> </td></tr></table>", [(0, None, None, [[], ["", ""]])]),
        ("<p>2 < 3 & 4 > 1</p><table><tr><td>a < b</td></tr></table>", [(0, None, None, [["a < b"]])]),
    ],
)
def test_tables_by_hand(html, want):
    assert tables(html) == want


def test_events_headings_and_links():
    html = "<h2>First <a href='/f'>part</a></h2>intro<br>more<table><tr><td><a href=x.pdf>X</a> <h3>inner</h3></td></tr></table>between<h2>Second</h2><div><table></table><table><tr><th>n</th></tr></table></div>end<ul><li><a name=n>no</a><li><a href=\"/y?a=1&amp;b=2\">Y <b>z</b></a></ul>"
    page = markup.PageReader().read(html)
    assert page.events == [("text", "First part\nintro\nmore", None), ("table", "X\ninner", 0), ("text", "between\nSecond", None), ("table", "", 1), ("table", "n", 2), ("text", "end\nno\nY z", None)]
    assert [t.heading for t in page.tables] == ["First part", "Second", "Second"]
    assert page.links == [("/f", "part", "h2"), ("x.pdf", "X", "table/tr/td"), ("/y?a=1&b=2", "Y z", "ul/li")]


cells = st.recursive(st.text("ab ", min_size=1, max_size=3), lambda inner: st.lists(st.lists(inner, min_size=1, max_size=3), min_size=1, max_size=3), max_leaves=12)


def written(rows, close):
    body = "".join("<tr>" + "".join("<td>" + (c if isinstance(c, str) else written(c, close)) + "</td>" * close for c in row) + "</tr>" * close for row in rows)
    return f"<table>{body}</table>"


def plain(rows):
    return [["\n".join(" ".join(line.split()) for line in (c if isinstance(c, str) else "\n".join(" ".join(x for x in r if x) for r in plain(c))).split("\n") if line.strip()) for c in row] for row in rows]


def nested(rows):
    """All tables in the order they begin."""
    return [plain(rows), *[t for row in rows for c in row if not isinstance(c, str) for t in nested(c)]]


@given(st.lists(st.lists(cells, min_size=1, max_size=3), min_size=1, max_size=3), st.booleans())
@settings(max_examples=150, deadline=None)
def test_any_nesting_comes_back(rows, close):
    assert [t[3] for t in tables(written(rows, close))] == nested(rows)


@given(st.text("<>/table rdh!-\"'=a&;", max_size=60))
@settings(max_examples=200, deadline=None)
def test_no_text_breaks_the_reader(html):
    page = markup.PageReader().read(html)
    assert not page.open and not page.inside and len(page.sinks) == 1


def test_frames(spark):
    pages = spark.createDataFrame([("p", "<h2>H</h2><table><tr><th>Area<th>Number<tr><td>a<br>b<td>3<tr><td>lone</table>tail"), ("n", None), ("e", "")], "page string, body string")
    got = markup.html_tables(pages, "page", "body").orderBy("row").collect()
    assert [(r.page, r.table, r.caption, r.row, r.cells, r.parent, r.heading) for r in got] == [("p", 0, "", 0, ["Area", "Number"], None, "H"), ("p", 0, "", 1, ["a\nb", "3"], None, "H"), ("p", 0, "", 2, ["lone"], None, "H")]
    assert {r.row: r.rejected for r in readers.table_by_header(markup.html_tables(pages, "page", "body"), "page", ["area"]).collect()} == {1: False, 2: True}
    assert [(r.at, r.kind) for r in markup.page_events(pages, "page", "body").orderBy("at").collect()] == [(0, "text"), (1, "table"), (2, "text")]
    assert markup.page_links(pages, "page", "body").count() == 0
    mails = spark.createDataFrame([("<p>Hi <a href='u'>there</a></p><div>you</div>",), (None,)], "m string").select(markup.mail(F.col("m"), 9).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in mails] == [("Hi there\n", ["u"]), ("", [])]
