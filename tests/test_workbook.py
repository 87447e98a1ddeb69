"""The streaming workbook source against the whole-tree reader, by hand, and on a sheet of a million rows."""

import io
import random
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import readers, workbook

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(path, sheets, shared=None, absolute=False):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f"<workbook {MAIN}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        where = "/xl/worksheets" if absolute else "worksheets"
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="{where}/s{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        if shared is not None:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{''.join(shared)}</sst>")
        for k, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {MAIN}><cols><col/></cols><sheetData>{rows}</sheetData></worksheet>")


def rows_of(frame):
    return sorted((r.file, r.sheet, r.row, tuple(r.cells)) for r in frame.collect())


def test_cells_by_hand(spark, tmp_path):
    shared = ["<si><t>Case</t></si>", "<si><r><t>Sta</t></r><r><t xml:space='preserve'>tus </t></r><rPh sb='0' eb='1'><t>no</t></rPh></si>", "<si/>"]
    first = '<row r="1"><c r="A1" t="inlineStr"><is><t>1.0</t></is></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="AB3" t="s"><v>0</v></c></row><row><c><v>12.0</v></c><c/><c t="b"><v>1</v></c><c t="str"><f>A1&amp;"x"</f><v>2.0</v></c><c><v>-3.50</v></c><c t="s"><v>2</v></c></row><row r="9"/>'
    book(tmp_path / "b.xlsx", {"One": first, "Two &amp; 3": '<row r="1"><c r="B1"><v>7</v></c></row>', "Empty": ""}, shared)
    book(tmp_path / "c.xlsx", {"Only": '<row r="2"><c r="A2"><v>5.00</v></c></row>'}, absolute=True)
    (tmp_path / "note.txt").write_text("not a workbook")
    cells = workbook.workbook_sheets(spark, str(tmp_path))
    want = [
        ("b.xlsx", "One", 1, ("1.0",)), ("b.xlsx", "One", 3, ("Status ", *[""] * 26, "Case")), ("b.xlsx", "One", 4, ("12", "", "1", "2.0", "-3.50", "")), ("b.xlsx", "One", 9, ()),
        ("b.xlsx", "Two & 3", 1, ("", "7")), ("c.xlsx", "Only", 2, ("5",)),
    ]
    assert rows_of(cells) == want
    assert cells.rdd.getNumPartitions() == 4  # one a sheet
    assert rows_of(workbook.workbook_sheets(spark, str(tmp_path / "c.xlsx"))) == want[-1:]
    with pytest.raises(Exception, match="none.xlsx"):
        workbook.workbook_sheets(spark, str(tmp_path / "none.xlsx")).count()


def test_both_readers_read_the_same(spark, tmp_path):
    rng = random.Random(2)
    texts = ["a", "Ä & <b>", "1.0", "", "x" * 300, "漢字"]
    shared = [f"<si><t>{t.replace('&', '&amp;').replace('<', '&lt;')}</t></si>" for t in texts]

    def cell(column, row):
        kind = rng.randint(0, 4)
        at = f' r="{column}{row}"'
        return [f"<c{at}><v>{rng.choice(['1', '2.0', '-7.000', '0.5', '1E3'])}</v></c>", f'<c{at} t="s"><v>{rng.randint(0, len(texts) - 1)}</v></c>', f'<c{at} t="inlineStr"><is><t>in {row}</t></is></c>', f"<c{at}/>", ""][kind]

    for k in range(3):
        rows = {f"S{s}": "".join(f'<row r="{r}">' + "".join(cell(c, r) for c in ("A", "B", "C", "Z", "AA")) + "</row>" for r in sorted(rng.sample(range(1, 900), 300))) for s in range(3)}
        book(tmp_path / f"w{k}.xlsx", rows, shared)
    streaming, whole = workbook.workbook_sheets(spark, str(tmp_path)), readers.workbooks(spark, str(tmp_path))
    assert streaming.count() == 2700
    assert streaming.exceptAll(whole).count() == 0 and whole.exceptAll(streaming).count() == 0


def test_a_sheet_of_a_million_rows_in_bounded_memory(tmp_path):
    with zipfile.ZipFile(tmp_path / "big.xlsx", "w", zipfile.ZIP_DEFLATED) as z, z.open("s.xml", "w") as out:
        out.write(f"<worksheet {MAIN}><sheetData>".encode())
        for k in range(0, 1_000_000, 10_000):
            out.write("".join(f'<row r="{r}"><c r="A{r}"><v>{r}.0</v></c></row>' for r in range(k + 1, k + 10_001)).encode())
        out.write(b"</sheetData></worksheet>")
    n = total = 0
    with zipfile.ZipFile(tmp_path / "big.xlsx") as z, z.open("s.xml") as part:
        tracemalloc.start()
        for row, cells in workbook.sheet_rows(part, workbook.SharedStrings(None)):
            n, total = n + 1, total + int(cells[0])
            if n == 30_000:  # the measure slows the reading; by here memory is what it will be
                assert tracemalloc.get_traced_memory()[1] < 4_000_000
                tracemalloc.stop()
    assert (n, total) == (1_000_000, 500_000_500_000)


def test_shared_strings_are_packed():
    strings = workbook.SharedStrings(io.BytesIO(f"<sst {MAIN}>{''.join(f'<si><t>s{k}</t></si>' for k in range(5000))}</sst>".encode()))
    assert [strings[k] for k in (0, 1, 4999)] == ["s0", "s1", "s4999"] and len(strings.data) < 30_000
    assert [workbook.column_number(r) for r in ("A1", "Z9", "AA3", "", "7")] == [0, 25, 26, -1, -1]


def test_tables_go_out_as_workbooks_and_come_back(spark, tmp_path):
    rows = spark.range(500).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("n & <"), "id")).alias("name"), (F.col("id") / 4).alias("share"))
    written = workbook.write_workbooks(rows.repartition(3), str(tmp_path / "out"), 100).collect()
    assert sum(r.rows for r in written) == 500 and all(r.sheets == -(-r.rows // 100) for r in written)
    back = readers.named_rows(workbook.workbook_sheets(spark, str(tmp_path / "out")), ["share", "id", "name"])
    assert sorted((int(r.id), r.name or None, float(r.share)) for r in back.collect()) == [(k, f"n & <{k}" if k % 7 else None, k / 4) for k in range(500)]
