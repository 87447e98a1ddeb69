"""Workbooks as a data source: a partition a sheet, read row by row in bounded memory.

A sheet's part of the file is unpacked and parsed piece by piece, so a task holds some rows and the workbook's shared strings, packed,
but never the sheet. `readers.workbooks` reads the same in another way, whole trees at once, and stands beside this for Q7.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CELLS = "file string, sheet string, row int, cells array<string>"
PIECE_BYTES, BATCH_ROWS = 1 << 16, 4096
# Names that the format gives to its parts.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_WHOLE = re.compile(r"-?\d+\.0+")


class SharedStrings:
    """A workbook's strings by number, as one run of bytes with their ends."""

    def __init__(self, part: io.BufferedIOBase | None) -> None:
        self.data, self.ends = bytearray(), array("q", [0])
        if part is None:
            return
        parser = expat.ParserCreate(namespace_separator=" ")
        texts: list[str] = []
        inside = {"t": False, "rPh": False}

        def start(name: str, _: dict) -> None:
            local = name.rpartition(" ")[2]
            if local in inside:
                inside[local] = True

        def end(name: str) -> None:
            local = name.rpartition(" ")[2]
            if local in inside:
                inside[local] = False
            elif local == "si":
                self.data += "".join(texts).encode("utf-8", "surrogatepass")
                self.ends.append(len(self.data))
                texts.clear()

        parser.StartElementHandler, parser.EndElementHandler = start, end
        parser.CharacterDataHandler = lambda data: texts.append(data) if inside["t"] and not inside["rPh"] else None
        while piece := part.read(PIECE_BYTES):
            parser.Parse(piece, False)
        parser.Parse(b"", True)

    def __getitem__(self, number: int) -> str:
        return self.data[self.ends[number] : self.ends[number + 1]].decode("utf-8", "surrogatepass")


def column_number(reference: str) -> int:
    """0 for A, 25 for Z, 26 for AA; -1 without letters."""
    number = 0
    for letter in reference:
        if not "A" <= letter <= "Z":
            break
        number = number * 26 + ord(letter) - 64
    return number - 1


def sheet_rows(part: io.BufferedIOBase, shared: SharedStrings) -> Iterator[tuple[int, list[str]]]:
    """Row number and cell texts, as pieces of the sheet are parsed. Whole numbers never read '1.0'; cells that a row leaves out are
    empty; a row without a number follows the one before."""
    ready: list[tuple[int, list[str]]] = []
    state = {"row": 0, "at": -1, "kind": "", "take": False}
    cells: list[str] = []
    texts: list[str] = []

    def start(name: str, attrs: dict) -> None:
        local = name.rpartition(" ")[2]
        if local == "row":
            state["row"] = int(attrs["r"]) if "r" in attrs else state["row"] + 1
            cells.clear()
        elif local == "c":
            at = column_number(attrs.get("r", ""))
            state["at"], state["kind"] = len(cells) if at < 0 else at, attrs.get("t", "")
            texts.clear()
        elif local in ("v", "t"):
            state["take"] = (local == "t") == (state["kind"] == "inlineStr")

    def end(name: str) -> None:
        local = name.rpartition(" ")[2]
        if local in ("v", "t"):
            state["take"] = False
        elif local == "c":
            value = "".join(texts)
            if state["kind"] == "s" and value:
                value = shared[int(value)]
            elif state["kind"] in ("", "n") and _WHOLE.fullmatch(value):
                value = value.partition(".")[0]
            cells.extend([""] * (state["at"] - len(cells)))
            cells.append(value)
        elif local == "row":
            ready.append((state["row"], cells.copy()))

    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda data: texts.append(data) if state["take"] else None
    while piece := part.read(PIECE_BYTES):
        parser.Parse(piece, False)
        yield from ready
        ready.clear()
    parser.Parse(b"", True)
    yield from ready


@dataclass
class Sheet(InputPartition):
    path: str
    file: str
    name: str
    part: str

    def __init__(self, path: str, file: str, name: str, part: str) -> None:
        super().__init__(None)
        self.path, self.file, self.name, self.part = path, file, name, part


def sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Name and part of each sheet, in their order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = []
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{{{_MAIN}}}sheet"):
        target = targets[sheet.get(_LINK)]
        found.append((sheet.get("name"), target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")))
    return found


def _files(path: str) -> list[tuple[fs.FileSystem, str]]:
    """The workbook of a path, or all in its folder, in order of names."""
    store, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(store, place)]
    return [(store, f.path) for f in sorted(store.get_file_info(fs.FileSelector(place)), key=lambda f: f.path) if f.path.endswith(".xlsx")]


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Sheet]:
        sheets = []
        for store, place in _files(self.path):
            with store.open_input_file(place) as file, zipfile.ZipFile(file) as book:
                sheets += [Sheet(self.path, place, name, part) for name, part in sheet_parts(book)]
        return sheets

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        store = _files(partition.path)[0][0]
        with store.open_input_file(partition.file) as file, zipfile.ZipFile(file) as book:
            names = set(book.namelist())
            if "xl/sharedStrings.xml" in names:
                with book.open("xl/sharedStrings.xml") as part:
                    shared = SharedStrings(part)
            else:
                shared = SharedStrings(None)
            held: list[tuple[int, list[str]]] = []
            with book.open(partition.part) as part:
                for row in sheet_rows(part, shared):
                    held.append(row)
                    if len(held) == BATCH_ROWS:
                        yield self._batch(partition, held)
                        held = []
            if held:
                yield self._batch(partition, held)

    @staticmethod
    def _batch(sheet: Sheet, rows: list[tuple[int, list[str]]]) -> pa.RecordBatch:
        numbers, cells = zip(*rows, strict=True)
        file, name = [posixpath.basename(sheet.file)] * len(rows), [sheet.name] * len(rows)
        return pa.RecordBatch.from_arrays([pa.array(file), pa.array(name), pa.array(numbers, pa.int32()), pa.array(cells, pa.list_(pa.string()))], names=["file", "sheet", "row", "cells"])


class WorkbookSource(DataSource):
    """`spark.read.format("workbook").load(path)`: a workbook or a folder of them, local or in a store that pyarrow reads."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options["path"])


def workbook_sheets(spark: SparkSession, path: str) -> DataFrame:
    """file, sheet, row, cells of all sheets of XLSX files, a task a sheet. A folder without workbooks gives an empty table."""
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").load(path)


# Writing, for tables that go out as workbooks.


def write_workbooks(rows: DataFrame, folder: str, sheet_rows_most: int = 50_000) -> DataFrame:
    """Writes each partition as a workbook of sheets of at most so many rows, headers first, and returns file, sheets, rows.

    A partition's rows are written as they come; text is written inline. The files are there once the result is read.
    """
    columns = rows.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, place = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(place, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}.xlsx"
        total, sheets, out = 0, 0, None
        with store.open_output_stream(f"{place}/{name}") as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as book:
            for batch in batches:
                for record in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if total % sheet_rows_most == 0:
                        if out:
                            out.write(b"</sheetData></worksheet>")
                            out.close()
                        sheets += 1
                        out = book.open(f"xl/worksheets/sheet{sheets}.xml", "w", force_zip64=True)
                        out.write(f'<worksheet xmlns="{_MAIN}"><sheetData>'.encode() + _row(1, columns))
                    out.write(_row(2 + total % sheet_rows_most, record))
                    total += 1
            if out:
                out.write(b"</sheetData></worksheet>")
                out.close()
            listed = range(1, sheets + 1)
            tags = "".join(f'<sheet name="Sheet {k}" sheetId="{k}" r:id="r{k}"/>' for k in listed)
            book.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_LINK[1:-3]}"><sheets>{tags}</sheets></workbook>')
            tags = "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in listed)
            book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{tags}</Relationships>')
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sheets], pa.int32()), pa.array([total], pa.int64())], names=["file", "sheets", "rows"])

    return rows.mapInArrow(write, "file string, sheets int, rows long")


def _row(number: int, values: tuple | list) -> bytes:
    from xml.sax.saxutils import escape

    def cell(value: object) -> str:
        if value is None:
            return "<c/>"
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return f"<c><v>{value}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    return f'<row r="{number}">{"".join(map(cell, values))}</row>'.encode()
