"""Pages read with a stack of open elements: nested tables, text between tables, links with the elements they stand in.

A page is read once, start to end. Elements that pages leave open are closed by what can't stand inside them: a cell by the next
cell, row or the table's end, a list item by the next item. An end tag closes the nearest open element of its name, but never
reaches out of the table it stands in. Comments, scripts and styles hold no elements.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements without content; elements that end a line; what a start tag closes, and how far out it looks.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote caption dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
_PARTS = ("td", "th", "tr", "caption", "thead", "tbody", "tfoot", "colgroup")
CLOSES = {
    "td": ("td", "th", "caption"), "th": ("td", "th", "caption"), "tr": ("td", "th", "tr", "caption"), "caption": (), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"),
    "option": ("option",), **{part: _PARTS for part in ("thead", "tbody", "tfoot")}, **{block: ("p",) for block in BLOCKS - {"caption", "tr", "li", "dt", "dd"}},
}
SCOPES = {"li": ("ul", "ol", "table"), "dt": ("dl", "table"), "dd": ("dl", "table"), "option": ("select", "table")}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def clean(parts: list[str]) -> str:
    """Lines of text, white space collapsed, without empty ones."""
    lines = (" ".join(line.split()) for line in "".join(parts).split("\n"))
    return "\n".join(line for line in lines if line)


@dataclass
class Table:
    number: int
    parent: int | None
    heading: str | None
    caption: str | None = None
    rows: list[list[str]] = field(default_factory=list)

    def text(self) -> str:
        return "\n".join([*([self.caption] if self.caption else []), *[" ".join(c for c in row if c) for row in self.rows]])


class PageReader(HTMLParser):
    """Reads one page; tables in the order they begin, events in the order they stand, links with their open elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.holds: list[bool] = []  # whether the open element collects its text
        self.sinks: list[tuple[str, list[str]]] = [("page", [])]  # where text goes: the page, a cell, a caption, a heading, a link
        self.tables: list[Table] = []
        self.inside: list[Table] = []
        self.events: list[tuple[str, str, int | None]] = []
        self.links: list[tuple[str, str, str]] = []
        self.targets: list[tuple[str, str]] = []
        self.heading: str | None = None

    def read(self, html: str) -> PageReader:
        self.feed(html)
        self.close()
        while self.open:
            self._pop()
        self._flush()
        return self

    def _flush(self) -> None:
        text = clean(self.sinks[0][1])
        self.sinks[0][1].clear()
        if text:
            self.events.append(("text", text, None))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closed = CLOSES.get(tag, ())
        if closed:
            self._close(lambda name: name in closed, SCOPES.get(tag, ("table",)), every=tag in ("tr", "thead", "tbody", "tfoot"))
        if tag in BLOCKS or tag == "br":
            self.sinks[-1][1].append("\n")
        if tag in VOID:
            return
        holds = False
        if tag == "table":
            if not self.inside:
                self._flush()
            table = Table(len(self.tables), self.inside[-1].number if self.inside else None, self.heading)
            self.tables.append(table)
            self.inside.append(table)
        elif tag in ("tr", "td", "th", "caption") and (not self.inside or "table" not in self.open):
            return  # parts of no table
        elif tag == "tr":
            self.inside[-1].rows.append([])
        elif tag in ("td", "th"):
            if not self.inside[-1].rows or "tr" not in self._of_table():
                self.open.append("tr")
                self.holds.append(False)
                self.inside[-1].rows.append([])
            holds = True
        elif tag == "caption" or tag in HEADINGS and not self.inside:
            holds = True
        elif tag == "a" and (href := dict(attrs).get("href")):
            self.targets.append((href, "/".join(self.open)))
            holds = True
        if holds:
            self.sinks.append((tag, []))
        self.open.append(tag)
        self.holds.append(holds)

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID:
            self._close(lambda name: name == tag, () if tag == "table" else ("table",))

    def handle_data(self, data: str) -> None:
        if not self.open or self.open[-1] not in ("script", "style"):
            self.sinks[-1][1].append(data)

    def _of_table(self) -> list[str]:
        """Open elements inside the innermost table."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k] == "table":
                return self.open[k + 1 :]
        return []

    def _close(self, wanted: Callable[[str], bool], barriers: tuple[str, ...], every: bool = False) -> None:
        """Closes out to the nearest wanted element, or the farthest, that no barrier hides."""
        found = None
        for k in range(len(self.open) - 1, -1, -1):
            if wanted(self.open[k]):
                found = k
                if not every:
                    break
            if self.open[k] in barriers:
                break
        while found is not None and len(self.open) > found:
            self._pop()

    def _pop(self) -> None:
        tag = self.open.pop()
        if self.holds.pop():
            _, parts = self.sinks.pop()
            if tag in ("td", "th"):
                self.inside[-1].rows[-1].append(clean(parts))
            elif tag == "caption":
                self.inside[-1].caption = clean(parts)
            else:
                if tag == "a":
                    href, path = self.targets.pop()
                    self.links.append((href, clean(parts), path))
                else:
                    self.heading = clean(parts)
                self.sinks[-1][1].extend(parts)
        elif tag == "table":
            table = self.inside.pop()
            if self.inside:
                self.sinks[-1][1].append(f"\n{table.text()}\n")
            else:
                self._flush()
                self.events.append(("table", table.text(), table.number))
        if tag in BLOCKS:
            self.sinks[-1][1].append("\n")


def _read(html: str | None) -> PageReader:
    return PageReader().read(html or "")


_ARROW = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def _rows(pages: DataFrame, key: str, html: str, schema: dict[str, str], rows_of: Callable[[PageReader], list[tuple]]) -> DataFrame:
    """key and what each page's reader gives, page by page inside the tasks; no shuffle. A null page is empty."""
    given = pages.select(F.col(key).alias("k"), F.col(html).cast("string").alias("h"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, whose = [], []
            for k, page in enumerate(batch.column(1).to_pylist()):
                own = rows_of(_read(page))
                found += own
                whose += [k] * len(own)
            values = list(zip(*found, strict=True)) or [[] for _ in schema]
            made = [pa.array(v, _ARROW[kind]) for v, kind in zip(values, schema.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(whose, pa.int64())), *made], names=["k", *schema])

    whole = {"k": given.schema["k"].dataType.simpleString(), **schema}
    return given.mapInArrow(read, ", ".join(f"`{name}` {kind}" for name, kind in whole.items())).withColumnRenamed("k", key)


def html_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, table, caption, row, cells, parent, heading: all tables of each page in the order they begin, headers as row 0.

    A table inside a cell is a table of its own, whose parent is the outer one's number; its text is in the outer cell too. heading
    is the last heading before the table (W13). Rows without cells and tables without rows give none.
    """

    def rows(page: PageReader) -> list[tuple]:
        return [(t.number, t.caption or "", k, row, t.parent, t.heading) for t in page.tables for k, row in enumerate(r for r in t.rows if r)]

    return _rows(pages, key, html, {"table": "int", "caption": "string", "row": "int", "cells": "array<string>", "parent": "int", "heading": "string"}, rows)


def page_events(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, at, kind, text, table: the text and the outermost tables of a page in the order they stand."""
    return _rows(pages, key, html, {"at": "int", "kind": "string", "text": "string", "table": "int"}, lambda page: [(k, *event) for k, event in enumerate(page.events) if event[1]])


def page_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, at, href, text, path: links in the order they end, with the elements that are open around them, outermost first."""
    return _rows(pages, key, html, {"at": "int", "href": "string", "text": "string", "path": "string"}, lambda page: [(k, *link) for k, link in enumerate(page.links)])


def mail(html: Column, cap: int = 3000) -> Column:
    """A mail's text, a line for each block and at most `cap` characters, and its links."""

    @F.pandas_udf("text string, links array<string>")
    def read(pages: pd.Series) -> pd.DataFrame:
        found = [_read(page) for page in pages]
        texts = ["\n".join(text for _, text, _ in page.events)[:cap] for page in found]
        return pd.DataFrame({"text": texts, "links": [[href for href, _, _ in page.links] for page in found]})

    return read(html)
