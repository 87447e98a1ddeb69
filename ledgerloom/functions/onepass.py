"""Many word lists in one pass over a text.

All terms of all lists are one automaton, so a text is read once, however many terms there are. A term stands at word edges unless it
is written with `*` at an end: "fee*" is the beginning of a word, "*berg" an end, "*ix*" anything. Letters, digits and `_` make words;
case does not matter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a list's column holds: occurrences that don't overlap, the leftmost and of those the longest first; labels found, in listed order.
FOUND = "struct<n:int,labels:array<string>>"


def small(text: str) -> str:
    """Lower case in which every character keeps its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def _wordy(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


@dataclass
class Lexicons:
    """Named lists of (label, term), or of terms that are their own labels, in the order that matters to the first label."""

    lists: dict[str, list]
    _machine: ahocorasick.Automaton | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        self.entries: list[tuple[int, int, bool, bool, int]] = []  # list, place in it, edge before, edge behind, length
        self.names = list(self.lists)
        self.labels: list[list[str]] = []
        by_term: dict[str, list[int]] = {}
        for number, own in enumerate(self.lists.values()):
            pairs = [(t, t) if isinstance(t, str) else tuple(t) for t in own]
            order = list(dict.fromkeys(label for label, _ in pairs))
            self.labels.append(order)
            for label, term in pairs:
                core = small(term.strip("*"))
                if not core:
                    raise ValueError(f"an empty term in {self.names[number]}")
                by_term.setdefault(core, []).append(len(self.entries))
                self.entries.append((number, order.index(label), not term.startswith("*"), not term.endswith("*"), len(core)))
        self.by_term = by_term

    def _automaton(self) -> ahocorasick.Automaton:
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for term, own in self.by_term.items():
                self._machine.add_word(term, own)
            self._machine.make_automaton()
        return self._machine

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machine": None}  # tasks build their own

    def hits(self, text: str) -> list[list[tuple[int, int, int]]]:
        """By list: start, end and label of each occurrence, overlaps included, in order of starts, the longest first."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in self.names]
        if self.entries and text:
            low = small(text)
            for last, own in self._automaton().iter(low):
                for k in own:
                    number, label, before, behind, length = self.entries[k]
                    start, end = last + 1 - length, last + 1
                    if (before and _wordy(low, start - 1) and _wordy(low, start)) or (behind and _wordy(low, end) and _wordy(low, end - 1)):
                        continue
                    found[number].append((start, end, label))
        for own in found:
            own.sort(key=lambda h: (h[0], -h[1], h[2]))
        return found

    def tally(self, text: str | None) -> list[tuple[int, list[str]]]:
        """By list: how many occurrences stand side by side, and the labels."""
        out = []
        for number, own in enumerate(self.hits(text or "")):
            n, free = 0, 0
            for start, end, _ in own:
                if start >= free:
                    n, free = n + 1, end
            labels = self.labels[number]
            out.append((n, [labels[k] for k in sorted({h[2] for h in own})]))
        return out


def scan(text: Column, lexicons: Lexicons) -> Column:
    """A struct with a column of FOUND for each list; a null text is empty."""

    @F.pandas_udf(", ".join(f"`{name}` {FOUND}" for name in lexicons.names))
    def read(texts: pd.Series) -> pd.DataFrame:
        tallies = [lexicons.tally(t) for t in texts]
        return pd.DataFrame({name: [{"n": t[k][0], "labels": t[k][1]} for t in tallies] for k, name in enumerate(lexicons.names)})

    return read(text)


# Rules over what a scan found.


def first_label(found: Column) -> Column:
    """The first listed label that occurs, null without one."""
    return F.get(found["labels"], F.lit(0))


def flag(found: Column) -> Column:
    """Whether the list occurs (P5)."""
    return found["n"] > 0


def one_category(found: Column, generic: Column) -> Column:
    """The one label of a list of categories, cross-cutting for several or for generic text alone, else null."""
    several = F.size(found["labels"]) > 1
    return F.when(F.size(found["labels"]) == 1, first_label(found)).when(several | generic, "cross-cutting")


def topic(found: Column, default: str = "policy") -> Column:
    """The first listed topic, or the default."""
    return F.coalesce(first_label(found), F.lit(default))


def importance(boost: Column, high: Column, medium: Column) -> Column:
    """high for a boosted rule or a high term, medium for a medium term, else low."""
    return F.when(boost | flag(high), "high").when(flag(medium), "medium").otherwise("low")


def taxonomy(found: Column, order: list[str], defaults: Column | None = None, needs: dict[str, Column] | None = None, nothing: str = "general") -> Column:
    """All labels of defaults and keywords in the taxonomy's order, or `nothing` (D15, U4). needs: a label, as of a place, that counts only
    where its condition, as of a word of the domain, holds too."""
    held = F.array_union(F.coalesce(defaults, F.array().cast("array<string>")) if defaults is not None else F.array().cast("array<string>"), found["labels"])
    kept = F.array_compact(F.array(*[F.when(F.array_contains(held, name) & (needs or {}).get(name, F.lit(True)), name) for name in order]))
    return F.when(F.size(kept) == 0, F.array(F.lit(nothing))).otherwise(kept)
