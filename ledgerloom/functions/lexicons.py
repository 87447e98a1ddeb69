"""Ordered pattern lists as data, and the column expressions built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(text: Column, patterns: list[tuple[str, str]], tail: int | None = None, evidence: int = 140) -> Column:
    """label and evidence of the first pattern that matches.

    With `tail`, each pattern is tried on the last `tail` characters, then on the whole text, before the next pattern is:
    the order of patterns is the rule (traps B1, B2).
    """
    found = []
    for label, pattern in patterns:
        for part in ([F.substring(text, -tail, tail)] if tail else []) + [text]:
            match = F.regexp_extract(part, pattern, 0)
            found.append(F.when(match != "", F.struct(F.lit(label).alias("label"), F.substring(match, 1, evidence).alias("evidence"))))
    return F.coalesce(*found)


def any_match(text: Column, pattern: str) -> Column:
    """Whether the pattern occurs; false for a null text (P5)."""
    return F.coalesce(text.rlike(pattern), F.lit(False))


def count_matches(text: Column, pattern: str) -> Column:
    """Occurrences of the pattern; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def labels(tests: dict[str, Column], default: str) -> Column:
    """All labels whose test holds, in listed order, or the default."""
    found = F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))
    return F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found)


def category(specific: dict[str, Column], generic: Column) -> Column:
    """The one specific category, cross-cutting for several or for generic text alone, else null: out of scope (D11, RC15)."""
    hits = sum((F.coalesce(test, F.lit(False)).cast("int") for test in specific.values()), F.lit(0))
    only = F.coalesce(*[F.when(test, name) for name, test in specific.items()])
    return F.when(hits == 1, only).when((hits > 1) | generic, "cross-cutting")
