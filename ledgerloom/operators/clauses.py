"""Clauses in the first person, read word by word (D1), as a table function that joins laterally.

What counts as an adverb, a negation or a doubt differs from corpus to corpus, so the words are a parameter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A clause's adverbs before the verb, words of its object, words kept of that, and words of its left context, at most.
ADVERBS, OBJECT, HEAD, LEFT = 2, 7, 4, 12
CLAUSE = "verb string, object string, caps boolean, negated boolean, scope string, begin int, start int, end int"
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class ClauseWords:
    """Lists of lower-case words and phrases. negators stand before the verb, doubts to the left of the clause; partial and full
    say what an object covers; determiners begin objects and don't count; standards begin objects that only quote a rule."""

    adverbs: tuple[str, ...] = ()
    negators: tuple[str, ...] = ()
    doubts: tuple[str, ...] = ()
    partial: tuple[str, ...] = ()
    full: tuple[str, ...] = ()
    determiners: tuple[str, ...] = ()
    standards: tuple[str, ...] = ()


class ClauseReader:
    """Reads the clauses of texts by the given words."""

    def __init__(self, words: ClauseWords) -> None:
        split = lambda phrases: sorted((tuple(p.split()) for p in phrases), key=len, reverse=True)
        self.adverbs, self.determiners = frozenset(words.adverbs), frozenset(words.determiners)
        self.negators, self.doubts, self.partial, self.full, self.standards = map(split, (words.negators, words.doubts, words.partial, words.full, words.standards))

    @staticmethod
    def _at(words: list[str], k: int, phrases: list[tuple[str, ...]]) -> int:
        """Length of the longest phrase that begins at word k, 0 if none does."""
        return next((len(p) for p in phrases if tuple(words[k : k + len(p)]) == p), 0)

    def _holds(self, words: list[str], phrases: list[tuple[str, ...]]) -> bool:
        return any(self._at(words, k, phrases) for k in range(len(words)))

    def read(self, text: str) -> Iterator[tuple]:
        """verb, object, caps, negated, scope, begin of the left context, start and end of the verb, of each clause with an object.

        Words of a clause stand with nothing but white space between them; to its left commas and semicolons may stand too,
        up to the end of the clause before.
        """
        found = list(_WORD.finditer(text))
        words = [m[0].lower() for m in found]
        gap = lambda k: text[found[k].end() : found[k + 1].start()]
        k, floor = 0, 0
        while k < len(found):
            if words[k] != "we":
                k += 1
                continue
            last = k  # the clause's words reach as far as white space does, and no farther than it could need
            while last + 1 < len(found) and last < k + ADVERBS + 4 + OBJECT and gap(last).isspace():
                last += 1
            own, at = words[: last + 1], k + 1
            adverbs = 0
            while at <= last and adverbs < ADVERBS and own[at] in self.adverbs:
                at, adverbs = at + 1, adverbs + 1
            negator = self._at(own, at, self.negators) if at <= last else 0
            at += negator
            if at > last or not own[at].isalpha():
                k += 1
                continue
            end = min(last, at + OBJECT)
            head = own[at + 1 : end + 1]
            if head and head[0] in self.determiners:
                head = head[1:]
            left = k
            while left > floor and k - left < LEFT and not gap(left - 1).strip(" \t\r\n,;"):
                left -= 1
            floor, begin, verb = end + 1, left, found[at]
            if head and not self._at(head, 0, self.standards):
                head = head[:HEAD]
                negated = negator > 0 or self._holds(words[left:k], self.doubts)
                scope = "partial" if self._holds(head, self.partial) else "full" if self._holds(head, self.full) else "unknown"
                yield own[at], " ".join(head), verb[0].isupper(), negated, scope, found[begin].start(), verb.start(), verb.end()
            k = end + 1


def clause_function(words: ClauseWords):
    """The table function of a text's clauses, with the columns of CLAUSE; texts of null and without clauses give no row."""
    reader = ClauseReader(words)

    class Clauses:
        def eval(self, text: str) -> Iterator[tuple]:
            if text:
                yield from reader.read(text)

    return F.udtf(Clauses, returnType=CLAUSE, useArrow=True)


def clauses(docs: DataFrame, words: ClauseWords, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and one row a clause (D1). Match offsets need Python; texts without a first person never reach it."""
    asked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").rlike(r"(?i)\bwe\s"))
    return asked.lateralJoin(clause_function(words)(F.col("text").outer())).drop("text")


def clause_place(begin: Column, length: Column) -> Column:
    """Where in its text a clause begins, from 0 to 1."""
    return begin / F.greatest(length, F.lit(1))
