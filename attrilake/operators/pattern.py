"""Patterns on keys and values, and the queries that pair them.

A query is ``key`` or ``key=value``; only the first '=' splits. Either side is one of five kinds:
'*' alone is a wildcard, '*t*' an infix, 't*' a prefix, '*t' a suffix, anything else exact. A star
within the token is an ordinary character, except in prefixes of the trie mode, where it stands
for any one character.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Kind(Enum):
    EXACT = "exact"
    PREFIX = "prefix"
    SUFFIX = "suffix"
    INFIX = "infix"
    WILDCARD = "wildcard"


class Mode(Enum):
    """SCAN judges each pair by itself. TRIE answers as an index of value suffixes does."""

    SCAN = "scan"
    TRIE = "trie"


@dataclass(frozen=True)
class Pattern:
    kind: Kind
    token: str = ""

    @staticmethod
    def parse(text: str, mode: Mode = Mode.SCAN) -> Pattern:
        if text == "*":
            return Pattern(Kind.WILDCARD)
        starts, ends = text.startswith("*"), text.endswith("*")
        if starts and ends and len(text) > 2:
            return Pattern(Kind.INFIX, text[1:-1])
        if starts and ends:  # "**": one star is the token
            return Pattern(Kind.SUFFIX if mode is Mode.TRIE else Kind.PREFIX, "*")
        if ends:
            return Pattern(Kind.PREFIX, text[:-1])
        if starts:
            return Pattern(Kind.SUFFIX, text[1:])
        return Pattern(Kind.EXACT, text)

    def __str__(self) -> str:
        t = self.token
        return {Kind.EXACT: t, Kind.PREFIX: f"{t}*", Kind.SUFFIX: f"*{t}", Kind.INFIX: f"*{t}*", Kind.WILDCARD: "*"}[self.kind]

    def test(self, text: str) -> bool:
        """The same on a Python string: key patterns meet column names when a plan is made."""
        t = self.token
        return {
            Kind.EXACT: lambda: text == t,
            Kind.PREFIX: lambda: text.startswith(t),
            Kind.SUFFIX: lambda: text.endswith(t),
            Kind.INFIX: lambda: t in text,
            Kind.WILDCARD: lambda: True,
        }[self.kind]()

    def on(self, column: Column, suffix_mode: bool = True) -> Column | None:
        """The predicate on a string column; None where every value fits, so that no filter is planned.

        Without ``suffix_mode`` suffixes and infixes find nothing.
        """
        t = self.token
        if self.kind is Kind.WILDCARD:
            return None
        if self.kind in (Kind.SUFFIX, Kind.INFIX) and not suffix_mode:
            return F.lit(False)
        return {
            Kind.EXACT: lambda: column == F.lit(t),
            Kind.PREFIX: lambda: column.startswith(t),
            Kind.SUFFIX: lambda: column.endswith(t),
            Kind.INFIX: lambda: column.contains(t),
        }[self.kind]()

    def on_trie(self, column: Column) -> Column | None:
        """What an index of all suffixes gives for exact and prefix tokens: they fit at any suffix's start."""
        if self.kind is Kind.EXACT:
            return column.endswith(self.token) if self.token else column == F.lit("")
        if self.kind is Kind.PREFIX:
            if "*" in self.token:
                return column.rlike(one_character_stars(self.token))
            return column.contains(self.token)
        return self.on(column)


def one_character_stars(token: str) -> str:
    """A regular expression in which each star of the token stands for any one character."""
    return "(?s)" + ".".join(re.escape(part) for part in token.split("*"))


@dataclass(frozen=True)
class Query:
    key: Pattern
    value: Pattern

    @staticmethod
    def parse(text: str, mode: Mode = Mode.SCAN) -> Query:
        key, split, value = text.partition("=")
        return Query(Pattern.parse(key, mode), Pattern.parse(value if split else "*", mode))

    def __str__(self) -> str:
        return f"{self.key}={self.value}"
