"""Conditions on an object's attributes, joined by AND and OR.

A condition holds for an object if any of its pairs fulfils it, so two conditions may be fulfilled
by different pairs. Whatever their number, conditions over long data take one aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from attrilake.functions.text import glob_regex, has_wildcard, is_number, matches_glob, number, whole_regex

#: Operators in the order in which a condition's text is searched for them.
OPERATORS = (">=", "<=", "!=", "~=", "contains", "startsWith", "endsWith", ">", "<", "=")
COMPARE = {">": Column.__gt__, "<": Column.__lt__, ">=": Column.__ge__, "<=": Column.__le__}


@dataclass(frozen=True)
class Condition:
    key: str
    op: str
    value: str

    def __post_init__(self):
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator {self.op!r}")

    @staticmethod
    def parse(text: str) -> Condition:
        for op in OPERATORS:
            key, found, value = text.partition(op)
            if found:
                return Condition(key.strip(" \t"), op, value.strip(" \t"))
        raise ValueError(f"no operator in {text!r}")

    def __str__(self) -> str:
        return f"{self.key} {self.op} {self.value}"

    def key_fits(self, key: str) -> bool:
        return matches_glob(key, self.key) if has_wildcard(self.key) else key == self.key

    def on_key(self, column: Column) -> Column:
        return column.rlike(glob_regex(self.key)) if has_wildcard(self.key) else column == F.lit(self.key)

    def on_value(self, column: Column) -> Column:
        """The predicate on a string column; null values fulfil nothing."""
        v = F.lit(self.value)
        if self.op in ("=", "!="):
            equal = column.rlike(glob_regex(self.value)) if has_wildcard(self.value) else column == v
            return equal if self.op == "=" else ~equal
        if self.op in COMPARE:
            # numbers compare as numbers, all else as strings, row by row
            compare = COMPARE[self.op]
            as_text = compare(column, v)
            if not is_number(self.value):
                return as_text
            here = number(column)
            return F.when(here.isNotNull(), compare(here, F.lit(float(self.value)))).otherwise(as_text)
        if self.op == "contains":
            return column.contains(self.value)
        if self.op == "startsWith":
            return column.startswith(self.value)
        if self.op == "endsWith":
            return column.endswith(self.value)
        pattern = whole_regex(self.value)
        return F.lit(False) if pattern is None else column.rlike(pattern)


@dataclass
class MultiQuery:
    """Conditions and the operators between them; no condition at all matches every object."""

    conditions: list[Condition] = field(default_factory=list)
    operators: list[str] = field(default_factory=list)

    def add(self, condition: Condition | str, operator: str = "AND") -> MultiQuery:
        """Append a condition; the operator before the first has no meaning."""
        if operator not in ("AND", "OR"):
            raise ValueError(f"unknown operator {operator!r}")
        if self.conditions:
            self.operators.append(operator)
        self.conditions.append(Condition.parse(condition) if isinstance(condition, str) else condition)
        return self

    @staticmethod
    def parse(text: str) -> MultiQuery:
        query, rest, operator = MultiQuery(), text, "AND"
        while True:
            cuts = [(at, op) for op in ("AND", "OR") if (at := rest.find(f" {op} ")) >= 0]
            if not cuts:
                return query.add(rest, operator)
            at, following = min(cuts)
            query.add(rest[:at], operator)
            rest, operator = rest[at + len(following) + 2 :], following

    def __str__(self) -> str:
        parts = [str(c) for c in self.conditions]
        return parts[0] + "".join(f" {op} {p}" for op, p in zip(self.operators, parts[1:], strict=True)) if parts else ""

    def needed(self, mode: str = "left") -> MultiQuery:
        """The part that decides: all of it, or in ``leading`` mode the first run of one operator.

        In that mode evaluation ends for good as soon as an AND fails or an OR holds, so whatever
        follows the first change of operator never counts.
        """
        if mode == "left" or not self.operators:
            return self
        if mode != "leading":
            raise ValueError(f"unknown mode {mode!r}")
        run = next((i for i, op in enumerate(self.operators) if op != self.operators[0]), len(self.operators))
        return MultiQuery(self.conditions[: run + 1], self.operators[:run])

    def combine(self, holds: list[Column]) -> Column:
        """A left fold of the conditions' outcomes."""
        if not holds:
            return F.lit(True)
        out = holds[0]
        for op, h in zip(self.operators, holds[1:], strict=True):
            out = out & h if op == "AND" else out | h
        return out


def any_of(predicates: list[Column]) -> Column:
    return reduce(Column.__or__, predicates) if predicates else F.lit(False)
