"""Ranges of numbers and dates, both ends included."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from attrilake.functions.text import DATE_FORMATS, as_date, glob_regex, has_wildcard, is_number, number, to_number
from attrilake.operators.conditions import Condition, MultiQuery

_TEXT = re.compile(r"(.+)\s+in\s+range\s+\[(.+)\s+to\s+(.+)\]", re.S)


@dataclass(frozen=True)
class RangeQuery:
    key: str
    low: str
    high: str
    form: str | None = None  # a date format; None for numbers

    @staticmethod
    def numbers(key: str, low: float, high: float) -> RangeQuery:
        return RangeQuery(key, repr(float(low)), repr(float(high)))

    @staticmethod
    def dates(key: str, low: str, high: str, form: str = "YYYY-MM-DD") -> RangeQuery:
        return RangeQuery(key, low, high, form or "YYYY-MM-DD")

    @staticmethod
    def parse(text: str) -> RangeQuery:
        """``key in range [low to high]``; ends that are no numbers and hold '-' or '/' are dates."""
        m = _TEXT.fullmatch(text)
        if not m:
            raise ValueError(f"no range in {text!r}")
        key, low, high = (x.strip(" \t") for x in m.groups())
        if not is_number(low) and ("-" in low or "/" in low):
            form = next((f for f, (shape, _, _) in DATE_FORMATS.items() if re.match(shape.replace(r"\z", r"\Z"), low)), "YYYY-MM-DD")
            return RangeQuery.dates(key, low, high, form)
        return RangeQuery.numbers(key, to_number(low), to_number(high))

    def __str__(self) -> str:
        return f"{self.key} in range [{self.low} to {self.high}]"

    @property
    def is_date(self) -> bool:
        return self.form is not None

    def key_fits(self, key: str) -> bool:
        return Condition(self.key, "=", "").key_fits(key)

    def on_key(self, column: Column) -> Column:
        return column.rlike(glob_regex(self.key)) if has_wildcard(self.key) else column == F.lit(self.key)

    def on_value(self, column: Column) -> Column:
        """The predicate on a string column; what is no number, or no date of the format, is out."""
        if self.form is None:
            return number(column).between(float(self.low), float(self.high))
        return as_date(column, self.form).between(as_date(F.lit(self.low), self.form), as_date(F.lit(self.high), self.form))

    def to_conditions(self) -> MultiQuery:
        """``key >= low AND key <= high``: not the same, as different pairs may meet the two."""
        return MultiQuery().add(Condition(self.key, ">=", self.low)).add(Condition(self.key, "<=", self.high))
