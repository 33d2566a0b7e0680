"""Scalar functions on strings that are numbers, globs, dates and expressions."""

from __future__ import annotations

import re

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number. Hexadecimal, infinite and not-a-number spellings, and any blank, don't.
NUMBER = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)\z"
_NUMBER = re.compile(NUMBER.replace(r"\z", r"\Z"), re.ASCII)

#: Date formats, the shape of each, and where year, month and day stand (from 1).
DATE_FORMATS = {
    "YYYY-MM-DD": (r"^\d{4}-\d{2}-\d{2}\z", (1, 6, 9), "yyyy-MM-dd"),
    "MM/DD/YYYY": (r"^\d{2}/\d{2}/\d{4}\z", (7, 1, 4), "MM/dd/yyyy"),
    "DD-MM-YYYY": (r"^\d{2}-\d{2}-\d{4}\z", (7, 4, 1), "dd-MM-yyyy"),
}


def is_number(text: str) -> bool:
    return bool(_NUMBER.match(text))


def to_number(text: str) -> float:
    """The number, 0 where the text is none."""
    return float(text) if is_number(text) else 0.0


def number(column: Column) -> Column:
    """The number that a string is, null where it is none."""
    return F.when(column.rlike(NUMBER), column.try_cast("double"))


def has_wildcard(text: str) -> bool:
    return "*" in text or "?" in text


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression over the whole string: '*' is any run, '?' any one character."""
    return "(?s)\\A" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "\\z"


def matches_glob(text: str, pattern: str) -> bool:
    return bool(re.match(glob_regex(pattern).replace(r"\z", r"\Z"), text))


def whole_regex(pattern: str) -> str | None:
    """The expression as a match of the whole string; None if it can't be compiled.

    The engine that will run it judges it, once, when the plan is made.
    """
    whole = f"\\A(?:{pattern})\\z"
    context = SparkContext._active_spark_context
    if context is None:
        raise RuntimeError("a regular expression needs a Spark session")
    try:
        context._jvm.java.util.regex.Pattern.compile(pattern)
        context._jvm.java.util.regex.Pattern.compile(whole)
    except IllegalArgumentException:
        return None
    return whole


def as_date(column: Column, form: str = "YYYY-MM-DD") -> Column:
    """The date that a string is in this format, months and days beyond their range carried over.

    Null for other strings and for unknown formats.
    """
    if form not in DATE_FORMATS:
        return F.lit(None).cast("date")
    shape, (y, m, d), _ = DATE_FORMATS[form]
    year, month, day = (F.substring(column, at, n).try_cast("int") for at, n in ((y, 4), (m, 2), (d, 2)))
    return F.when(column.rlike(shape), F.date_add(F.add_months(F.make_date(F.greatest(year, F.lit(1)), F.lit(1), F.lit(1)), month - 1), day - 1))


def as_days(column: Column, form: str = "YYYY-MM-DD") -> Column:
    """Days since 1970-01-01."""
    return F.datediff(as_date(column, form), F.lit("1970-01-01").cast("date"))


def format_days(days: Column, form: str = "YYYY-MM-DD") -> Column:
    """The date so many days after 1970-01-01, in this format; null for unknown formats."""
    if form not in DATE_FORMATS:
        return F.lit(None).cast("string")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")), DATE_FORMATS[form][2])
