"""Predicates on columns of any type, which compare natively wherever text has an order of its own.

Triples hold text. A table's numbers, dates and timestamps need no detour through it: a condition on
such a column is an ordinary comparison, which reaches the scan. Where a pattern speaks of
characters (suffixes, infixes, globs, regular expressions) the column is seen as ``text_of`` gives it.
"""

from __future__ import annotations

import datetime
from decimal import Decimal
from math import ceil, floor

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attrilake.functions.text import as_date, has_wildcard, is_number
from attrilake.operators.conditions import COMPARE, Condition
from attrilake.operators.pattern import Kind, Pattern
from attrilake.operators.ranges import RangeQuery

#: Bits of the integer types.
INTEGERS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
FRACTIONS = (T.FloatType, T.DoubleType, T.DecimalType)
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def text_of(column: Column, kind: T.DataType, digits: int | None = None) -> Column:
    """A cell as the string that patterns see; nothing is lost unless ``digits`` asks for rounding.

    Timestamps at midnight are written as their date.
    """
    if isinstance(kind, T.StringType):
        return column
    if isinstance(kind, FRACTIONS) and digits is not None:
        return F.format_string(f"%.{digits}f", F.round(column.cast("double"), digits))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.when(column == F.date_trunc("day", column), F.date_format(column, "yyyy-MM-dd")).otherwise(column.cast("string"))
    return column.cast("string")


def moment(text: str) -> str | None:
    """A date, or a date and time, as ISO text that is ordered as time is; None for any other string."""
    try:
        return text if len(text) >= 10 and text[4] == "-" and text[10:11] in ("", " ", "T") and datetime.datetime.fromisoformat(text).tzinfo is None else None
    except ValueError:
        return None


def as_kind(text: str, kind: T.DataType) -> Column:
    return F.lit(text).cast(kind)


def days_with(prefix: str) -> tuple[str, str] | None:
    """The first day whose ISO date starts with ``prefix`` and the day after the last; they are neighbours."""
    if not (4 <= len(prefix) <= 10 and prefix[:4].isdecimal() and prefix[:4].isascii() and 1 <= int(prefix[:4]) < 9999):
        return None
    first = datetime.date(int(prefix[:4]), 1, 1)
    found = [d for d in (first + datetime.timedelta(i) for i in range(366)) if d.isoformat().startswith(prefix)]
    return (found[0].isoformat(), (found[-1] + datetime.timedelta(1)).isoformat()) if found else ("9999-12-31", "0001-01-01")


def on_integer(column: Column, bits: int, op: str, value: Decimal) -> Column:
    """The comparison with a bound that is an integer of the column's own type."""
    bound = floor(value) if op in (">", "<=") else ceil(value)
    least, most = -(1 << bits - 1), (1 << bits - 1) - 1
    if bound < least or bound > most:
        return column.isNotNull() if (bound < least) == (op in (">", ">=")) else F.lit(False)
    return COMPARE[op](column, F.lit(bound).cast({8: "tinyint", 16: "smallint", 32: "int", 64: "long"}[bits]))


def on_pattern(column: Column, kind: T.DataType, pattern: Pattern, suffix_mode: bool = True, digits: int | None = None) -> Column:
    """The predicate of a value pattern."""
    token = pattern.token
    if pattern.kind is Kind.WILDCARD:
        return column.isNotNull()
    if pattern.kind is Kind.EXACT and type(kind) in INTEGERS:
        number = int(token) if token.removeprefix("-").isdecimal() and token.isascii() and len(token) < 21 else None
        if number is None or str(number) != token or not -(1 << 63) <= number < 1 << 63:
            return F.lit(False)
        return column == F.lit(number)
    if pattern.kind is Kind.EXACT and isinstance(kind, FRACTIONS) and is_number(token) and digits is None:
        return equal_number(column, kind, token)
    if pattern.kind is Kind.EXACT and isinstance(kind, TIMES) and moment(token):
        return column == as_kind(token, kind)
    if pattern.kind is Kind.PREFIX and isinstance(kind, TIMES) and (days := days_with(token)):
        return (column >= as_kind(days[0], kind)) & (column < as_kind(days[1], kind))
    return pattern.on(text_of(column, kind, digits), suffix_mode)


def equal_number(column: Column, kind: T.DataType, token: str) -> Column:
    return column == (F.lit(Decimal(token)) if isinstance(kind, T.DecimalType) and len(Decimal(token).as_tuple().digits) < 30 else F.lit(float(token)))


def on_condition(column: Column, kind: T.DataType, c: Condition, digits: int | None = None) -> Column:
    """The predicate of a condition's operator and value."""
    if c.op in COMPARE:
        if type(kind) in INTEGERS and is_number(c.value):
            return on_integer(column, INTEGERS[type(kind)], c.op, Decimal(c.value))
        if isinstance(kind, FRACTIONS) and is_number(c.value):
            return COMPARE[c.op](column, F.lit(float(c.value)))
        if isinstance(kind, TIMES) and moment(c.value):
            if isinstance(kind, T.DateType) and len(c.value) > 10:  # a day is before any of its times
                return COMPARE[c.op](column.cast("timestamp_ntz"), as_kind(c.value, T.TimestampNTZType()))
            return COMPARE[c.op](column, as_kind(c.value, kind))
    elif c.op in ("=", "!=") and not has_wildcard(c.value):
        equal = on_pattern(column, kind, Pattern(Kind.EXACT, c.value), digits=digits)
        return equal if c.op == "=" else column.isNotNull() & ~equal
    return c.on_value(text_of(column, kind, digits))


def on_range(column: Column, kind: T.DataType, q: RangeQuery) -> Column:
    """The predicate of a range; days count whole, so a timestamp is in if its day is."""
    if q.is_date:
        low, high = (as_date(F.lit(x), q.form) for x in (q.low, q.high))
        if isinstance(kind, T.DateType):
            return column.between(low, high)
        if isinstance(kind, TIMES):
            return (column >= low.cast(kind)) & (column < F.date_add(high, 1).cast(kind))
        return q.on_value(column) if isinstance(kind, T.StringType) else F.lit(False)
    if type(kind) in INTEGERS:
        bits = INTEGERS[type(kind)]
        return on_integer(column, bits, ">=", Decimal(q.low)) & on_integer(column, bits, "<=", Decimal(q.high))
    if isinstance(kind, FRACTIONS):
        return column.between(F.lit(float(q.low)), F.lit(float(q.high)))
    return q.on_value(column) if isinstance(kind, T.StringType) else F.lit(False)
