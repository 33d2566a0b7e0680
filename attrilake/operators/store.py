"""Attribute stores: the same searches over long and over wide data.

Long data are triples (object_id, key, value). Wide data are an ordinary table with an id column,
whose other columns are the keys; a null cell is an absent attribute. Over wide data key patterns
are resolved against the column names when the plan is made, so that only columns that can match
are read and their predicates reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from attrilake.operators.conditions import Condition, MultiQuery, any_of
from attrilake.operators.pattern import Kind, Mode, Pattern, Query
from attrilake.operators.ranges import RangeQuery
from attrilake.operators.typed import on_condition, on_pattern, on_range, text_of

ID, KEY, VALUE = "object_id", "key", "value"


def ids(df: DataFrame) -> DataFrame:
    """Distinct object ids in ascending order."""
    return df.select(ID).distinct().orderBy(ID)


class LongStore:
    """Triples; every method gives a lazy DataFrame."""

    def __init__(self, triples: DataFrame):
        self.triples = triples.select(F.col(ID).cast("long").alias(ID), KEY, VALUE)

    def _where(self, *predicates: Column | None) -> DataFrame:
        out = self.triples
        for p in predicates:
            if p is not None:
                out = out.filter(p)
        return out

    def matched_pairs(self, query: str | Query, suffix_mode: bool = True) -> DataFrame:
        """The pairs that fulfil both patterns."""
        q = Query.parse(query) if isinstance(query, str) else query
        return self._where(q.key.on(F.col(KEY), suffix_mode), q.value.on(F.col(VALUE), suffix_mode))

    def search(self, query: str | Query, suffix_mode: bool = True) -> DataFrame:
        return ids(self.matched_pairs(query, suffix_mode))

    def pairs_of(self, objects: DataFrame) -> DataFrame:
        """All pairs of the objects whose ids are given."""
        return self.triples.join(objects.select(ID).distinct(), ID, "left_semi")

    def multi(self, query: str | MultiQuery, mode: str = "left") -> DataFrame:
        """Objects that fulfil the conditions: one aggregation, over pairs that fulfil any of them."""
        q = (MultiQuery.parse(query) if isinstance(query, str) else query).needed(mode)
        if not q.conditions:
            return ids(self.triples)
        tests = [c.on_key(F.col(KEY)) & c.on_value(F.col(VALUE)) for c in q.conditions]
        names = [f"c{i}" for i in range(len(tests))]
        rows = self.triples.filter(any_of(tests)).select(ID, *(F.coalesce(t, F.lit(False)).alias(n) for t, n in zip(tests, names, strict=True)))
        held = rows.groupBy(ID).agg(*(F.bool_or(n).alias(n) for n in names))
        return held.filter(q.combine([F.col(n) for n in names])).select(ID).orderBy(ID)

    def in_range(self, query: str | RangeQuery) -> DataFrame:
        q = RangeQuery.parse(query) if isinstance(query, str) else query
        return ids(self._where(q.on_key(F.col(KEY)), q.on_value(F.col(VALUE))))

    def has_key(self, key: str) -> bool:
        return not self.triples.filter(F.col(KEY) == key).isEmpty()

    def has_suffix(self, suffix: str, suffix_mode: bool = True) -> bool:
        return suffix_mode and not self.triples.filter(F.col(KEY).endswith(suffix)).isEmpty()

    def can_handle(self, query: str) -> bool:
        """Whether any key fits the key part; it prunes work and never changes a result."""
        p = Query.parse(query).key.on(F.col(KEY))
        return not self._where(p).isEmpty()

    def insert(self, more: DataFrame) -> LongStore:
        return LongStore(self.triples.unionByName(more.select(F.col(ID).cast("long").alias(ID), KEY, VALUE)))

    def delete(self, gone: DataFrame) -> LongStore:
        """Without all pairs that equal one of ``gone``."""
        return LongStore(self.triples.join(gone.select(F.col(ID).cast("long").alias(ID), KEY, VALUE), [ID, KEY, VALUE], "left_anti"))

    def object_view(self) -> DataFrame:
        """object_id and its pairs, repeated ones kept, in order of key and value."""
        return self.triples.groupBy(ID).agg(F.array_sort(F.collect_list(F.struct(KEY, VALUE))).alias("pairs"))

    def inverted_index(self) -> DataFrame:
        """(key, value) and n_objects, how many objects have it."""
        return self.triples.groupBy(KEY, VALUE).agg(F.count_distinct(ID).alias("n_objects"))

    def postings(self) -> DataFrame:
        return self.triples.groupBy(KEY, VALUE).agg(F.array_sort(F.collect_set(ID)).alias("object_ids"))

    def to_wide(self, keys: list[str]) -> DataFrame:
        """One column a key, its greatest value where it has several; the keys are given, so no pass finds them."""
        return self.triples.filter(F.col(KEY).isin(keys)).groupBy(ID).pivot(KEY, keys).agg(F.max(VALUE))


def suffixes(column: Column) -> Column:
    """All suffixes of a string, the longest first; none of an empty one."""
    n = F.char_length(column)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(column, i, n))).otherwise(F.array().cast("array<string>"))


class TrieStore:
    """Triples as a suffix index answers: ``seq`` says in which order they came.

    Exact values fit at their end and prefixes anywhere. A node that several strings share knows the
    last of them only, while it holds the objects of all; suffix and infix queries judge that last
    one, so they may find more than a scan does, never less.
    """

    def __init__(self, triples: DataFrame, seq: str = "seq"):
        self.triples = triples.select(F.col(ID).cast("long").alias(ID), KEY, VALUE, F.col(seq).alias("seq"))

    def _keys(self, p: Pattern) -> DataFrame | None:
        if p.kind not in (Kind.SUFFIX, Kind.INFIX):
            return None
        keys = self.triples.groupBy(KEY).agg(F.max("seq").alias("seq"))
        nodes = keys.select(F.explode(suffixes(F.col(KEY))).alias("node"), KEY, "seq").groupBy("node").agg(F.max_by(KEY, "seq").alias("last"))
        return nodes.filter(p.on(F.col("last"))).select(F.col("node").alias(KEY))

    def search(self, query: str) -> DataFrame:
        q = Query.parse(query, Mode.TRIE)
        keys, rows = self._keys(q.key), self.triples
        if keys is not None:
            rows = rows.join(keys, KEY, "left_semi")
        else:
            fits = F.col(KEY).rlike("^" + "." .join(_quoted(x) for x in q.key.token.split("*"))) if q.key.kind is Kind.PREFIX and "*" in q.key.token else q.key.on(F.col(KEY))
            rows = rows if fits is None else rows.filter(fits)
        if q.value.kind in (Kind.SUFFIX, Kind.INFIX):
            nodes = rows.select(ID, KEY, "seq", VALUE, F.explode(suffixes(F.col(VALUE))).alias("node"))
            last = nodes.groupBy(KEY, "node").agg(F.max_by(VALUE, "seq").alias("last")).filter(q.value.on(F.col("last")))
            return ids(nodes.join(last.select(KEY, "node"), [KEY, "node"], "left_semi"))
        fits = q.value.on_trie(F.col(VALUE))
        return ids(rows if fits is None else rows.filter(fits))


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


@dataclass
class WideStore:
    """A table whose columns are the keys.

    With ``unique`` each id has one row, so searches need no grouping. ``digits`` rounds fractions
    where patterns and results see them as text; without it their text is lossless.
    """

    table: DataFrame
    id: str
    unique: bool = False
    digits: int | None = None
    keys: tuple[str, ...] | None = None  # all columns but the id

    def _columns(self, fits) -> list[tuple[str, Column, object]]:
        """(name, column, type) of the keys that fit."""
        return [(f.name, F.col(f"`{f.name}`"), f.dataType) for f in self.table.schema.fields if f.name != self.id and (self.keys is None or f.name in self.keys) and fits(f.name)]

    def _text(self, column: Column, kind) -> Column:
        return text_of(column, kind, self.digits)

    def _tests(self, q: Query, suffix_mode: bool) -> list[tuple[str, Column, Column]]:
        """(key, its text, the predicate) of every column that the key pattern fits."""
        if q.key.kind in (Kind.SUFFIX, Kind.INFIX) and not suffix_mode:
            return []
        return [(n, self._text(c, k), on_pattern(c, k, q.value, suffix_mode, self.digits)) for n, c, k in self._columns(q.key.test)]

    def _object(self) -> Column:
        return F.col(f"`{self.id}`").cast("long").alias(ID)

    def _ids(self, predicate: Column) -> DataFrame:
        found = self.table.filter(predicate).select(self._object())
        return found.orderBy(ID) if self.unique else ids(found)

    def search(self, query: str | Query, suffix_mode: bool = True) -> DataFrame:
        q = Query.parse(query) if isinstance(query, str) else query
        return self._ids(any_of([p for _, _, p in self._tests(q, suffix_mode)]))

    def matched_pairs(self, query: str | Query, suffix_mode: bool = True) -> DataFrame:
        """The pairs that fulfil both patterns, in one pass over the columns that fit."""
        q = Query.parse(query) if isinstance(query, str) else query
        return self._pairs(self._tests(q, suffix_mode))

    def _pairs(self, tests: list[tuple[str, Column, Column]]) -> DataFrame:
        if not tests:
            return self.table.filter(F.lit(False)).select(self._object(), F.lit("").alias(KEY), F.lit("").alias(VALUE))
        pairs = F.array(*(F.when(p, F.struct(F.lit(n).alias(KEY), t.alias(VALUE))) for n, t, p in tests))
        rows = self.table.filter(any_of([p for _, _, p in tests])).select(self._object(), F.explode(F.array_compact(pairs)).alias("pair"))
        return rows.select(ID, F.col("pair.key").alias(KEY), F.col("pair.value").alias(VALUE))

    def multi(self, query: str | MultiQuery, mode: str = "left") -> DataFrame:
        q = (MultiQuery.parse(query) if isinstance(query, str) else query).needed(mode)
        if not q.conditions:
            return self._ids(F.lit(True))
        holds = [any_of([on_condition(col, kind, c, self.digits) for _, col, kind in self._columns(c.key_fits)]) for c in q.conditions]
        if self.unique:
            return self._ids(q.combine(holds))
        # rows of one id are one object: conditions may hold in different rows
        names = [f"c{i}" for i in range(len(holds))]
        rows = self.table.filter(any_of(holds)).select(self._object(), *(F.coalesce(h, F.lit(False)).alias(n) for h, n in zip(holds, names, strict=True)))
        held = rows.groupBy(ID).agg(*(F.bool_or(n).alias(n) for n in names))
        return held.filter(q.combine([F.col(n) for n in names])).select(ID).orderBy(ID)

    def in_range(self, query: str | RangeQuery) -> DataFrame:
        q = RangeQuery.parse(query) if isinstance(query, str) else query
        return self._ids(any_of([on_range(c, k, q) for _, c, k in self._columns(q.key_fits)]))

    def has_key(self, key: str) -> bool:
        return bool(self._columns(lambda n: n == key))

    def has_suffix(self, suffix: str, suffix_mode: bool = True) -> bool:
        return suffix_mode and bool(self._columns(lambda n: n.endswith(suffix)))

    def can_handle(self, query: str) -> bool:
        return bool(self._columns(Query.parse(query).key.test))

    def inverted_index(self) -> DataFrame:
        """(key, value) and n_objects: each column is grouped as it is, and written as text once a value."""
        if self.digits is not None:  # values may meet once they are rounded
            return LongStore(self.to_long().triples).inverted_index()
        each = []
        for n, c, k in self._columns(lambda n: True):
            cells = self.table.select(self._object(), c.alias(VALUE)).filter(F.col(VALUE).isNotNull())
            count = F.count("*") if self.unique else F.count_distinct(ID)
            each.append(cells.groupBy(VALUE).agg(count.alias("n_objects")).select(F.lit(n).alias(KEY), self._text(F.col(VALUE), k).alias(VALUE), "n_objects"))
        none = self.table.filter(F.lit(False)).select(F.lit("").alias(KEY), F.lit("").alias(VALUE), F.lit(0).cast("long").alias("n_objects"))
        return reduce(DataFrame.unionByName, each, none)

    def to_long(self, keys: list[str] | None = None) -> WideTriples:
        """All cells that aren't null, as triples."""
        return WideTriples(WideStore(self.table, self.id, self.unique, self.digits, tuple(keys) if keys is not None else self.keys))


class WideTriples(LongStore):
    """Triples that a wide table holds: searches go to its columns, and only what needs triples makes them."""

    def __init__(self, wide: WideStore):
        self.wide = wide
        super().__init__(wide._pairs([(n, wide._text(c, k), c.isNotNull()) for n, c, k in wide._columns(lambda n: True)]))

    def matched_pairs(self, query: str | Query, suffix_mode: bool = True) -> DataFrame:
        return self.wide.matched_pairs(query, suffix_mode)

    def search(self, query: str | Query, suffix_mode: bool = True) -> DataFrame:
        return self.wide.search(query, suffix_mode)

    def multi(self, query: str | MultiQuery, mode: str = "left") -> DataFrame:
        q = (MultiQuery.parse(query) if isinstance(query, str) else query).needed(mode)
        return self.wide.multi(q, mode) if q.conditions else super().multi(q)

    def in_range(self, query: str | RangeQuery) -> DataFrame:
        return self.wide.in_range(query)

    def has_suffix(self, suffix: str, suffix_mode: bool = True) -> bool:
        return self.wide.has_suffix(suffix, suffix_mode)

    def can_handle(self, query: str) -> bool:
        return self.wide.can_handle(query)

    def inverted_index(self) -> DataFrame:
        return self.wide.inverted_index()


__all__ = ["Condition", "LongStore", "MultiQuery", "RangeQuery", "TrieStore", "WideStore", "WideTriples", "suffixes"]
