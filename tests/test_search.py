"""Patterns, stores, conditions and ranges."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from attrilake.functions import text as fn
from attrilake.operators.conditions import Condition, MultiQuery
from attrilake.operators.pattern import Kind, Mode, Pattern, Query
from attrilake.operators.ranges import RangeQuery
from attrilake.operators.store import LongStore, TrieStore, WideStore
from attrilake.plans.catalog_engine import DEMO as TRIPLES

SCHEMA = "object_id long, key string, value string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def found(df):
    return [r[0] for r in df.collect()]


@pytest.fixture(scope="module")
def store(spark):
    return LongStore(frame(spark, TRIPLES))


# The demo's queries and the ids they have to give.
GOLDEN = {
    "StageX=300.00": [1002], "Stage*=*": [1001, 1002], "*PATH=*tif": [1001, 1002], "*FILE*=*metadata*": [1001, 1002], "Stage*=*00": [1001, 1002],
    "*=*488*": [1001], "*FILE*=*": [1001, 1002], "*=*.tif": [1001, 1002], "FILE_PATH=*": [1001, 1002], "FILE_PATH": [1001, 1002], "StageX=00.00": [],
    "*=*561*": [1002], "nothing=*": [], "**=*": [],
}


@pytest.mark.parametrize("query", GOLDEN)
def test_golden(store, query):
    assert found(store.search(query)) == GOLDEN[query]


def test_trie_mode(spark):
    trie = TrieStore(frame(spark, [(i, *t) for i, t in enumerate(TRIPLES)], "seq long, " + SCHEMA))
    assert found(trie.search("StageX=00.00")) == [1001, 1002]  # exact values fit at their end
    assert found(trie.search("*=*561*")) == [1001, 1002]  # shared nodes know the last value only
    assert found(trie.search("*=*488*")) == [1001]
    assert found(trie.search("FILE_PATH=488*")) == [1001]  # prefixes fit anywhere
    assert found(trie.search("FILE_PATH=4*8nm*")) == [1001]  # a star in a prefix is one character
    assert found(trie.search("Stage*=*")) == [1001, 1002]
    assert found(trie.search("S*age*=*")) == [1001, 1002]


def test_insert_and_delete(spark, store):
    more = frame(spark, [(1003, "test_key", "test_value")] * 2)
    grown = store.insert(more)
    assert found(grown.search("test_key=test_value")) == [1003]
    assert found(grown.delete(more).search("test_key=test_value")) == []
    assert grown.has_key("test_key") and not store.has_key("test_key")
    assert store.has_suffix("PATH") and not store.has_suffix("PATH", suffix_mode=False)
    assert store.can_handle("Sta*=x") and not store.can_handle("zzz=x")
    pairs = {r.object_id: len(r.pairs) for r in grown.object_view().collect()}
    assert pairs == {1001: 7, 1002: 7, 1003: 2}


def test_without_suffix_mode(store):
    assert found(store.search("*PATH=*", suffix_mode=False)) == []
    assert found(store.search("FILE*=*tif", suffix_mode=False)) == []
    assert found(store.search("FILE*=/data*", suffix_mode=False)) == [1001, 1002]


@pytest.mark.parametrize("text", ["*", "a", "a*", "*a", "*a*", "a*b", "***", "a=b=c", "k=*v*", "", "k="])
def test_queries_print_as_they_parse(text):
    q = Query.parse(text)
    assert Query.parse(str(q)) == q


def test_kinds():
    assert Pattern.parse("**") == Pattern(Kind.PREFIX, "*") and Pattern.parse("**", Mode.TRIE) == Pattern(Kind.SUFFIX, "*")
    assert Pattern.parse("***") == Pattern(Kind.INFIX, "*") and Pattern.parse("a*b").kind is Kind.EXACT
    assert Query.parse("k=a=b").value == Pattern(Kind.EXACT, "a=b")


words = st.text(alphabet="aB1*%_é", max_size=3)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), words), st.one_of(st.none(), words)), max_size=6), key=st.sampled_from(["k_1", "k*", "*2", "*_*", "*", "x"]), value=st.tuples(st.sampled_from(["{}", "{}*", "*{}", "*{}*"]), words))
def test_long_wide_and_naive_agree(spark, rows, key, value):
    query = f"{key}={value[0].format(value[1])}"
    table = spark.createDataFrame(rows, "id long, k_1 string, k_2 string")
    wide = WideStore(table, "id")
    q = Query.parse(query)
    naive = sorted({r[0] for r in rows for name, cell in zip(("k_1", "k_2"), r[1:], strict=True) if cell is not None and q.key.test(name) and q.value.test(cell)})
    assert found(wide.search(query)) == naive
    assert found(wide.to_long().search(query)) == naive
    assert sorted({r.object_id for r in wide.matched_pairs(query).collect()}) == naive


def test_wide_predicates_reach_the_scan(spark, sf_dir, capsys):
    store = WideStore(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey")
    store.search("p_brand=Brand#2").explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(p_brand,Brand#2)" in plan and "p_name" not in plan
    store.search("p_size=7").explain("formatted")
    assert "EqualTo(p_size,7)" in capsys.readouterr().out
    assert "Python" not in plan


CONDITIONS = [
    ("x = 5", "5", True), ("x != 5", "6", True), ("x > 9", "10", True), ("x > 9", "abc", True), ("x < 5.5", "5", True), ("x >= 5", "05", True), ("x <= 1e1", "10.0", True),
    ("x > b", "c", True), ("x contains *", "a*b", True), ("x contains *", "ab", False), ("x startsWith a", "ab", True), ("x endsWith b", "ab", True), ("x ~= a.c", "abc", True),
    ("x ~= b", "abc", False), ("x ~= (", "(", False), ("x = *.tif", "a.tif", True), ("x = *.tif", "atif", False), ("x = ?b", "ab", True), ("x != a*", "abc", False),
    ("x > 5", "12 ", False), ("x > 5", "1.5d", False), ("x = ", "", True), ("x >= 1", "nan", True),
]


@pytest.mark.parametrize(("text", "value", "holds"), CONDITIONS)
def test_conditions(spark, text, value, holds):
    rows = LongStore(frame(spark, [(1, "x", value)]))
    assert found(rows.multi(MultiQuery().add(text))) == ([1] if holds else [])


def test_condition_parsing():
    assert Condition.parse("contains_x=5") == Condition("", "contains", "_x=5")
    assert Condition.parse("a=b>c") == Condition("a=b", ">", "c")
    assert Condition.parse(" k\t~=  v ") == Condition("k", "~=", "v")
    with pytest.raises(ValueError):
        Condition.parse("nothing here")
    q = MultiQuery.parse("x >= 5 AND y < 3 OR z = 1")
    assert q.operators == ["AND", "OR"] and str(MultiQuery.parse(str(q))) == str(q)
    assert [c.key for c in q.needed("leading").conditions] == ["x", "y"] and q.needed("left") is q


def test_combinations(spark):
    rows = [(1, "a", "1"), (1, "b", "2"), (2, "a", "1"), (3, "c", "3"), (1, "a", "9")]
    store = LongStore(frame(spark, rows))
    assert found(store.multi("a = 1 AND b = 2")) == [1]
    assert found(store.multi("a = 1 AND a = 9")) == [1]  # different pairs may fulfil them
    assert found(store.multi("a = 1 OR c = 3")) == [1, 2, 3]
    assert found(store.multi("a = 1 AND b = 2 OR c = 3")) == [1, 3]
    assert found(store.multi("a = 1 AND b = 2 OR c = 3", mode="leading")) == [1]
    assert found(store.multi("a = 7 OR b = 2 AND c = 3")) == []
    assert found(store.multi("a = 7 OR b = 2 AND c = 3", mode="leading")) == [1]
    assert found(store.multi(MultiQuery())) == [1, 2, 3]


DATES = [("YYYY-MM-DD", "2023-05-26", True), ("YYYY-MM-DD", "2023-5-26", False), ("YYYY-MM-DD", "2023-02-31", True), ("MM/DD/YYYY", "05/26/2023", True), ("DD-MM-YYYY", "26-05-2023", True), ("DD-MM-YYYY", "2023-05-26", False), ("other", "2023-05-26", False), ("YYYY-MM-DD", "2023-05-26\n", False)]


@pytest.mark.parametrize(("form", "text", "valid"), DATES)
def test_dates(spark, form, text, valid):
    row = frame(spark, [(1, "d", text)]).select(fn.as_date(_col("value"), form).alias("d"), fn.format_days(fn.as_days(_col("value"), form), form).alias("t")).first()
    assert (row.d is not None) == valid
    if valid and text != "2023-02-31":
        assert row.t == text
    if text == "2023-02-31" and valid:
        assert row.d.isoformat() == "2023-03-03"


def _col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_ranges(spark, store):
    assert found(store.in_range("StageX in range [50 to 150]")) == [1001]
    assert found(store.in_range("Stage* in range [-5 to 75]")) == [1001, 1002]
    assert found(store.in_range("creation_date in range [2023-06-01 to 2023-06-30]")) == [1002]
    assert found(store.in_range("microscope in range [0 to 9]")) == []
    q = RangeQuery.parse("k in range [-5 to 7.5]")
    assert not q.is_date and RangeQuery.parse(str(q)) == q
    assert RangeQuery.parse("k in range [05/01/2023 to 05/31/2023]").form == "MM/DD/YYYY"
    assert str(q.to_conditions()) == "k >= -5.0 AND k <= 7.5"
    with pytest.raises(ValueError):
        RangeQuery.parse("k between 1 and 2")


def test_numbers():
    yes, no = ["12", "1e5", ".5", "5.", "+3", "-0.1E-2"], [" 12", "12 ", "\t12", "1.5d", "0x1F", "nan", "inf", "", "abc", "12\n"]
    assert all(map(fn.is_number, yes)) and not any(map(fn.is_number, no))
    assert fn.to_number("x") == 0.0


def test_to_wide(spark, store):
    row = {r.object_id: r for r in store.to_wide(["StageX", "microscope"]).collect()}
    assert row[1001].StageX == "100.00" and row[1002].microscope == "LLSM-2"
    assert {r.key: r.n_objects for r in store.inverted_index().filter("value = '100.00'").collect()} == {"StageX": 1}


def filters(df, capsys):
    df.explain("formatted")
    return capsys.readouterr().out


def test_native_comparisons_reach_the_scan(spark, sf_dir, capsys):
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    part, orders, events = WideStore(t("part"), "p_partkey", unique=True), WideStore(t("orders"), "o_orderkey", unique=True), WideStore(t("events"), "event_id", unique=True)
    plan = filters(part.multi("p_size > 25.5"), capsys)
    assert "GreaterThan(p_size,25)" in plan and "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan and "Aggregate" not in plan
    assert "GreaterThan(o_custkey,100)" in filters(orders.multi("o_custkey > 100"), capsys)
    plan = filters(part.multi("p_retailprice > 905 AND p_brand = Brand#2"), capsys)
    assert "GreaterThan(p_retailprice,905.0)" in plan and "EqualTo(p_brand,Brand#2)" in plan
    assert "GreaterThanOrEqual(p_retailprice,905.0)" in filters(part.in_range("p_retailprice in range [905 to 915.5]"), capsys)
    assert "GreaterThanOrEqual(o_orderdate,1995-02-10" in filters(orders.in_range("o_orderdate in range [1995-02-10 to 1996-02-31]"), capsys)
    assert "GreaterThan(ts,2024-01-05" in filters(events.multi("ts > 2024-01-05"), capsys)
    plan = filters(WideStore(t("lineitem"), "l_orderkey").to_long(["l_returnflag", "l_shipdate", "l_quantity"]).search("l_ship*=1996-0*"), capsys)
    assert "GreaterThanOrEqual(l_shipdate,1996-01-01" in plan and "ReadSchema: struct<l_orderkey:bigint,l_shipdate:timestamp" in plan and "Generate" not in plan


TYPED = [
    ("b > 126", [3]), ("b > 127", []), ("b >= -128.5", [1, 2, 3]), ("b < -200", []), ("b <= 1e0", [1, 2]), ("b = 07", []), ("b = 7", []), ("b = 1", [2]), ("b != 1", [1, 3]), ("b > x", []), ("b < x", [1, 2, 3]),
    ("f > 0.0005", [1, 3]), ("f = 1.0e-3", [1]), ("f = 0.0010", [1]), ("f < 1e17", [1, 2]), ("f != nan", [1, 2, 3]), ("f = NaN", [3]), ("f contains E-4", [2]),
    ("d = 2024-02-29", [1]), ("d > 2024-02-29", [2]), ("d > 2024-02-29 10:00:00", [2]), ("d < 2024-02-29 10:00:00", [1]), ("d startsWith 2024-0", [1, 2]), ("d = 2024-0?-*", [1, 2]), ("d > x", []),
    ("t = 2024-02-29", [1]), ("t = 2024-03-01 10:30:00", [2]), ("t > 2024-02-29", [2]), ("t endsWith 30:00", [2]), ("t != 2024-02-29", [2]), ("e = 12.50", [1]), ("e > 12.49", [1]), ("e < 0", [2]), ("o = true", [1]), ("o != true", [2]),
    ("*d* > 2024-02-29", [2]), ("zz = 1", []),
]


@pytest.fixture(scope="module")
def typed(spark):
    import datetime as dt
    from decimal import Decimal

    rows = [
        (1, -128, 0.001, dt.date(2024, 2, 29), dt.datetime(2024, 2, 29), Decimal("12.50"), True),
        (2, 1, 0.0001, dt.date(2024, 3, 1), dt.datetime(2024, 3, 1, 10, 30), Decimal("-1.00"), False),
        (3, 127, float("nan"), None, None, None, None),
    ]
    return spark.createDataFrame(rows, "id long, b byte, f double, d date, t timestamp, e decimal(10,2), o boolean")


@pytest.mark.parametrize(("text", "want"), TYPED)
def test_conditions_on_types(typed, text, want):
    assert found(WideStore(typed, "id").multi(MultiQuery().add(text))) == want
    assert found(WideStore(typed, "id", unique=True).multi(MultiQuery().add(text))) == want
    assert found(WideStore(typed, "id").to_long().multi(MultiQuery().add(text))) == want


def test_searches_and_ranges_on_types(spark, typed):
    store = WideStore(typed, "id")
    for query, want in (("d=2024-02*", [1]), ("t=2024-03-01*", [2]), ("t=2024*", [1, 2]), ("d=2024-13*", []), ("d=20*", [1, 2]), ("f=0.001", [1]), ("f=1.0E-4", [2]), ("f=*", [1, 2, 3]), ("e=12.5", [1]), ("b=-128", [1]), ("b=+1", []), ("*=*0*", [1, 2])):
        assert found(store.search(query)) == want == found(store.to_long().search(query)), query
    for query, want in (("b in range [-500 to 1.5]", [1, 2]), ("f in range [0.0001 to 5]", [1, 2]), ("d in range [2024-02-29 to 2024-02-29]", [1]), ("t in range [01-03-2024 to 01-03-2024]", [2]), ("d in range [0 to 9]", []), ("f in range [2024-01-01 to 2024-12-31]", []), ("e in range [-1 to 12.5]", [1, 2])):
        assert found(store.in_range(query)) == want, query
    big = spark.createDataFrame([(1, 1e17), (2, 905.004), (3, 905.0)], "id long, v double")
    assert found(WideStore(big, "id").multi("v > 905")) == [1, 2] and found(WideStore(big, "id").search("v=905.00")) == [3]
    assert found(WideStore(big, "id", digits=2).search("v=905.00")) == [2, 3]
    assert {(r.value, r.n_objects) for r in WideStore(big, "id", digits=2).inverted_index().collect()} == {("100000000000000000.00", 1), ("905.00", 2)}
    assert {(r.key, r.value, r.n_objects) for r in store.inverted_index().filter("key IN ('d', 'o')").collect()} == {("d", "2024-02-29", 1), ("d", "2024-03-01", 1), ("o", "true", 1), ("o", "false", 1)}


def test_expressions_are_judged_by_the_engine_that_runs_them(spark):
    rows = LongStore(frame(spark, [(1, "k", "é"), (2, "k", "a")]))
    assert found(rows.multi("k ~= (?P<n>a)")) == [] and found(rows.multi("k ~= [")) == [] and found(rows.multi("k ~= a)(")) == []
    assert found(rows.multi(r"k ~= \p{L}")) == [1, 2] and found(rows.multi(r"k ~= (?<n>a)")) == [2]
