"""Registered queries of the search engine, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrilake.functions.text import NUMBER
from attrilake.operators.conditions import Condition, MultiQuery
from attrilake.operators.ranges import RangeQuery
from attrilake.operators.store import LongStore, TrieStore, WideStore, suffixes
from attrilake.plans import catalog_engine, health, popularity, workload

PART = ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")
PAIR_KEYS = ["l_returnflag", "l_linestatus", "l_quantity", "l_shipdate", "l_partkey"]
POPULAR = popularity.Settings(base=1, most=5, threshold=10.0, decay=0.1)
NUMBER_RE2 = NUMBER.replace(r"\z", "$")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(name: str, id: str):
    """A table with one row an id."""
    return lambda spark, sf_dir: WideStore(table(spark, sf_dir, name), id, unique=True)


part, customer, orders, events = wide("part", "p_partkey"), wide("customer", "c_custkey"), wide("orders", "o_orderkey"), wide("events", "event_id")


def pairs(spark: SparkSession, sf_dir: str) -> LongStore:
    """Lineitems as triples: an order has many pairs a key."""
    return WideStore(table(spark, sf_dir, "lineitem"), "l_orderkey").to_long(PAIR_KEYS)


def numbers(spark: SparkSession, sf_dir: str) -> WideStore:
    """Very small and very large numbers, and some that are none."""
    p = table(spark, sf_dir, "part")
    return WideStore(p.select("p_partkey", (F.col("p_retailprice") / 1_000_000).alias("tiny"), F.when(F.col("p_partkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice") * 1e14).alias("huge")), "p_partkey", unique=True)


# The same cells as SQL text.
def cell(column: str) -> str:
    if column.endswith("date"):
        return f"CASE WHEN {column} = date_trunc('day', {column}) THEN strftime({column}, '%Y-%m-%d') ELSE CAST({column} AS VARCHAR) END"
    return f"CAST({column} AS VARCHAR)"


def value_sql(column: str, pattern: str) -> str:
    c, t = cell(column), pattern.strip("*").replace("'", "''")
    if pattern == "*":
        return f"{column} IS NOT NULL"
    if pattern.startswith("*"):
        return f"contains({c}, '{t}')" if pattern.endswith("*") else f"ends_with({c}, '{t}')"
    return f"starts_with({c}, '{t}')" if pattern.endswith("*") else f"{c} = '{t}'"


def ids_sql(table: str, id: str, where: str) -> str:
    return f"SELECT DISTINCT CAST({id} AS BIGINT) AS object_id FROM {table} WHERE {where}"


def search_sql(columns, pattern: str) -> str:
    return ids_sql("part", "p_partkey", " OR ".join(value_sql(c, pattern) for c in columns))


#: A key pattern of each kind and the columns that it fits.
KEYS = {
    "exact": ("p_brand", ("p_brand",)),
    "prefix": ("p_*", PART),
    "suffix": ("*e", ("p_name", "p_type", "p_size", "p_retailprice")),
    "infix": ("*_n*", ("p_name",)),
    "wild": ("*", PART),
}
#: A value pattern of each kind for each of them.
VALUES = {
    "exact": {"exact": "Brand#2", "prefix": "Br*", "suffix": "*2", "infix": "*and*", "wild": "*"},
    "prefix": {"exact": "Brand#2", "prefix": "Br*", "suffix": "*2", "infix": "*in*", "wild": "*"},
    "suffix": {"exact": "7", "prefix": "ECO*", "suffix": "*ing", "infix": "*in*", "wild": "*"},
    "infix": {"exact": "small ring", "prefix": "sm*", "suffix": "*ing", "infix": "*ll*", "wild": "*"},
    "wild": {"exact": "7", "prefix": "1*", "suffix": "*2", "infix": "*in*", "wild": "*"},
}

LONG_SQL = "(" + " UNION ALL ".join(f"SELECT l_orderkey AS object_id, '{k}' AS key, {cell(k)} AS value FROM lineitem" for k in PAIR_KEYS) + ")"
PART_LONG_SQL = "(" + " UNION ALL ".join(f"SELECT p_partkey AS object_id, '{k}' AS key, {cell(k)} AS value FROM part" for k in PART) + ")"


def compare_sql(column: str, op: str, value: str, numeric: bool) -> str:
    c = cell(column)
    if not numeric:
        return f"{c} {op} '{value}'"
    return f"CASE WHEN regexp_matches({c}, '{NUMBER_RE2}') THEN TRY_CAST({c} AS DOUBLE) {op} {value} ELSE {c} {op} '{value}' END"


#: name: (condition on part, its SQL)
CONDITIONS = {
    "cond_eq": ("p_brand = Brand#2", "p_brand = 'Brand#2'"),
    "cond_ne": ("p_brand != Brand#2", "p_brand <> 'Brand#2'"),
    "cond_gt": ("p_size > 25", "p_size > 25"),
    "cond_lt": ("p_retailprice < 910.5", "p_retailprice < 910.5"),
    "cond_ge": ("p_size >= 25", "p_size >= 25"),
    "cond_le": ("p_retailprice <= 905", "p_retailprice <= 905"),
    "cond_gt_text": ("p_name > small", compare_sql("p_name", ">", "small", False)),
    "cond_gt_mixed": ("p_brand > 5", compare_sql("p_brand", ">", "5", True)),
    "cond_contains": ("p_name contains ring", "contains(p_name, 'ring')"),
    "cond_startswith": ("p_type startsWith ECO", "starts_with(p_type, 'ECO')"),
    "cond_endswith": ("p_name endsWith ring", "ends_with(p_name, 'ring')"),
    "cond_regex": ("p_brand ~= Brand#[1-3]+", "regexp_full_match(p_brand, 'Brand#[1-3]+')"),
    "cond_glob": ("p_brand = Brand#?", "regexp_full_match(p_brand, 'Brand#.')"),
    "cond_key_glob": ("p_*e = 7", " OR ".join(f"{cell(c)} = '7'" for c in KEYS["suffix"][1])),
}

#: name: (query on part, how operators combine, its SQL)
MULTI = {
    "multi_and": ("p_size >= 10 AND p_brand = Brand#2", "left", "p_size >= 10 AND p_brand = 'Brand#2'"),
    "multi_or": ("p_size > 45 OR p_brand = Brand#2", "left", "p_size > 45 OR p_brand = 'Brand#2'"),
    "multi_mixed_ref": ("p_size >= 10 AND p_size < 20 OR p_brand = Brand#2", "leading", "p_size >= 10 AND p_size < 20"),
    "multi_mixed_left": ("p_size >= 10 AND p_size < 20 OR p_brand = Brand#2", "left", "(p_size >= 10 AND p_size < 20) OR p_brand = 'Brand#2'"),
}


def with_formats(spark: SparkSession, sf_dir: str) -> LongStore:
    """Order dates in three formats under three keys."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("object_id"), F.col("o_orderdate").alias("d"))
    forms = {"iso": "yyyy-MM-dd", "us": "MM/dd/yyyy", "eu": "dd-MM-yyyy"}
    cells = F.array(*(F.struct(F.lit(k).alias("key"), F.date_format("d", f).alias("value")) for k, f in forms.items()))
    return LongStore(o.select("object_id", F.explode(cells).alias("c")).select("object_id", "c.key", "c.value"))


RANGE_SQL = "SELECT DISTINCT CAST(o_orderkey AS BIGINT) AS object_id FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{}' AND DATE '{}'"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of accesses."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("pattern"), F.col("ts").cast("timestamp").alias("ts"), F.lit(1.0).alias("increment"))


def now(events: DataFrame):
    """The last event's time, as a scalar subquery."""
    return events.agg(F.max("ts")).scalar()


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    return popularity.popularity(rows, now(rows), POPULAR)


SCORE_SQL = """SELECT event_type AS pattern, sum(exp(-0.1 * (epoch_ms((SELECT max(ts) FROM events)) - epoch_ms(ts)) / 3600000.0)) AS popularity
FROM events GROUP BY event_type"""


#: The ordered log of each pattern, folded: {score, time} after each access, the first as it is.
BONUS_SQL = """WITH l AS (SELECT event_type AS pattern, list({'s': 1.0::DOUBLE, 'ms': epoch_ms(ts)} ORDER BY ts) AS log FROM events GROUP BY event_type),
f AS (SELECT pattern, list_reduce(log, lambda a, x: {'s': a.s * exp(-0.1 * (x.ms - a.ms) / 3600000.0) + CASE WHEN a.s > 10 THEN 1 + log10(a.s / 10) ELSE 1 END * x.s, 'ms': x.ms}) AS e FROM l)
SELECT pattern, round(e.s * exp(-0.1 * (epoch_ms((SELECT max(ts) FROM events)) - e.ms) / 3600000.0), 4) AS popularity FROM f"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("query"), F.col("value").alias("millis"), (F.col("user_id") % 7).cast("int").alias("factor"), F.col("event_id").alias("n"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def avg_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(workload.mean_by_query(runs(spark, sf_dir)), "avg_millis", "total_millis", digits=4)


def improvement_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    by = workload.compared(r.filter("n % 2 = 0"), r.filter("n % 2 = 1"), scores(spark, sf_dir))
    return rounded(by.select("query", "StandardTime", "AdaptiveTime", "Improvement"), "StandardTime", "AdaptiveTime", "Improvement", digits=4)


def rf_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).select(F.col("factor").alias("ReplicationFactor"), F.col("millis").alias("StandardTime"), (F.col("millis") / 2).alias("AdaptiveTime"), F.lit(50.0).alias("Improvement"), F.col("n").cast("double").alias("Popularity"))
    return rounded(workload.by_factor(r), "StandardTime", "AdaptiveTime", "Improvement", "Popularity", digits=4)


def heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = table(spark, sf_dir, "events").select(F.col("user_id").alias("server_id"), popularity.millis(F.col("ts")).alias("timestamp"))
    return health.health(beats, beats.agg(F.max("timestamp")).scalar(), 36_000_000, 360_000_000)


def inserted(spark: SparkSession, sf_dir: str) -> LongStore:
    more = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("object_id"), F.lit("p_brand").alias("key"), F.lit("Brand#2").alias("value"))
    return part(spark, sf_dir).to_long().insert(more)


def deleted(spark: SparkSession, sf_dir: str) -> LongStore:
    gone = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("object_id"), F.lit("p_brand").alias("key"), F.lit("Brand#2").alias("value"))
    return part(spark, sf_dir).to_long().delete(gone)


def object_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = part(spark, sf_dir).to_long().object_view()
    return view.select("object_id", F.size("pairs").cast("long").alias("n_pairs"), F.array_join(F.transform("pairs", lambda p: F.concat(p["key"], F.lit("="), p["value"])), ";").alias("pairs"))


def suffix_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("object_id"), F.explode(suffixes(F.col("p_name"))).alias("suffix"))


def trie_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TrieStore(part(spark, sf_dir).to_long().triples.withColumn("seq", F.col("object_id"))).search("p_name=ring")


def trie_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TrieStore(part(spark, sf_dir).to_long().triples.withColumn("seq", F.col("object_id"))).search("p_name=ri*")


def trie_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TrieStore(part(spark, sf_dir).to_long(["p_name"]).triples.withColumn("seq", F.col("object_id"))).search("p_name=*ll ring")


TRIE_SUFFIX_SQL = """
WITH nodes AS (SELECT p_partkey AS object_id, p_name AS value, substring(p_name, CAST(i AS INT)) AS node FROM part, range(1, 200) t(i) WHERE i <= length(p_name)),
last AS (SELECT node, max_by(value, object_id) AS value FROM nodes GROUP BY node)
SELECT DISTINCT CAST(object_id AS BIGINT) AS object_id FROM nodes JOIN last USING (node) WHERE ends_with(last.value, 'll ring')
"""


def _entries() -> dict[str, tuple]:
    """name: (query, SQL or None)"""
    out: dict[str, tuple] = {}
    for k, (key, columns) in KEYS.items():
        for v, value in VALUES[k].items():
            out[f"search_{k}_{v}"] = (lambda s, d, q=f"{key}={value}": part(s, d).search(q)), search_sql(columns, value)
    out["search_key_only"] = (lambda s, d: part(s, d).search("p_name")), search_sql(("p_name",), "*")
    out["search_no_suffix_mode"] = (lambda s, d: part(s, d).search("*name=*", suffix_mode=False)), "SELECT CAST(p_partkey AS BIGINT) AS object_id FROM part WHERE false"
    out["search_long_lineitem"] = (lambda s, d: pairs(s, d).search("l_ship*=1996-0*")), ids_sql("lineitem", "l_orderkey", "starts_with(strftime(l_shipdate, '%Y-%m-%d'), '1996-0')")
    out["search_long_infix"] = (lambda s, d: pairs(s, d).search("*_q*=*7.0*")), ids_sql("lineitem", "l_orderkey", value_sql("l_quantity", "*7.0*"))
    matched = " UNION ALL ".join(f"SELECT CAST(p_partkey AS BIGINT) AS object_id, '{c}' AS key, {cell(c)} AS value FROM part WHERE {value_sql(c, '*in*')}" for c in PART)
    out["matched_pairs"] = (lambda s, d: part(s, d).matched_pairs("*=*in*")), matched
    out["matched_pairs_long"] = (lambda s, d: pairs(s, d).matched_pairs("l_*=*-02-1*")), f"SELECT * FROM {LONG_SQL} WHERE contains(value, '-02-1')"
    out["pairs_of_ids"] = (lambda s, d: part(s, d).to_long().pairs_of(part(s, d).search("p_brand=Brand#2"))), f"SELECT * FROM {PART_LONG_SQL} WHERE object_id IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2')"
    out["object_view"] = object_view, f"SELECT object_id, count(*) AS n_pairs, string_agg(key || '=' || value, ';' ORDER BY key, value) AS pairs FROM {PART_LONG_SQL} GROUP BY object_id"
    for name, (text, sql) in CONDITIONS.items():
        out[name] = (lambda s, d, c=text: part(s, d).multi(MultiQuery().add(Condition.parse(c)))), ids_sql("part", "p_partkey", sql)
    for name, (text, mode, sql) in MULTI.items():
        out[name] = (lambda s, d, q=text, m=mode: part(s, d).multi(q, m)), ids_sql("part", "p_partkey", sql)
    out["multi_empty"] = (lambda s, d: customer(s, d).multi(MultiQuery())), ids_sql("customer", "c_custkey", "true")
    out["multi_existential"] = (
        lambda s, d: pairs(s, d).multi("l_returnflag = R AND l_returnflag = A"),
        "SELECT l_orderkey AS object_id FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_returnflag = 'R') AND bool_or(l_returnflag = 'A')",
    )
    out["multi_existential_wide"] = (
        lambda s, d: WideStore(table(s, d, "lineitem"), "l_orderkey").multi("l_quantity > 45 AND l_returnflag = A OR l_linenumber = 7"),
        "SELECT l_orderkey AS object_id FROM lineitem GROUP BY l_orderkey HAVING (bool_or(l_quantity > 45) AND bool_or(l_returnflag = 'A')) OR bool_or(l_linenumber = 7)",
    )
    out["range_numeric"] = (lambda s, d: part(s, d).in_range("p_retailprice in range [905 to 915.5]")), ids_sql("part", "p_partkey", "p_retailprice BETWEEN 905 AND 915.5")
    out["range_numeric_glob"] = (lambda s, d: part(s, d).in_range(RangeQuery.numbers("p_*", -5, 12))), ids_sql("part", "p_partkey", "p_size BETWEEN -5 AND 12 OR p_retailprice BETWEEN -5 AND 12")
    out["cond_gt_double"] = (lambda s, d: numbers(s, d).multi("tiny > 0.000905")), ids_sql("part", "p_partkey", "p_retailprice / 1000000 > 0.000905")
    out["cond_eq_double"] = (lambda s, d: part(s, d).multi("p_retailprice = 905.00")), ids_sql("part", "p_partkey", "p_retailprice = 905")
    out["cond_ne_double"] = (lambda s, d: numbers(s, d).multi("tiny != 0.000905")), ids_sql("part", "p_partkey", "p_retailprice / 1000000 <> 0.000905")
    out["wide_large_double"] = (lambda s, d: numbers(s, d).multi("huge >= 9.1e16")), ids_sql("part", "p_partkey", "p_partkey % 5 = 0 OR p_retailprice * 1e14 >= 9.1e16")
    out["range_double"] = (lambda s, d: numbers(s, d).in_range("*n* in range [0.0009 to 9.05e-4]")), ids_sql("part", "p_partkey", "p_retailprice / 1000000 BETWEEN 0.0009 AND 0.000905")
    out["range_timestamp"] = (lambda s, d: events(s, d).in_range("ts in range [2024-01-05 to 2024-01-07]")), ids_sql("events", "event_id", "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08'")
    out["cond_timestamp"] = (lambda s, d: events(s, d).multi("ts >= 2024-01-10 12:00:00 AND ts < 2024-01-11")), ids_sql("events", "event_id", "ts >= TIMESTAMP '2024-01-10 12:00:00' AND ts < TIMESTAMP '2024-01-11'")
    out["search_date_prefix"] = (lambda s, d: orders(s, d).search("o_orderdate=1996-0*")), ids_sql("orders", "o_orderkey", "starts_with(strftime(o_orderdate, '%Y-%m-%d'), '1996-0')")
    out["search_date_exact"] = (lambda s, d: orders(s, d).search("*date=1996-01-02")), ids_sql("orders", "o_orderkey", "o_orderdate = TIMESTAMP '1996-01-02'")
    out["range_date_wide"] = (lambda s, d: orders(s, d).in_range(RangeQuery.dates("o_orderdate", "02/10/1995", "02/31/1996", "MM/DD/YYYY"))), RANGE_SQL.format("1995-02-10", "1996-03-02")
    out["range_date_iso"] = (lambda s, d: with_formats(s, d).in_range("iso in range [1995-02-10 to 1996-02-31]")), RANGE_SQL.format("1995-02-10", "1996-03-02")
    out["range_date_us"] = (lambda s, d: with_formats(s, d).in_range("us in range [02/10/1995 to 06/30/1995]")), RANGE_SQL.format("1995-02-10", "1995-06-30")
    out["range_date_eu"] = (lambda s, d: with_formats(s, d).in_range(RangeQuery.dates("eu", "10-02-1995", "30-06-1995", "DD-MM-YYYY"))), RANGE_SQL.format("1995-02-10", "1995-06-30")
    out["insert_then_search"] = (lambda s, d: inserted(s, d).search("p_brand=Brand#2")), "SELECT CAST(p_partkey AS BIGINT) AS object_id FROM part WHERE p_brand = 'Brand#2' UNION SELECT CAST(s_suppkey AS BIGINT) FROM supplier"
    out["delete_then_search"] = (lambda s, d: deleted(s, d).search("p_brand=Brand#2")), "SELECT CAST(p_partkey AS BIGINT) AS object_id FROM part WHERE p_brand = 'Brand#2' AND p_partkey NOT IN (SELECT s_suppkey FROM supplier)"
    out["suffix_expand"] = suffix_expand, "SELECT CAST(p_partkey AS BIGINT) AS object_id, substring(p_name, CAST(i AS INT)) AS suffix FROM part, range(1, 200) t(i) WHERE i <= length(p_name)"
    out["inverted_index"] = (lambda s, d: pairs(s, d).inverted_index()), f"SELECT key, value, count(DISTINCT object_id) AS n_objects FROM {LONG_SQL} GROUP BY key, value"
    out["trie_exact"] = trie_exact, ids_sql("part", "p_partkey", "ends_with(p_name, 'ring')")
    out["trie_prefix"] = trie_prefix, ids_sql("part", "p_partkey", "contains(p_name, 'ri')")
    out["trie_suffix"] = trie_suffix, TRIE_SUFFIX_SQL
    out["popularity_decay"] = (lambda s, d: rounded(scores(s, d).select("pattern", "popularity"), "popularity")), f"SELECT pattern, round(popularity, 6) AS popularity FROM ({SCORE_SQL})"
    out["popularity_bonus"] = (lambda s, d: rounded(popularity.popularity_with_bonus(r := log(s, d), now(r), POPULAR), "popularity", digits=4)), BONUS_SQL
    out["popularity_topk"] = (lambda s, d: rounded(popularity.ranked(scores(s, d).select("pattern", "popularity"), 3), "popularity")), f"SELECT pattern, round(popularity, 6) AS popularity FROM ({SCORE_SQL}) WHERE popularity > 0.01 ORDER BY popularity DESC, pattern LIMIT 3"
    out["replication_factor"] = (
        lambda s, d: scores(s, d).select("pattern", popularity.replicas(F.col("popularity"), POPULAR).alias("replicas")),
        f"SELECT pattern, CAST(CASE WHEN popularity < 10 THEN 1 ELSE least(1 + floor(log10(popularity / 10)), 5) END AS INT) AS replicas FROM ({SCORE_SQL})",
    )
    out["workload_avg_by_query"] = avg_by_query, "SELECT event_type AS query, round(avg(value), 4) AS avg_millis, round(sum(value), 4) AS total_millis, count(*) AS runs FROM events GROUP BY event_type"
    out["improvement_pct"] = improvement_pct, """
SELECT event_type AS query, round(s, 4) AS "StandardTime", round(a, 4) AS "AdaptiveTime", round((s - a) * 100 / s, 4) AS "Improvement"
FROM (SELECT event_type, avg(value) FILTER (event_id % 2 = 0) AS s, avg(value) FILTER (event_id % 2 = 1) AS a FROM events GROUP BY event_type)"""
    out["rf_grouped"] = rf_grouped, """
SELECT CAST(user_id % 7 AS INT) AS "ReplicationFactor", round(avg(value), 4) AS "StandardTime", round(avg(value / 2), 4) AS "AdaptiveTime", round(avg(50.0), 4) AS "Improvement", round(avg(event_id::DOUBLE), 4) AS "Popularity"
FROM events GROUP BY 1"""
    out["trend_fit"] = (
        lambda s, d: rounded(workload.trend(runs(s, d).withColumn("n", F.col("n").cast("double")), "millis", "n"), "slope", "intercept"),
        "SELECT round(regr_slope(value, event_id::DOUBLE), 6) AS slope, round(regr_intercept(value, event_id::DOUBLE), 6) AS intercept FROM events",
    )
    out["heartbeat_status"] = heartbeat, """
SELECT user_id AS server_id, max(epoch_us(ts) // 1000) AS last_beat,
  CASE WHEN age > 360000000 THEN 'CONFIRMED_DOWN' WHEN age > 36000000 THEN 'SUSPECT' ELSE 'ACTIVE' END AS status
FROM (SELECT user_id, ts, (SELECT max(epoch_us(ts) // 1000) FROM events) - max(epoch_us(ts) // 1000) OVER (PARTITION BY user_id) AS age FROM events) GROUP BY user_id, age"""
    return out | catalog_engine.entries()


def queries():
    return {name: query for name, (query, _) in _entries().items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _entries().items() if sql}
