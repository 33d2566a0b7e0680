"""Registered queries of placement, routing, checkpoints, streams and reports, with their SQL.

The SQL hashes, walks the ring and resolves routes by itself; only parameters are written into it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrilake.functions.text import as_days, format_days
from attrilake.operators.pattern import Kind, Pattern
from attrilake.operators.ranges import RangeQuery
from attrilake.operators.store import ID, KEY, VALUE, LongStore, TrieStore, WideStore
from attrilake.plans import health, popularity, workload
from attrilake.plans.adaptive import AdaptiveRouting, recorded, since_reset, trace
from attrilake.plans.benchmark import Plan, drawn
from attrilake.plans.placement import NODES, OFFSET_32, OFFSET_64, PLACES, PREFIXES, PRIME_32, PRIME_64, Placement, hash32, load_mapping, migration, replication_factor, save_mapping
from attrilake.plans.service import MetadataService
from attrilake.plans.sessions import ClientManager
from attrilake.sources import checkpoint, results, synthetic
from attrilake.sources.shared import fresh_folder
from attrilake.streaming import ingest, stateful

PART_KEYS = ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")
LONG = "(" + " UNION ALL ".join(f"SELECT p_partkey AS object_id, '{k}' AS key, CAST({k} AS VARCHAR) AS value FROM part" for k in PART_KEYS) + ")"
HOT = popularity.Settings(base=1, most=5, threshold=10.0, decay=0.1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> LongStore:
    return WideStore(table(spark, sf_dir, "part"), "p_partkey", unique=True).to_long()


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows, columns: str) -> str:
    cell = lambda x: quoted(x) if isinstance(x, str) else str(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) {columns}"


# Placement in SQL.
def hash_sql(text: str, offset: int = OFFSET_64, prime: int = PRIME_64, bits: int = 64) -> str:
    """The hash of an ASCII expression."""
    octets = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, CAST(i AS INT), 1))::HUGEINT)"
    return f"list_reduce(list_prepend({offset}::HUGEINT, {octets}), lambda h, b: (xor(h, b) * {prime}) % {1 << bits})"


def ring_sql(servers: int, name: str = "ring") -> str:
    return f"{name} AS (SELECT CAST(s AS INT) AS server_id, {hash_sql(f'label_{name}')} AS position FROM (SELECT s, 'server' || s || '_' || i AS label_{name} FROM range({servers}) a(s), range({PLACES}) b(i)))"


def nodes_sql(ring: str = "ring", name: str = "nodes") -> str:
    """Virtual nodes: the first place of the ring at or after a node's hash, else the very first."""
    prefixes = values([(i, p) for i, p in enumerate(PREFIXES)], "p(place, prefix)")
    hashed = f"(SELECT CAST(i AS INT) AS node_id, prefix, {hash_sql('label_' + name)} AS h FROM (SELECT i, prefix, 'vnode_' || i AS label_{name} FROM range({NODES}) n(i) JOIN {prefixes} ON place = i % {len(PREFIXES)}))"
    return f"{name} AS (SELECT node_id, prefix, arg_min(server_id, (position < h, position)) AS server_id FROM {hashed} v, {ring} r GROUP BY node_id, prefix)"


def owners_sql(keys: str, name: str = "owners") -> str:
    """key, node_id, server_id: the first node whose prefix starts the key."""
    return f"{name} AS (SELECT key, min(node_id) AS node_id, arg_min(server_id, node_id) AS server_id FROM ({keys}) k JOIN nodes ON starts_with(key, prefix) GROUP BY key)"


def held_sql(replicas: int, name: str = "held") -> str:
    """key, server_id: each key's own server and its replicas, the next other servers on the ring."""
    return f"""around AS (SELECT key, o.server_id AS own, r.server_id, min((position < h, position)) AS first FROM (SELECT *, {hash_sql('key')} AS h FROM owners) o, ring r GROUP BY key, own, r.server_id),
near AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY first) AS n FROM around),
others AS (SELECT key, server_id, row_number() OVER (PARTITION BY key ORDER BY first) AS n FROM near WHERE n <= {replicas + 1} AND server_id <> own),
{name} AS (SELECT key, server_id FROM owners UNION ALL SELECT key, server_id FROM others WHERE n <= {replicas})"""


NAMES = "SELECT DISTINCT p_name AS key FROM part"
SERVERS = Placement(30)  # three replicas


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("key")).distinct()


def key_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Placement(8)
    return names(spark, sf_dir).select(F.col("key").alias("p_name"), p.node_column(F.col("key")).alias("node_id"), p.server_column(F.col("key")).alias("server_id"))


def key_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("key", F.explode(SERVERS.servers_column(F.col("key"))).alias("server_id"))


def routed_queries(spark: SparkSession) -> DataFrame:
    texts = ("StageX=1*", "St*=*", "S*=x", "q*=*", "*X=1", "*age*=2", "*=*", "FILE_PATH", "**=1", "creation_date=2023*", "_*=*")
    return spark.createDataFrame([(q,) for q in texts], "query string")


def query_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed_queries(spark).select("query", F.explode(SERVERS.query_column(F.col("query"))).alias("server_id"))


QUERY_ROUTES_SQL = f"""WITH {ring_sql(30)}, {nodes_sql()},
queries AS (SELECT query, split_part(query, '=', 1) AS pattern FROM {values([('StageX=1*',), ('St*=*',), ('S*=x',), ('q*=*',), ('*X=1',), ('*age*=2',), ('*=*',), ('FILE_PATH',), ('**=1',), ('creation_date=2023*',), ('_*=*',)], 'q(query)')}),
{owners_sql("SELECT pattern AS key FROM queries WHERE NOT contains(pattern, '*')")}, {held_sql(3)},
tokens AS (SELECT query, left(pattern, length(pattern) - 1) AS token FROM queries WHERE ends_with(pattern, '*') AND (NOT starts_with(pattern, '*') OR pattern = '**'))
SELECT query, server_id FROM queries JOIN held ON key = pattern
UNION ALL SELECT DISTINCT query, server_id FROM tokens JOIN nodes ON starts_with(prefix, token) OR starts_with(token, prefix)
UNION ALL SELECT query, CAST(s AS INT) FROM queries, range(30) r(s) WHERE starts_with(pattern, '*') AND pattern <> '**'"""


def routing_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Placement(8)
    queries = spark.createDataFrame([(q,) for q in ("p_*=x", "*e=1", "p_size=7", "*rand*", "zzz=1", "*")], "query string")
    keys = spark.createDataFrame([(k,) for k in PART_KEYS], "key string")
    return trace(AdaptiveRouting(p, enabled=False).route(queries, None), keys, p)


TRACE_SQL = f"""WITH {ring_sql(8)}, {nodes_sql()}, {owners_sql("SELECT * FROM " + values([(k,) for k in PART_KEYS] + [("zzz",)], "k(key)"))}, {held_sql(1)},
sent AS (SELECT 'p_size=7' AS query, server_id FROM held WHERE key = 'p_size' UNION ALL SELECT 'zzz=1', server_id FROM held WHERE key = 'zzz'
  UNION ALL SELECT DISTINCT 'p_*=x', server_id FROM nodes WHERE starts_with(prefix, 'p_') OR starts_with('p_', prefix)
  UNION ALL SELECT query, CAST(s AS INT) FROM {values([('*e=1',), ('*rand*',), ('*',)], 'q(query)')}, range(8) r(s))
SELECT query, server_id, EXISTS (SELECT 1 FROM held h WHERE h.server_id = sent.server_id AND key <> 'zzz' AND CASE query
  WHEN 'p_size=7' THEN key = 'p_size' WHEN 'zzz=1' THEN false WHEN 'p_*=x' THEN starts_with(key, 'p_') WHEN '*e=1' THEN ends_with(key, 'e') WHEN '*rand*' THEN contains(key, 'rand') ELSE true END) AS handles FROM sent"""


def ring_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Placement(8).ring_table(spark).select("server_id", F.col("position").cast("string").alias("position"))


def server_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(s, n) for s, ns in Placement(8).by_server().items() for n in ns]
    return spark.createDataFrame(rows, "server_id int, node_id int").groupBy("server_id").agg(F.count("*").alias("n"), F.sum("node_id").cast("long").alias("total"))


def mapping_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "mapping")
    save_mapping(Placement(8), spark, path)
    return load_mapping(spark, path, 8)


# Probes, indexes of suffixes, dates.
PROBES = ("p_name", "p_", "zzz", "size", "e", "")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """has_key, has_suffix and can_handle, over wide and long data alike."""
    wide = WideStore(table(spark, sf_dir, "part"), "p_partkey", unique=True)
    long = LongStore(wide.to_long().triples)
    rows = [(p, wide.has_key(p), wide.has_suffix(p), wide.can_handle(f"*{p}=x")) for p in PROBES]
    again = [(p, long.has_key(p), long.has_suffix(p), long.can_handle(f"*{p}=x")) for p in PROBES]
    return spark.createDataFrame([("wide", *r) for r in rows] + [("long", *r) for r in again], "store string, probe string, is_key boolean, is_suffix boolean, handles boolean")


PROBES_SQL = f"""SELECT store, probe, (SELECT bool_or(key = probe) FROM k) AS is_key, (SELECT bool_or(ends_with(key, probe)) FROM k) AS is_suffix,
  (SELECT bool_or(ends_with(key, probe)) FROM k) AS handles
FROM {values([(s,) for s in ("wide", "long")], "s(store)")}, {values([(p,) for p in PROBES], "p(probe)")}"""


def trie(spark: SparkSession, sf_dir: str, query: str, keys: list[str] | None = None) -> DataFrame:
    long = WideStore(table(spark, sf_dir, "part"), "p_partkey", unique=True).to_long(keys)
    return TrieStore(long.triples.withColumn("seq", F.col(ID) * 10 + F.char_length(KEY))).search(query)


TRIE_KEY_SQL = f"""WITH t AS (SELECT *, object_id * 10 + length(key) AS seq FROM {LONG}),
nodes AS (SELECT substring(key, CAST(i AS INT)) AS node, max_by(key, seq) AS last FROM (SELECT key, max(seq) AS seq FROM t GROUP BY key), range(1, 20) r(i) WHERE i <= length(key) GROUP BY 1)
SELECT DISTINCT CAST(object_id AS BIGINT) AS object_id FROM t WHERE key IN (SELECT node FROM nodes WHERE ends_with(last, 'ype')) AND contains(value, 'ECO')"""


def day_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format("o_orderdate", "MM/dd/yyyy")
    o = table(spark, sf_dir, "orders").select("o_orderkey", as_days(text, "MM/DD/YYYY").alias("days"))
    return o.select("o_orderkey", F.col("days").cast("long").alias("days"), *(format_days(F.col("days"), f).alias(n) for n, f in (("iso", "YYYY-MM-DD"), ("us", "MM/DD/YYYY"), ("eu", "DD-MM-YYYY"))))


def parsed_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ("*", "a", "a*", "*a", "*a*", "**", "***", "a*b", "")
    return spark.createDataFrame([(t, Pattern.parse(t).kind.value, Pattern.parse(t).token, str(Pattern.parse(t))) for t in texts], "pattern string, kind string, token string, printed string")


KINDS = [("*", Kind.WILDCARD, "", "*"), ("a", Kind.EXACT, "a", "a"), ("a*", Kind.PREFIX, "a", "a*"), ("*a", Kind.SUFFIX, "a", "*a"), ("*a*", Kind.INFIX, "a", "*a*"), ("**", Kind.PREFIX, "*", "**"), ("***", Kind.INFIX, "*", "***"), ("a*b", Kind.EXACT, "a*b", "a*b"), ("", Kind.EXACT, "", "")]


# Checkpoints and files.
def text_checkpoint(spark: SparkSession, sf_dir: str, plain: bool = False) -> DataFrame:
    """Parts written as one text file a server, by their keys, and read back."""
    path, p = fresh_folder(spark, "checkpoint"), Placement(8)
    checkpoint.write_servers(parts(spark, sf_dir).triples, path, p.server_column(F.col(KEY)), plain=plain)
    return checkpoint.read_checkpoint(spark, f"{path}/*")


def native_checkpoint(spark: SparkSession, sf_dir: str, by_key: bool = True) -> DataFrame:
    path = fresh_folder(spark, "native")
    checkpoint.save(parts(spark, sf_dir).triples, path, by_key)
    return LongStore(checkpoint.load(spark, path)).matched_pairs("*e=*1*")


def server_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many objects and pairs each server's file holds."""
    return text_checkpoint(spark, sf_dir).groupBy(F.col("server").alias("server_id")).agg(F.count_distinct(ID).alias("objects"), F.count("*").alias("pairs"))


def service_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts come in, are checkpointed and half deleted; what is found before, after, and once recovered."""
    service, path = MetadataService(spark, Placement(8), parts(spark, sf_dir).triples), fresh_folder(spark, "service")
    states = [service.search("p_brand=Brand#2")]
    service.checkpoint(path)
    service.delete(service.store.triples.filter(F.col(ID) % 2 == 0))
    states.append(service.search("p_brand=Brand#2"))
    service.recover(path)
    states.append(service.search("p_brand=Brand#2"))
    service.shutdown()
    rows = [s.agg(F.count("*").alias("n"), F.sum(ID).alias("total")).select(F.lit(i).alias("state"), "n", "total") for i, s in enumerate(states)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def results_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "results")
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("Query")).agg(F.max("value").alias("StandardTime"), F.min("value").alias("AdaptiveTime"), F.count("*").cast("double").alias("Popularity"))
    results.write_results(e.withColumn("Improvement", F.lit(0.5)).withColumn("ReplicationFactor", F.lit(2)), path)
    return results.read_results(spark, path)


def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("value").alias("StandardTime"), (F.col("value") * 0.75).alias("AdaptiveTime"))
    t = workload.totals(e)
    return t.select(*(F.round(c, 3).alias(c) for c in t.columns))


def synthetic_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs the synthetic objects have by sort of key, and the ids they cover."""
    kind = F.when(F.col("key").isin(*synthetic.COMMON_KEYS), F.col("key")).otherwise("rare")
    return synthetic.objects(spark, 1000).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.min(ID).alias("least"), F.max(ID).alias("most"))


def synthetic_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = drawn(spark, Plan())
    hot = F.col("query").isin(*synthetic.HOT_PATTERNS)
    return w.agg(F.count("*").alias("n"), F.count_distinct("query").alias("patterns"), F.avg(hot.cast("int")).between(0.75, 0.85).alias("four_in_five"))


# Demo triples. The demo's pairs, which golden answers depend on.
DEMO = [
    (1001, "FILE_PATH", "/data/488nm.tif"), (1002, "FILE_PATH", "/data/561nm.tif"), (1001, "StageX", "100.00"), (1001, "StageY", "200.00"), (1001, "StageZ", "50.00"),
    (1002, "StageX", "300.00"), (1002, "StageY", "400.00"), (1002, "StageZ", "75.00"), (1001, "creation_date", "2023-05-26"), (1002, "creation_date", "2023-06-15"),
    (1001, "microscope", "LLSM-1"), (1002, "microscope", "LLSM-2"), (1001, "AUXILIARY_FILE", "/data/488nm_metadata.json"), (1002, "AUXILIARY_FILE", "/data/561nm_metadata.json"),
]


def literal_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LongStore(spark.createDataFrame(DEMO, "object_id long, key string, value string")).multi("StageX > 99 AND StageX < 250 OR *PATH = *561*")


# Popularity, routing by it, health.
def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorded(table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("=*")).alias("query"), F.col("ts").cast("timestamp").alias("ts")))


def latest(rows: DataFrame):
    return rows.agg(F.max("ts")).scalar()


def adaptive_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicas by popularity, counting only accesses after the resets: of views at one time, of all at another."""
    rows = log(spark, sf_dir)
    resets = spark.createDataFrame([("view", "2024-01-20 00:00:00"), (None, "2024-01-03 00:00:00")], "pattern string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    found = AdaptiveRouting(SERVERS, HOT).factors(since_reset(rows, resets), latest(rows))
    return found.select("pattern", F.round("popularity", 6).alias("popularity"), "accesses", "replicas")


FACTORS = """SELECT event_type AS pattern, sum(exp(-0.1 * (epoch_ms((SELECT max(ts) FROM events)) - epoch_ms(ts)) / 3600000.0)) AS popularity, count(*) AS accesses
FROM events WHERE {} GROUP BY event_type"""
AFTER_RESETS = "ts > CASE event_type WHEN 'view' THEN TIMESTAMP '2024-01-20' ELSE TIMESTAMP '2024-01-03' END"
REPLICAS = "CAST(CASE WHEN popularity < 10 THEN 1 ELSE least(1 + floor(log10(popularity / 10)), 5) END AS INT)"


def adaptive_routes(spark: SparkSession, sf_dir: str, enabled: bool = True) -> DataFrame:
    rows = log(spark, sf_dir)
    routing = AdaptiveRouting(SERVERS, HOT).toggled(enabled)
    queries = rows.select(F.concat("pattern", F.lit("=x")).alias("query")).distinct()
    return routing.routes(queries, routing.factors(rows, latest(rows)))


ADAPTIVE_ROUTES = f"""WITH {ring_sql(30)}, {nodes_sql()}, {owners_sql("SELECT DISTINCT event_type AS key FROM events")}, {held_sql(3, "every")},
f AS (SELECT pattern, {REPLICAS} AS replicas FROM ({FACTORS.format('true')}))
SELECT key || '=x' AS query, server_id FROM owners UNION ALL SELECT key || '=x', server_id FROM others JOIN f ON pattern = key WHERE n <= least(replicas, 3)"""


def adaptive_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, routing = log(spark, sf_dir), AdaptiveRouting(SERVERS, HOT)
    found = routing.statistics(routing.factors(rows, latest(rows)))
    return found.withColumn("mean_replicas", F.round("mean_replicas", 6))


def noticed_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health with notices of failure, of recovery under way and of its end, one a server in turn."""
    beats = table(spark, sf_dir, "events").select(F.col("user_id").alias("server_id"), popularity.millis(F.col("ts")).alias("timestamp"))
    kinds = F.element_at(F.array(F.lit("failed"), F.lit("recovering"), F.lit("recovered")), (F.col("server_id") % 3 + 1).cast("int"))
    found = health.health(beats, beats.agg(F.max("timestamp")).scalar(), 36_000_000, 360_000_000)
    notices = found.filter("server_id % 2 = 0").select("server_id", kinds.alias("kind"), (F.col("last_beat") + 1).alias("timestamp"))
    return health.with_notices(found, notices).select("server_id", "status")


def active_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = table(spark, sf_dir, "events").select(F.col("user_id").alias("server_id"), popularity.millis(F.col("ts")).alias("timestamp"))
    found = health.health(beats, beats.agg(F.max("timestamp")).scalar(), 36_000_000, 360_000_000)
    return health.active(found).crossJoin(health.leader(found))  # one row on the right


def client_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients that search at once, each in a session of its own, and one that left."""
    manager = ClientManager(spark)
    clients = [manager.register() for _ in range(4)]
    manager.unregister(clients[1])
    work = lambda session, c: WideStore(table(session, sf_dir, "part"), "p_partkey", unique=True).search(f"p_size={c}").count()
    found = {c: manager.submit(c, lambda s, c=c: work(s, c)) for c in manager.active()}
    rows = [(manager.name(c), f.result()) for c, f in found.items()]
    manager.close()
    return spark.createDataFrame(rows, "client string, found long")


# Streams, run over what is there and read back.
def streamed(spark: SparkSession, sf_dir: str, columns: list) -> tuple[DataFrame, str]:
    """Events as a stream of files, and a fresh folder."""
    path = fresh_folder(spark, "stream")
    table(spark, sf_dir, "events").select(*columns).repartition(4).write.parquet(f"{path}/in")
    return spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).parquet(f"{path}/in"), path


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages: users gain and lose a type, and the last message of each counts."""
    op = F.when(F.col("event_id") % 3 == 0, "delete").otherwise("insert")
    rows, path = streamed(spark, sf_dir, [F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").cast("long").alias(ID), F.lit("type").alias(KEY), F.col("event_type").alias(VALUE)])
    ingest.ingest(rows, f"{path}/store", f"{path}/state").awaitTermination()
    ingest.compact(spark, f"{path}/store")
    return ingest.current(spark, f"{path}/store")


def stream_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyed state of a stream at its last access, without the bonus."""
    rows, path = streamed(spark, sf_dir, [F.col("event_type").alias("pattern"), F.col("ts").cast("timestamp").alias("ts"), F.lit(1.0).alias("increment")])
    name = path.rpartition("/")[2].replace("-", "_")
    query = stateful.stream_popularity(rows, HOT, bonus=False).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).groupBy("pattern").agg(F.max("ms").alias("ms"), F.round(F.max_by("popularity", "ms"), 6).alias("popularity"))


def entries() -> dict[str, tuple]:
    """name: (query, SQL or None)"""
    out: dict[str, tuple] = {}
    out["key_routing"] = key_routing, f"WITH {ring_sql(8)}, {nodes_sql()}, {owners_sql(NAMES)} SELECT key AS p_name, node_id, server_id FROM owners"
    out["migration_plan"] = (lambda s, d: migration(s, Placement(8), Placement(10))), f"""WITH {ring_sql(8, 'ring_a')}, {ring_sql(10, 'ring_b')}, {nodes_sql('ring_a', 'nodes_a')}, {nodes_sql('ring_b', 'nodes_b')}
SELECT a.node_id, a.prefix, a.server_id AS from_server, b.server_id AS to_server FROM nodes_a a JOIN nodes_b b USING (node_id) WHERE a.server_id <> b.server_id"""
    out["migration_count"] = (lambda s, d: migration(s, Placement(8), Placement(9)).agg(F.count("*").alias("moved"))), f"""WITH {ring_sql(8, 'ring_a')}, {ring_sql(9, 'ring_b')}, {nodes_sql('ring_a', 'nodes_a')}, {nodes_sql('ring_b', 'nodes_b')}
SELECT count(*) AS moved FROM nodes_a a JOIN nodes_b b USING (node_id) WHERE a.server_id <> b.server_id"""
    out["ring_places"] = ring_places, f"WITH {ring_sql(8)} SELECT server_id, CAST(position AS VARCHAR) AS position FROM ring"
    out["virtual_nodes"] = (lambda s, d: Placement(8).node_table(s)), f"WITH {ring_sql(8)}, {nodes_sql()} SELECT node_id, prefix, server_id FROM nodes"
    out["server_nodes"] = server_nodes, f"WITH {ring_sql(8)}, {nodes_sql()} SELECT server_id, count(*) AS n, CAST(sum(node_id) AS BIGINT) AS total FROM nodes GROUP BY server_id"
    out["mapping_file"] = mapping_file, out["virtual_nodes"][1]
    out["hash_32"] = (lambda s, d: s.createDataFrame([(x, hash32(x)) for x in PREFIXES], "prefix string, hash long")), f"SELECT prefix, CAST({hash_sql('prefix', OFFSET_32, PRIME_32, 32)} AS BIGINT) AS hash FROM {values([(p,) for p in PREFIXES], 'p(prefix)')}"
    out["replication_by_servers"] = (lambda s, d: s.createDataFrame([(n, replication_factor(n)) for n in range(1, 60)], "servers long, replicas int")), "SELECT s AS servers, CAST(greatest(1, floor(s * 0.1)) AS INT) AS replicas FROM range(1, 60) r(s)"
    out["key_servers"] = key_servers, f"WITH {ring_sql(30)}, {nodes_sql()}, {owners_sql(NAMES)}, {held_sql(3)} SELECT key, server_id FROM held"
    out["query_routes"] = query_routes, QUERY_ROUTES_SQL
    out["routing_trace"] = routing_trace, TRACE_SQL
    out["key_probes"] = probes, f"WITH k AS (SELECT DISTINCT key FROM {LONG}) {PROBES_SQL}"
    out["pattern_kinds"] = parsed_kinds, f"SELECT * FROM {values([(p, k.value, t, s) for p, k, t, s in KINDS], 'v(pattern, kind, token, printed)')}"
    out["trie_one_character_star"] = (lambda s, d: trie(s, d, "p_name=s*all r*")), "SELECT CAST(p_partkey AS BIGINT) AS object_id FROM part WHERE regexp_matches(p_name, 's.all r')"
    out["trie_key_suffix"] = (lambda s, d: trie(s, d, "*ype=ECO*")), TRIE_KEY_SQL
    out["day_numbers"] = day_numbers, "SELECT o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS days, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%m/%d/%Y') AS us, strftime(o_orderdate, '%d-%m-%Y') AS eu FROM orders"
    out["range_as_conditions"] = (lambda s, d: WideStore(table(s, d, "lineitem"), "l_orderkey").multi(RangeQuery.parse("l_quantity in range [20 to 21]").to_conditions())), "SELECT l_orderkey AS object_id FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_quantity >= 20) AND bool_or(l_quantity <= 21)"
    out["literal_source"] = literal_source, f"SELECT CAST(object_id AS BIGINT) AS object_id FROM {values(DEMO, 't(object_id, key, value)')} GROUP BY object_id HAVING (bool_or(key = 'StageX' AND try_cast(value AS DOUBLE) > 99) AND bool_or(key = 'StageX' AND try_cast(value AS DOUBLE) < 250)) OR bool_or(ends_with(key, 'PATH') AND contains(value, '561'))"
    triple = f"SELECT object_id, key, value FROM {LONG}"
    out["text_checkpoint"] = (lambda s, d: text_checkpoint(s, d).select(ID, KEY, VALUE)), triple
    out["plain_checkpoint"] = (lambda s, d: text_checkpoint(s, d, plain=True).select(ID, KEY, VALUE)), triple
    owners = f"WITH {ring_sql(8)}, {nodes_sql()}, {owners_sql('SELECT * FROM ' + values([(k,) for k in PART_KEYS], 'k(key)'))}"
    out["server_files"] = server_files, f"{owners} SELECT server_id, count(DISTINCT object_id) AS objects, count(*) AS pairs FROM {LONG} JOIN owners USING (key) GROUP BY server_id"
    for name, by_key in (("native_checkpoint", True), ("native_checkpoint_sorted", False)):
        out[name] = (lambda s, d, b=by_key: native_checkpoint(s, d, b)), f"{triple} WHERE ends_with(key, 'e') AND contains(value, '1')"
    out["service_cycle"] = service_cycle, "SELECT CAST(s AS INT) AS state, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS total FROM part, range(3) r(s) WHERE p_brand = 'Brand#2' AND (s <> 1 OR p_partkey % 2 = 1) GROUP BY s"
    out["results_file"] = results_file, 'SELECT event_type AS "Query", max(value) AS "StandardTime", min(value) AS "AdaptiveTime", 0.5::DOUBLE AS "Improvement", 2::INT AS "ReplicationFactor", count(*)::DOUBLE AS "Popularity" FROM events GROUP BY event_type'
    out["report_totals"] = report_totals, 'SELECT round(sum(value), 3) AS "StandardTime", round(sum(value * 0.75), 3) AS "AdaptiveTime", round((sum(value) - sum(value * 0.75)) * 100 / sum(value), 3) AS "Improvement" FROM events'
    out["synthetic_shape"] = synthetic_shape, "SELECT * FROM " + values([(k, 1000, 1, 1000) for k in synthetic.COMMON_KEYS] + [("rare", 2500, 1, 1000)], "v(kind, n, least, most)")
    out["synthetic_workload"] = synthetic_workload, "SELECT 1500::BIGINT AS n, 20::BIGINT AS patterns, true AS four_in_five"
    out["adaptive_factors"] = adaptive_factors, f"SELECT pattern, round(popularity, 6) AS popularity, accesses, {REPLICAS} AS replicas FROM ({FACTORS.format(AFTER_RESETS)})"
    out["adaptive_routes"] = adaptive_routes, ADAPTIVE_ROUTES
    out["adaptive_routes_off"] = (lambda s, d: adaptive_routes(s, d, enabled=False)), f"WITH {ring_sql(30)}, {nodes_sql()}, {owners_sql('SELECT DISTINCT event_type AS key FROM events')}, {held_sql(3)} SELECT key || '=x' AS query, server_id FROM held"
    out["adaptive_statistics"] = adaptive_statistics, f"SELECT count(*) AS patterns, CAST(sum(accesses) AS BIGINT) AS accesses, count(*) FILTER (replicas > 1) AS replicated, round(avg(replicas), 6) AS mean_replicas, max(replicas) AS most_replicas, arg_max(pattern, popularity) AS most_popular, true AS enabled FROM (SELECT *, {REPLICAS} AS replicas FROM ({FACTORS.format('true')}))"
    out["health_notices"] = noticed_health, """SELECT server_id, CASE WHEN server_id % 2 = 1 THEN status WHEN server_id % 3 = 0 THEN 'CONFIRMED_DOWN' WHEN server_id % 3 = 1 THEN 'RECOVERING' ELSE 'ACTIVE' END AS status
FROM (SELECT user_id AS server_id, CASE WHEN age > 360000000 THEN 'CONFIRMED_DOWN' WHEN age > 36000000 THEN 'SUSPECT' ELSE 'ACTIVE' END AS status
FROM (SELECT user_id, (SELECT max(epoch_us(ts) // 1000) FROM events) - max(epoch_us(ts) // 1000) AS age FROM events GROUP BY user_id))"""
    out["active_servers"] = active_servers, "WITH a AS (SELECT user_id AS server_id FROM events GROUP BY user_id HAVING (SELECT max(epoch_us(ts) // 1000) FROM events) - max(epoch_us(ts) // 1000) <= 36000000) SELECT server_id, (SELECT max(server_id) FROM a) AS leader FROM a"
    out["client_sessions"] = client_sessions, "SELECT 'client-' || c AS client, (SELECT count(*) FROM part WHERE p_size = c) AS found FROM range(1, 5) r(c) WHERE c <> 2"
    out["stream_ingest"] = stream_ingest, "SELECT CAST(user_id AS BIGINT) AS object_id, 'type' AS key, event_type AS value FROM events GROUP BY user_id, event_type HAVING max(event_id) % 3 <> 0"
    out["stream_popularity"] = stream_popularity, """SELECT event_type AS pattern, max(epoch_us(ts) // 1000) AS ms, round(sum(exp(-0.1 * (last - epoch_us(ts) // 1000) / 3600000.0)), 6) AS popularity
FROM (SELECT event_type, ts, max(epoch_us(ts) // 1000) OVER (PARTITION BY event_type) AS last FROM events) GROUP BY event_type"""
    return out

