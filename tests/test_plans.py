"""Sources, placement, popularity, reports, health, sessions and streams."""

import datetime as dt
import json
import math
import time

import pytest
from pyspark.sql import functions as F

from attrilake.operators.store import LongStore
from attrilake.plans import health, placement, popularity, workload
from attrilake.plans.sessions import ClientManager
from attrilake.sources import checkpoint, results, synthetic
from attrilake.streaming import ingest, stateful

TRIPLES = [(7, "k", "v=1"), (7, "k", "v=1"), (8, "other key", ""), (9, "é", "ü x")]
SCHEMA = "object_id long, key string, value string"
SERVED = "ANY_INDEX_V1\n5 1\n2\n7 2\nk\nv=1\nk\nv=1\n8 1\nother key\n\n"
PLAIN = "ANY_INDEX_V1\n2\nk\nother key\n1\nkey\n2\n7 2\nk\nv=1\nk\nv=1\n8 1\nother key\n\n"


def triples(df):
    return sorted(map(tuple, df.select("object_id", "key", "value").collect()))


@pytest.mark.parametrize("text", [SERVED, PLAIN])
def test_read_checkpoint(spark, tmp_path, text):
    (tmp_path / "index.dat").write_text(text)
    assert triples(checkpoint.read_checkpoint(spark, str(tmp_path))) == TRIPLES[:3]


def test_refused_checkpoints(spark, tmp_path):
    (tmp_path / "a.dat").write_text(SERVED)
    with pytest.raises(Exception, match="of server 5"):
        checkpoint.read_checkpoint(spark, str(tmp_path), server=4).collect()
    (tmp_path / "a.dat").write_text("OTHER_V2\n1 1\n0\n")
    with pytest.raises(Exception, match="not an index"):
        checkpoint.read_checkpoint(spark, str(tmp_path)).collect()
    (tmp_path / "a.dat").write_text("ANY_INDEX_V1\n3 1\n0\n")
    assert checkpoint.read_checkpoint(spark, str(tmp_path)).isEmpty()


def test_checkpoint_round_trips(spark, tmp_path):
    df = spark.createDataFrame(TRIPLES, SCHEMA)
    checkpoint.write_checkpoint(df, f"{tmp_path}/text", server=3)
    assert triples(checkpoint.read_checkpoint(spark, f"{tmp_path}/text", server=3)) == sorted(TRIPLES)
    for by_key in (True, False):
        checkpoint.save(df, f"{tmp_path}/{by_key}", by_key)
        assert triples(checkpoint.load(spark, f"{tmp_path}/{by_key}")) == sorted(TRIPLES)
    with pytest.raises(ValueError):
        checkpoint.write_checkpoint(spark.createDataFrame([(1, "a\nb", "c")], SCHEMA), f"{tmp_path}/bad")


def test_key_folders_are_pruned(spark, tmp_path, capsys):
    checkpoint.save(spark.createDataFrame(TRIPLES, SCHEMA), f"{tmp_path}/s")
    LongStore(checkpoint.load(spark, f"{tmp_path}/s")).search("oth*=*").explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "StartsWith(key" in plan.replace(" ", "") or "startswith(key" in plan.lower().replace(" ", "")


def test_results_csv(spark, tmp_path):
    df = spark.createDataFrame([("StageX=*", 2.0, 1.0, 50.0, 1, 3.5)], results.SCHEMA)
    results.write_results(df, f"{tmp_path}/r")
    assert results.read_results(spark, f"{tmp_path}/r").collect() == df.collect()
    total = workload.totals(df).first()
    assert (total.StandardTime, total.AdaptiveTime, total.Improvement) == (2.0, 1.0, 50.0)


def test_synthetic(spark):
    md = synthetic.objects(spark, 200, seed=3)
    assert md.count() == 200 * 5 + 100 * 2 + 100 * 3
    assert triples(md) == triples(synthetic.objects(spark, 200, seed=3).repartition(7))
    assert triples(md) != triples(synthetic.objects(spark, 200, seed=4))
    w = synthetic.workload(spark, 2000, 0.8, seed=1)
    hot = w.filter(F.col("pattern").isin(*synthetic.HOT_PATTERNS)).count()
    assert 1500 < hot < 1700 and w.select("pattern").distinct().count() == 20


def test_placement(spark, tmp_path):
    p = placement.Placement(8)
    assert p.nodes == placement.Placement(8).nodes and len(p.nodes) == 256 and len(p.ring) == 320
    assert {s for _, _, s in p.nodes} <= set(range(8)) and p.replicas == 1
    assert sorted(n for ns in p.by_server().values() for n in ns) == list(range(256))
    for key in ("StageX", "FILE_PATH", "été", "", "_x"):
        servers = p.servers_of(key)
        assert len(servers) == len(set(servers)) <= p.replicas + 1
        assert servers[0] in p.for_query(f"{key[:1]}*=x") and set(servers) <= set(range(8))
        assert p.adaptive_servers_of(key, 0) == servers[:1]
    assert p.for_query("*ATH=x") == p.for_query("*=x") == list(range(8))
    keys = spark.createDataFrame([(k,) for k in ("StageX", "zeta", "été", "", "9", "#a")], "k string")
    for r in keys.select("k", p.node_column(F.col("k")).alias("n"), p.server_column(F.col("k")).alias("s")).collect():
        assert (r.n, r.s) == (p.node_of(r.k), p.nodes[p.node_of(r.k)][2])
    moved = placement.migration(spark, p, placement.Placement(9)).collect()
    assert len(moved) == sum(a[2] != b[2] for a, b in zip(p.nodes, placement.Placement(9).nodes, strict=True)) and 0 < len(moved) < 256
    placement.save_mapping(p, spark, f"{tmp_path}/m")
    assert [tuple(r) for r in placement.load_mapping(spark, f"{tmp_path}/m", 8).orderBy("node_id").collect()] == p.nodes
    with pytest.raises(ValueError):
        placement.load_mapping(spark, f"{tmp_path}/m", 9)
    assert p.ring_table(spark).count() == 320 and placement.replication_factor(25) == 2


def test_hashes():
    assert placement.hash64("") == 14695981039346656037 and placement.hash32("a") == 0xE40C292C and placement.hash64("a") == 0xAF63DC4C8601EC8C


def log_of(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("hot", start + dt.timedelta(minutes=7 * i), 1.0) for i in range(60)] + [("cold", start, 1.0), ("cold", start + dt.timedelta(hours=5), 2.0)]
    return rows, spark.createDataFrame(rows, "pattern string, ts timestamp, increment double"), start + dt.timedelta(hours=10)


def fold(rows, end, settings, bonus):
    scores = {}
    for pattern, ts, inc in sorted(rows, key=lambda r: r[1]):
        score, last = scores.get(pattern, (0.0, ts))
        more = 1 + math.log10(score / settings.threshold) if bonus and score > settings.threshold else 1.0
        scores[pattern] = score * math.exp(-settings.decay * (ts - last).total_seconds() / 3600) + inc * more, ts
    return {p: s * math.exp(-settings.decay * (end - t).total_seconds() / 3600) for p, (s, t) in scores.items()}


def test_popularity(spark):
    rows, log, end = log_of(spark)
    settings = popularity.Settings()
    for bonus, of in ((False, popularity.popularity), (True, popularity.popularity_with_bonus)):
        got = {r.pattern: r.popularity for r in of(log, F.lit(end), settings).collect()}
        assert got == pytest.approx(fold(rows, end, settings, bonus))
    ranked = popularity.ranked(popularity.popularity(log, F.lit(end), settings)).collect()
    assert [r.pattern for r in ranked] == ["hot", "cold"] and popularity.ranked(popularity.popularity(log, F.lit(end)), 1).count() == 1
    scores = spark.createDataFrame([(0.5,), (10.0,), (99.0,), (100.0,), (1e9,)], "s double")
    assert [r[0] for r in scores.select(popularity.replicas(F.col("s"))).collect()] == [1, 1, 1, 2, 5]


def test_health(spark):
    beats = spark.createDataFrame([(1, 10_000), (1, 4_000), (2, 7_000), (3, 1_000)], "server_id long, timestamp long")
    got = health.health(beats, F.lit(10_000))
    assert {r.server_id: r.status for r in got.collect()} == {1: "ACTIVE", 2: "SUSPECT", 3: "CONFIRMED_DOWN"}
    assert health.leader(got).first()[0] == 1


def test_clients_run_at_once(spark):
    manager = ClientManager(spark)
    jobs = {}
    for c in range(5):
        rows = [(2000 + 100 * c + i, k, v) for i in (1, 2) for k, v in (("StageX", f"{100 + 200 * (i - 1) + 10 * c}.000000"), ("client_id", str(c)))]
        number = manager.register()
        jobs[c] = manager.submit(number, lambda s, rows=rows, c=c: [r[0] for r in LongStore(s.createDataFrame(rows, SCHEMA)).search(f"StageX={300 + 10 * c}.000000").collect()])
    assert [j.result(timeout=120) for j in jobs.values()] == [[2002 + 100 * c] for c in range(5)]
    assert len(manager.active()) == 5 and manager.unregister(1) and not manager.is_valid(1) and not manager.unregister(1)
    manager.close()


def stream(spark, path, schema):
    return spark.readStream.schema(schema).json(str(path))


def put(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_stream_ingest(spark, tmp_path):
    source = tmp_path / "in"
    message = lambda seq, op, i: {"seq": seq, "op": op, "object_id": i, "key": "k", "value": "v"}
    put(source, "a.json", [message(1, "insert", 1), message(2, "insert", 2), message(3, "delete", 2)])
    for _ in range(2):
        ingest.ingest(stream(spark, source, ingest.SCHEMA), f"{tmp_path}/store", f"{tmp_path}/c").awaitTermination()
        put(source, "b.json", [message(5, "insert", 2), message(4, "delete", 2), message(6, "delete", 1), message(7, "insert", 3)])
    assert sorted(r.object_id for r in ingest.current(spark, f"{tmp_path}/store").collect()) == [2, 3]


def test_stream_popularity(spark, tmp_path):
    rows, _, end = log_of(spark)
    put(tmp_path / "in", "a.json", [{"pattern": p, "ts": t.isoformat(), "increment": i} for p, t, i in rows])
    log = stream(spark, tmp_path / "in", "pattern string, ts timestamp, increment double")
    query = stateful.stream_popularity(log).writeStream.format("memory").queryName("popular").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    settings = popularity.Settings()
    got = {r.pattern: r.popularity * math.exp(-settings.decay * (end - dt.datetime.fromtimestamp(r.ms / 1000, dt.timezone.utc).replace(tzinfo=None)).total_seconds() / 3600) for r in spark.table("popular").collect()}
    assert got == pytest.approx(fold(rows, end, settings, True))


def test_stream_health(spark, tmp_path):
    put(tmp_path / "in", "a.json", [{"server_id": 1, "timestamp": 1000}, {"server_id": 1, "timestamp": 900}])
    beats = stream(spark, tmp_path / "in", "server_id long, timestamp long")
    query = stateful.stream_health(beats, 300, 600).writeStream.format("memory").queryName("healthy").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").start()
    deadline, seen = time.time() + 60, []
    while time.time() < deadline and (not seen or seen[-1] != "CONFIRMED_DOWN"):
        put(tmp_path / "in", f"{time.time()}.json", [{"server_id": 2, "timestamp": int(1000 * time.time())}])
        time.sleep(1)
        seen = [r.status for r in spark.table("healthy").filter("server_id = 1").collect()]
    query.stop()
    assert seen == ["ACTIVE", "SUSPECT", "CONFIRMED_DOWN"]
    assert spark.table("healthy").filter("server_id = 1").first().last_beat == 1000


def test_windows(spark):
    rows, log, _ = log_of(spark)
    assert stateful.windowed_accesses(log, "1 hour").filter("pattern = 'hot'").agg(F.sum("increments")).first()[0] == 60


def test_placement_as_expressions(spark):
    p = placement.Placement(30)
    keys = ["StageX", "zeta", "été", "", "9", "#a", "日本", "FILE_PATH"]
    frame = spark.createDataFrame([(k,) for k in keys], "k string")
    for r in frame.select("k", placement.hash64_column(F.col("k")).alias("h"), p.servers_column(F.col("k")).alias("s"), p.servers_column(F.col("k"), F.lit(1)).alias("one")).collect():
        assert (int(r.h), r.s, r.one) == (placement.hash64(r.k), p.servers_of(r.k), p.adaptive_servers_of(r.k, 1))
    queries = ["StageX=1", "St*=*", "*age*", "*", "**=1", "x", "=1", "*x=", "_*"]
    frame = spark.createDataFrame([(q,) for q in queries], "q string")
    for r in frame.select("q", p.query_column(F.col("q")).alias("s")).collect():
        assert sorted(r.s) == sorted(p.for_query(r.q)), r.q


def test_places_at_the_ring_s_own_positions(spark):
    p = placement.Placement(3)
    keys = [f"server{s}_{i}" for s in range(3) for i in range(placement.PLACES)] + [f"k{i}" for i in range(60)]
    got = {r.k: r.at for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", p.place_column(F.col("k")).alias("at")).collect()}
    assert got == {k: p._place(k) for k in keys} and {0, len(p.ring) - 1} <= set(got.values())


def test_routes_place_distinct_queries_only(spark, sf_dir):
    from attrilake.plans import adaptive, catalog

    for name in ("adaptive_routes", "adaptive_routes_off"):
        plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" in plan and not [line for line in plan.splitlines() if " Filter " in f" {line}" and "aggregate(" in line], name
    queries = spark.createDataFrame([("a=1",), ("St*=1",), ("*x",)], "query string")
    factors = spark.createDataFrame([("a", 2)], "pattern string, replicas int")
    for routing in (adaptive.AdaptiveRouting(placement.Placement(30)), adaptive.AdaptiveRouting(placement.Placement(30), enabled=False)):
        sent = sorted((r.query, s) for r in routing.route(queries, factors).collect() for s in r.servers)
        assert sorted(map(tuple, routing.routes(queries, factors).collect())) == sent and len(sent) > 32


def test_one_text_file_a_server(spark, tmp_path):
    df, p = spark.createDataFrame(TRIPLES, SCHEMA), placement.Placement(4)
    for plain in (False, True):
        checkpoint.write_servers(df, f"{tmp_path}/{plain}", p.server_column(F.col("key")), plain=plain)
        files = list(tmp_path.glob(f"{plain}/server=*/part-*"))
        assert len(files) == len({p.nodes[p.node_of(k)][2] for _, k, _ in TRIPLES})
        assert triples(checkpoint.read_checkpoint(spark, f"{tmp_path}/{plain}/*")) == sorted(TRIPLES)
    checkpoint.write_checkpoint(df.limit(0), f"{tmp_path}/none", server=2)
    assert checkpoint.read_checkpoint(spark, f"{tmp_path}/none/*", server=2).isEmpty()


def test_benchmark(spark):
    from attrilake.plans import adaptive, benchmark

    plan = benchmark.Plan(objects=50, warm_up=40, timed=12, seed=2)
    routing = adaptive.AdaptiveRouting(placement.Placement(30), popularity.Settings(threshold=0.5))
    runs, factors = benchmark.run(spark, routing, plan)
    assert runs.count() == 24 and runs.filter("run = 0 AND millis > 0").count() == 12
    rows = benchmark.report(runs, factors).collect()
    assert {r.Query for r in rows} == {r.query for r in runs.select("query").distinct().collect()}
    assert all(1 <= r.ReplicationFactor <= 5 and r.Popularity > 0 for r in rows) and max(r.ReplicationFactor for r in rows) > 1
    wide = runs.groupBy("query").pivot("run", [0, 1]).agg(F.max("servers")).collect()
    assert all(r["0"] >= 1 and r["1"] >= 1 for r in wide)


def test_compaction_changes_no_triple(spark, tmp_path):
    from attrilake.streaming import ingest

    schema = "seq long, op string, object_id long, key string, value string"
    batches = [[(1, "insert", 1, "k", "a"), (2, "insert", 2, "k", "b")], [(3, "delete", 1, "k", "a"), (4, "insert", 3, "k", "c")], [(5, "insert", 1, "k", "a"), (6, "delete", 2, "k", "b")]]
    for i, rows in enumerate(batches):
        ingest.last_messages(spark.createDataFrame(rows, schema)).write.parquet(f"{tmp_path}/s/batch={i}")
    want = sorted(map(tuple, ingest.current(spark, f"{tmp_path}/s").collect()))
    assert want == [(1, "k", "a"), (3, "k", "c")]
    ingest.compact(spark, f"{tmp_path}/s")
    assert sorted(map(tuple, ingest.current(spark, f"{tmp_path}/s").collect())) == want
    assert [f.name for f in (tmp_path / "s").iterdir() if f.name.startswith("batch")] == ["batch=2"]


def test_service(spark, tmp_path):
    from attrilake.plans.service import MetadataService

    service = MetadataService(spark, placement.Placement(4))
    service.create(spark.createDataFrame(TRIPLES, SCHEMA))
    service.checkpoint(f"{tmp_path}/c")
    service.delete(spark.createDataFrame(TRIPLES[:1], SCHEMA))
    assert service.search("k").isEmpty() and service.search("other key").count() == 1
    own = placement.Placement(4).nodes[placement.Placement(4).node_of("k")][2]
    service.recover(f"{tmp_path}/c", server=own)
    assert triples(service.store.triples)[:2] == TRIPLES[:2]
    service.recover(f"{tmp_path}/c")
    assert triples(service.store.triples) == sorted(TRIPLES)
    service.shutdown()
    with pytest.raises(RuntimeError):
        service.search("k")
