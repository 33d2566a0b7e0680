"""The benchmark of the query mix: a warm-up, drawn queries timed with and without adaptation, reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrilake.operators.store import LongStore
from attrilake.plans import workload
from attrilake.plans.adaptive import AdaptiveRouting, key_part, recorded
from attrilake.plans.popularity import Settings
from attrilake.sources import synthetic

RUNS = "run int, seq long, query string, millis double, servers int"


@dataclass(frozen=True)
class Plan:
    """How many objects, warm-up and timed queries there are, and the share of hot ones; the basic variant."""

    objects: int = 1000
    warm_up: int = 500
    timed: int = 1000
    hot: float = 0.8
    seed: int = 0


#: The complete variant's queries and settings.
COMPLETE, COMPLETE_SETTINGS = Plan(hot=0.9), Settings(base=1, most=5, threshold=5.0, decay=0.05)


def drawn(spark: SparkSession, plan: Plan) -> DataFrame:
    """seq, query, ts: warm-up and timed queries, a second apart."""
    rows = synthetic.workload(spark, plan.warm_up + plan.timed, plan.hot, plan.seed)
    return rows.select("seq", F.col("pattern").alias("query"), F.timestamp_seconds(F.col("seq") + 1_704_067_200).alias("ts"))


def run(spark: SparkSession, routing: AdaptiveRouting, plan: Plan = Plan()) -> tuple[DataFrame, DataFrame]:
    """Times (RUNS, run 0 standard and 1 adaptive) of the timed queries, and the factors at their end.

    The log of the warm-up and of the run decides the adaptive servers; the searches themselves are
    one and the same plan, as Spark has no servers to spare.
    """
    store = LongStore(synthetic.objects(spark, plan.objects, plan.seed).cache())
    queries = drawn(spark, plan)
    log = recorded(queries)
    factors = routing.factors(log, log.agg(F.max("ts")).scalar())
    timed = queries.filter(F.col("seq") >= plan.warm_up)
    order = [r["query"] for r in timed.orderBy("seq").select("query").collect()]  # plan.timed rows
    rows = []
    for number, router in enumerate((routing.toggled(False), routing)):
        servers = {r["query"]: len(r["servers"]) for r in router.route(timed.select("query").distinct(), factors).collect()}
        for seq, query in enumerate(order):
            millis, _ = workload.timed(lambda q=query: store.search(q).collect())
            rows.append((number, seq, query, millis, servers[query]))
    return spark.createDataFrame(rows, RUNS), factors


def report(runs: DataFrame, factors: DataFrame) -> DataFrame:
    """The benchmark's rows: Query, StandardTime, AdaptiveTime, Improvement, ReplicationFactor, Popularity."""
    by = lambda n: runs.filter(F.col("run") == n).select("query", "millis")
    rows = workload.compared(by(0), by(1), factors.select("pattern", "popularity", "replicas").join(runs.select("query").distinct().withColumn("pattern", key_part(F.col("query"))), "pattern").select(F.col("query").alias("pattern"), "popularity", "replicas"))
    return rows.select(F.col("query").alias("Query"), "StandardTime", "AdaptiveTime", "Improvement", F.col("replicas").cast("int").alias("ReplicationFactor"), F.col("popularity").alias("Popularity"))
