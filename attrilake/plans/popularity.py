"""Popularity of query patterns, which decays over time, and the replicas that it earns.

A log has rows (pattern, ts, increment). Decay composes, so the plain score has a closed form: a
sum that Spark combines before its shuffle. The bonus for patterns over the threshold depends on
the order of accesses and is folded over each pattern's ordered log.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR_MS = 3_600_000.0


@dataclass(frozen=True)
class Settings:
    base: int = 1
    most: int = 5
    threshold: float = 10.0
    decay: float = 0.1  # an hour


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def decay(then_ms: Column, now_ms: Column, rate: float) -> Column:
    """What remains after the hours between; 1 for a pattern never seen."""
    return F.coalesce(F.exp(-F.lit(rate) * (now_ms - then_ms) / HOUR_MS), F.lit(1.0))


def popularity(log: DataFrame, now: Column, settings: Settings = Settings()) -> DataFrame:
    """pattern, popularity at ``now`` (a timestamp), accesses and the last one."""
    term = F.col("increment") * decay(millis(F.col("ts")), millis(now), settings.decay)
    return log.groupBy("pattern").agg(F.sum(term).alias("popularity"), F.count("*").alias("accesses"), F.max("ts").alias("last_access"))


def popularity_with_bonus(log: DataFrame, now: Column, settings: Settings = Settings()) -> DataFrame:
    """pattern, popularity, where an access counts more while the stored score is over the threshold.

    The factor is 1 + log10(score / threshold). It depends on the order of accesses, so a pattern's
    log is folded in one task; ``stream_popularity`` folds logs too long for that.
    """
    access = F.struct(millis(F.col("ts")).alias("ms"), F.col("increment").cast("double").alias("increment"))
    ordered = log.groupBy("pattern").agg(F.array_sort(F.collect_list(access)).alias("log"))
    start = F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("long").alias("ms"))

    def step(state, x):
        more = F.when(state["score"] > settings.threshold, 1 + F.log10(state["score"] / settings.threshold)).otherwise(1.0)
        return F.struct((state["score"] * decay(state["ms"], x["ms"], settings.decay) + x["increment"] * more).alias("score"), x["ms"].alias("ms"))

    end = F.aggregate("log", start, step)
    return ordered.select("pattern", end.alias("s")).select("pattern", (F.col("s.score") * decay(F.col("s.ms"), millis(now), settings.decay)).alias("popularity"))


def replicas(score: Column, settings: Settings = Settings()) -> Column:
    """The base, and one more for each tenfold over the threshold, up to the most."""
    grown = settings.base + F.floor(F.log10(score / settings.threshold)).cast("int")
    return F.when(score < settings.threshold, F.lit(settings.base)).otherwise(F.least(grown, F.lit(settings.most)))


def ranked(scores: DataFrame, k: int | None = None, least: float = 0.01) -> DataFrame:
    """Patterns over ``least`` by falling popularity, ties by name; the first ``k`` if given."""
    out = scores.filter(F.col("popularity") > least).orderBy(F.desc("popularity"), "pattern")
    return out if k is None else out.limit(k)
