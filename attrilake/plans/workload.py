"""Reports over timed queries: totals, means, improvement, trend."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timed(action) -> tuple[float, object]:
    """Milliseconds that an action took, and what it gave."""
    start = time.perf_counter()
    out = action()
    return 1000 * (time.perf_counter() - start), out


def improvement(standard: Column, adaptive: Column) -> Column:
    """Percent that the second is faster than the first; null where the first is 0."""
    return F.try_divide((standard - adaptive) * 100, standard)


def mean_by_query(runs: DataFrame, query: str = "query", millis: str = "millis") -> DataFrame:
    return runs.groupBy(F.col(query).alias("query")).agg(F.avg(millis).alias("avg_millis"), F.sum(millis).alias("total_millis"), F.count("*").alias("runs"))


def compared(standard: DataFrame, adaptive: DataFrame, popularity: DataFrame) -> DataFrame:
    """Results by query, most popular first and those without popularity last."""
    a = mean_by_query(standard).select("query", F.col("avg_millis").alias("StandardTime"))
    b = mean_by_query(adaptive).select("query", F.col("avg_millis").alias("AdaptiveTime"))
    rows = a.join(b, "query").join(popularity.withColumnRenamed("pattern", "query"), "query", "left")
    rows = rows.withColumn("Improvement", improvement(F.col("StandardTime"), F.col("AdaptiveTime")))
    return rows.orderBy(F.desc_nulls_last("popularity"), "query")


def by_factor(results: DataFrame) -> DataFrame:
    """Means by replication factor."""
    return results.groupBy("ReplicationFactor").agg(*(F.avg(c).alias(c) for c in ("StandardTime", "AdaptiveTime", "Improvement", "Popularity")))


def trend(results: DataFrame, y: str, x: str) -> DataFrame:
    """Slope and intercept of y over x, in one pass."""
    return results.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def totals(results: DataFrame) -> DataFrame:
    sums = results.agg(F.sum("StandardTime").alias("StandardTime"), F.sum("AdaptiveTime").alias("AdaptiveTime"))
    return sums.withColumn("Improvement", improvement(F.col("StandardTime"), F.col("AdaptiveTime")))
