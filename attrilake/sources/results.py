"""Benchmark results as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "Query string, StandardTime double, AdaptiveTime double, Improvement double, ReplicationFactor int, Popularity double"


def write_results(results: DataFrame, path: str) -> None:
    results.select(*(c.split()[0] for c in SCHEMA.split(", "))).write.mode("overwrite").csv(path, header=True)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=SCHEMA)
