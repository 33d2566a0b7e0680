"""Servers by the age of their last heartbeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUSPECT_MS, DOWN_MS = 2000, 5000


def status(age_ms: Column, suspect_ms: int = SUSPECT_MS, down_ms: int = DOWN_MS) -> Column:
    """ACTIVE, SUSPECT beyond the first limit, CONFIRMED_DOWN beyond the second."""
    return F.when(age_ms > down_ms, "CONFIRMED_DOWN").when(age_ms > suspect_ms, "SUSPECT").otherwise("ACTIVE")


def health(beats: DataFrame, now_ms: Column, suspect_ms: int = SUSPECT_MS, down_ms: int = DOWN_MS) -> DataFrame:
    """server_id, last_beat, status from beats (server_id, timestamp in ms)."""
    last = beats.groupBy("server_id").agg(F.max("timestamp").alias("last_beat"))
    return last.withColumn("status", status(now_ms - F.col("last_beat"), suspect_ms, down_ms))


def leader(statuses: DataFrame) -> DataFrame:
    """The highest server that is active: one row, null if none is."""
    return statuses.filter(F.col("status") == "ACTIVE").agg(F.max("server_id").alias("leader"))


def active(statuses: DataFrame) -> DataFrame:
    """server_id of the servers that are active, in order."""
    return statuses.filter(F.col("status") == "ACTIVE").select("server_id").orderBy("server_id")


#: What a notice makes of a server.
NOTICES = {"failed": "CONFIRMED_DOWN", "recovering": "RECOVERING", "recovered": "ACTIVE"}


def with_notices(statuses: DataFrame, notices: DataFrame) -> DataFrame:
    """``statuses`` where the last notice (server_id, kind, timestamp) after the last beat decides; kinds are those of NOTICES."""
    last = notices.groupBy("server_id").agg(F.max_by("kind", "timestamp").alias("kind"), F.max("timestamp").alias("noticed"))
    told = F.create_map(*(F.lit(x) for pair in NOTICES.items() for x in pair))
    rows = statuses.join(last, "server_id", "left")
    said = F.when(F.col("noticed") > F.col("last_beat"), F.try_element_at(told, F.col("kind")))
    return rows.select("server_id", "last_beat", F.coalesce(said, "status").alias("status"))
