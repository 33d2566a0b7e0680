"""Keyed state over streams: popularity of patterns, and servers' health."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from attrilake.plans.health import DOWN_MS, SUSPECT_MS
from attrilake.plans.popularity import HOUR_MS, Settings, millis


def folded(score: float, last_ms: int | None, ms: int, increment: float, settings: Settings, bonus: bool) -> float:
    """The score after an access at ``ms``."""
    more = 1 + math.log10(score / settings.threshold) if bonus and score > settings.threshold else 1.0
    faded = 1.0 if last_ms is None else math.exp(-settings.decay * (ms - last_ms) / HOUR_MS)
    return score * faded + increment * more


def stream_popularity(log: DataFrame, settings: Settings = Settings(), bonus: bool = True) -> DataFrame:
    """pattern, popularity, ms after each batch's accesses of a stream (pattern, ts, increment).

    An access that comes late counts as if at the last one's time.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        score, last = state.get if state.exists else (0.0, None)
        rows = pd.concat(list(frames)).sort_values("ms")
        for ms, increment in zip(rows["ms"], rows["increment"], strict=True):
            ms = int(ms) if last is None else max(last, int(ms))
            score, last = folded(score, last, ms, float(increment), settings, bonus), ms
        state.update((score, last))
        yield pd.DataFrame({"pattern": [key[0]], "popularity": [score], "ms": [last]})

    rows = log.select("pattern", millis(F.col("ts")).alias("ms"), F.col("increment").cast("double").alias("increment"))
    return rows.groupBy("pattern").applyInPandasWithState(update, "pattern string, popularity double, ms long", "score double, ms long", "update", GroupStateTimeout.NoTimeout)


def stream_health(beats: DataFrame, suspect_ms: int = SUSPECT_MS, down_ms: int = DOWN_MS) -> DataFrame:
    """server_id, last_beat, status as they change, from a stream (server_id, timestamp in ms).

    Without beats a server turns SUSPECT after the first limit and CONFIRMED_DOWN after the second,
    by processing time; a beat makes it ACTIVE again unless it is confirmed down.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, last = state.get if state.exists else ("ACTIVE", 0)
        if state.hasTimedOut:
            status = "CONFIRMED_DOWN" if status == "SUSPECT" else "SUSPECT"
        else:
            last = max(last, int(pd.concat(list(frames))["timestamp"].max()))
            status = status if status == "CONFIRMED_DOWN" else "ACTIVE"
        state.update((status, last))
        if status == "ACTIVE":
            state.setTimeoutDuration(suspect_ms)
        elif status == "SUSPECT":
            state.setTimeoutDuration(max(1, down_ms - suspect_ms))
        yield pd.DataFrame({"server_id": [key[0]], "last_beat": [last], "status": [status]})

    return beats.groupBy("server_id").applyInPandasWithState(update, "server_id long, last_beat long, status string", "status string, last long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_accesses(log: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Accesses by pattern and window of event time; what comes later than ``late`` is left out."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width), "pattern").agg(F.sum("increment").alias("increments"))
