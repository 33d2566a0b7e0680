"""Routing that follows popularity, as DataFrames over the log of queries.

Every query is recorded under its key part. Popular keys earn replicas; a query of an exact key is
then sent to its own server and to as many replicas, all others go where placement sends them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrilake.plans.placement import Placement
from attrilake.plans.popularity import Settings, popularity, replicas


def key_part(query: Column) -> Column:
    return F.substring_index(query, "=", 1)


def recorded(queries: DataFrame) -> DataFrame:
    """The log (pattern, ts, increment) that queries (query, ts) leave."""
    return queries.select(key_part(F.col("query")).alias("pattern"), "ts", F.lit(1.0).alias("increment"))


def since_reset(log: DataFrame, resets: DataFrame) -> DataFrame:
    """What a log (pattern, ts, ..) holds after the last of ``resets`` (pattern, ts); a null pattern resets all."""
    last = resets.groupBy("pattern").agg(F.max("ts").alias("reset"))
    every = last.filter("pattern IS NULL").agg(F.max("reset")).scalar()
    rows = log.join(last.filter("pattern IS NOT NULL"), "pattern", "left")
    return rows.filter(F.coalesce(F.col("ts") > F.greatest("reset", every), F.lit(True))).drop("reset")


@dataclass(frozen=True)
class AdaptiveRouting:
    placement: Placement
    settings: Settings = Settings()
    enabled: bool = True

    def toggled(self, enabled: bool) -> AdaptiveRouting:
        """The same with adaptation on or off; placement and log stay as they are."""
        return replace(self, enabled=enabled)

    def factors(self, log: DataFrame, now: Column) -> DataFrame:
        """pattern, popularity, accesses, last_access, replicas."""
        found = popularity(log, now, self.settings)
        return found.withColumn("replicas", replicas(F.col("popularity"), self.settings) if self.enabled else F.lit(self.settings.base))

    def _sent(self, queries: DataFrame, factors: DataFrame | None) -> tuple[DataFrame, Column]:
        """``queries``, with their factors where those count, and the servers of each as an expression."""
        if not self.enabled:
            return queries, self.placement.query_column(F.col("query"))
        rows = queries.withColumn("pattern", key_part(F.col("query"))).join(factors.select("pattern", "replicas"), "pattern", "left")
        return rows, self.placement.query_column(F.col("query"), F.coalesce("replicas", F.lit(self.settings.base)))

    def route(self, queries: DataFrame, factors: DataFrame | None) -> DataFrame:
        """``queries`` with ``servers``: where each is sent."""
        rows, servers = self._sent(queries, factors)
        return rows.withColumn("servers", servers).drop("pattern", "replicas")

    def routes(self, queries: DataFrame, factors: DataFrame | None) -> DataFrame:
        """query, server_id: one row for each server that a query is sent to.

        Of an exploded column Spark infers a filter and moves it below a ``distinct`` of the queries,
        where it would place every row of the log; of an exploded expression it infers none.
        """
        rows, servers = self._sent(queries, factors)
        return rows.select("query", F.explode(servers).alias("server_id"))

    def statistics(self, factors: DataFrame) -> DataFrame:
        """One row: patterns, accesses, patterns with more than the base, the mean and the most replicas, and the most popular."""
        hot = F.col("replicas") > self.settings.base
        return factors.agg(
            F.count("*").alias("patterns"), F.coalesce(F.sum("accesses"), F.lit(0)).alias("accesses"), F.count_if(hot).alias("replicated"),
            F.avg("replicas").alias("mean_replicas"), F.max("replicas").alias("most_replicas"), F.max_by("pattern", F.struct("popularity", "pattern")).alias("most_popular"),
        ).withColumn("enabled", F.lit(self.enabled))


def fits(key: Column, pattern: Column) -> Column:
    """Whether a key fits a key pattern, both columns."""
    inner = lambda a, b: F.substring(pattern, F.lit(a), F.char_length(pattern) - b)
    starts, ends = pattern.startswith("*"), pattern.endswith("*")
    return (
        F.when(pattern == "*", F.lit(True)).when(starts & ends & (F.char_length(pattern) > 2), F.contains(key, inner(2, 2)))
        .when(ends, F.startswith(key, inner(1, 1))).when(starts, F.endswith(key, inner(2, 1))).otherwise(key == pattern)
    )


def trace(routed: DataFrame, keys: DataFrame, placement: Placement) -> DataFrame:
    """query, server_id, handles: each server that a query is sent to, and whether it holds a key that fits.

    ``keys`` (key) are the distinct keys of the data; a server holds its own keys and its replicas.
    """
    held = keys.select("key", F.explode(placement.servers_column(F.col("key"))).alias("server_id")).distinct()
    by_server = held.groupBy("server_id").agg(F.collect_set("key").alias("keys"))
    sent = routed.select("query", F.explode("servers").alias("server_id")).distinct()
    handles = F.exists(F.coalesce("keys", F.array().cast("array<string>")), lambda k: fits(k, key_part(F.col("query"))))
    return sent.join(by_server, "server_id", "left").select("query", "server_id", handles.alias("handles"))
