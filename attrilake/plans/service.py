"""One object for a store's life: inserts, deletes, searches, checkpoints, recovery, shutdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrilake.operators.store import ID, KEY, VALUE, LongStore
from attrilake.plans.placement import Placement
from attrilake.sources import checkpoint

TRIPLE = f"{ID} long, {KEY} string, {VALUE} string"


class MetadataService:
    """Holds an immutable store and replaces it at each change, so running queries see the state they began with."""

    def __init__(self, spark: SparkSession, placement: Placement, triples: DataFrame | None = None, suffix_mode: bool = True):
        self.spark, self.placement, self.suffix_mode = spark, placement, suffix_mode
        self.store = LongStore(spark.createDataFrame([], TRIPLE) if triples is None else triples)
        self.running = True

    def _needs_running(self) -> None:
        if not self.running:
            raise RuntimeError("the service was shut down")

    def create(self, triples: DataFrame) -> None:
        self._needs_running()
        self.store = self.store.insert(triples)

    def delete(self, triples: DataFrame) -> None:
        self._needs_running()
        self.store = self.store.delete(triples)

    def search(self, query: str) -> DataFrame:
        self._needs_running()
        return self.store.search(query, self.suffix_mode)

    def checkpoint(self, path: str) -> None:
        """One text file a server, by the keys' own servers."""
        self._needs_running()
        checkpoint.write_servers(self.store.triples, path, self.placement.server_column(F.col(KEY)), self.suffix_mode)

    def recover(self, path: str, server: int | None = None) -> None:
        """The state of a checkpoint, or of one server's part of it, instead of the present one."""
        self._needs_running()
        part = "*" if server is None else f"server={server}"
        self.store = LongStore(checkpoint.read_checkpoint(self.spark, f"{path}/{part}", server))

    def shutdown(self) -> None:
        self.running = False
