"""Concurrent clients: each has a session of its own over the shared data, and runs in a pool."""

from __future__ import annotations

import itertools
import threading
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import SparkSession


class ClientManager:
    """Registers clients and runs their work; datasets are immutable, so each query sees one state."""

    def __init__(self, spark: SparkSession, workers: int = 8):
        self._spark, self._lock, self._numbers = spark, threading.Lock(), itertools.count(1)
        self._clients: dict[int, tuple[str, SparkSession]] = {}
        self._pool = ThreadPoolExecutor(workers)

    def register(self, name: str = "") -> int:
        with self._lock:
            number = next(self._numbers)
            self._clients[number] = (name or f"client-{number}", self._spark.newSession())
            return number

    def unregister(self, number: int) -> bool:
        with self._lock:
            return self._clients.pop(number, None) is not None

    def is_valid(self, number: int) -> bool:
        return number in self._clients

    def name(self, number: int) -> str:
        return self._clients[number][0]

    def active(self) -> list[int]:
        with self._lock:
            return sorted(self._clients)

    def submit(self, number: int, work) -> Future:
        """Run ``work(session)`` in the pool, in the client's session."""
        _, session = self._clients[number]
        return self._pool.submit(work, session)

    def close(self) -> None:
        self._pool.shutdown()
