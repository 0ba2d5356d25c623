"""Tumbling windows kept in a state table and closed by the wall clock, and by watermark."""

from __future__ import annotations

import threading
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipequery.plans.session import SQLRunner


def utc_now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S.%f")


class TumblingManager:
    """Collects closed windows by one statement, writes them, deletes them by another; both see the same now()."""

    def __init__(self, runner: SQLRunner, collect_sql: str, delete_sql: str, sink, poll_seconds: float = 10, lock: threading.RLock | None = None):
        self.runner, self.collect_sql, self.delete_sql, self.sink = runner, collect_sql, delete_sql, sink
        self.poll_seconds, self.lock, self.stopped, self.thread = poll_seconds, lock or threading.RLock(), threading.Event(), None
        self.error: Exception | None = None

    def collect_closed(self, now: str | None = None) -> DataFrame:
        return self.runner.run(self.collect_sql, now or utc_now())

    def delete_closed(self, now: str | None = None) -> int:
        return self.runner.run(self.delete_sql, now or utc_now()).first()[0]

    def poll(self, now: str | None = None) -> int:
        """One round; how many rows were deleted. Windows are deleted after they are written, so a failure writes them again."""
        now = now or utc_now()
        with self.lock:
            closed = self.collect_closed(now).persist()
            try:
                if closed.isEmpty():
                    return 0
                self.sink.write(closed)
                return self.delete_closed(now)
            finally:
                closed.unpersist()

    def start(self) -> TumblingManager:
        def loop():
            while not self.stopped.wait(self.poll_seconds):
                try:
                    self.poll()
                except Exception as e:  # kept for whoever stops the manager
                    self.error = e
                    return

        self.thread = threading.Thread(target=loop, daemon=True)
        self.thread.start()
        return self

    def stop(self, drain: bool = True) -> None:
        """End the rounds; ``drain`` closes what is due once more."""
        self.stopped.set()
        if self.thread:
            self.thread.join()
        if self.error:
            raise self.error
        if drain:
            self.poll()


def tumbling_counts(events: DataFrame, at: str, width: str, keys: list[str], delay: str | None = None, aggregates: list[Column] | None = None) -> DataFrame:
    """Aggregates of each window and key. With ``delay``, a watermark: in append mode each window is given once, later rows are left out."""
    rows = events.withWatermark(at, delay) if delay else events
    return rows.groupBy(F.window(at, width).alias("w"), *keys).agg(*(aggregates or [F.count("*").alias("n")])).select(F.col("w.start").alias("bucket"), "*").drop("w")
