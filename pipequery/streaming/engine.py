"""The engine: a configuration as a Structured Streaming query, or once over a file."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pipequery import functions
from pipequery.config import Conf, Policy
from pipequery.plans.handlers import Handler, make_handler, not_objects
from pipequery.plans.session import SQLRunner
from pipequery.shared import shared_folder
from pipequery.sinks import NoopSink, RecordingSink, make_sink
from pipequery.sources import open_source, read_lines
from pipequery.streaming.windows import TumblingManager

DLQ_FIELDS = "error string, message string, phase string, timestamp string"


@dataclass
class Stats:
    """What a run did; counters are of all batches."""

    started: float = field(default_factory=time.time)
    messages: int = 0
    errors: int = 0
    batches: int = 0
    rows_out: int = 0
    batch_seconds: float = 0.0
    sink_seconds: float = 0.0
    sink_flushes: int = 0

    @property
    def messages_per_second(self) -> float:
        return self.messages // max(time.time() - self.started, 1e-9)

    def prometheus(self) -> str:
        """The counters in Prometheus' text format."""
        rows = {
            "message_count_total": self.messages, "error_count_total": self.errors, "batch_count_total": self.batches, "sink_flush_num_rows_total": self.rows_out,
            "batch_processing_seconds_total": self.batch_seconds, "sink_flush_seconds_total": self.sink_seconds, "sink_flush_count_total": self.sink_flushes,
        }
        return "".join(f"# TYPE {k} counter\n{k} {v}\n" for k, v in rows.items())


class Engine:
    """Wires a configuration. Commands, tables and functions come first, then the handler."""

    def __init__(self, spark: SparkSession, conf: Conf, state_root: str | None = None, sink=None, dlq=None, lock: threading.RLock | None = None):
        self.spark, self.conf, self.lock, self.stats = spark, conf, lock or threading.RLock(), Stats()
        # under the pipeline's name, so that a restart finds its tables
        self.runner = SQLRunner(spark, state_root or f"{shared_folder(spark)}/state-{conf.pipeline.name or 'pipeline'}")
        functions.register_builtin(spark)
        for command in conf.commands:
            self.runner.run(command.sql)
        for table in conf.tables:
            self.runner.run(table.sql)
        for udf in conf.udfs:
            functions.register(spark, udf.function_name, udf.import_path)
        p = conf.pipeline
        self.handler: Handler = make_handler(self.runner, p.handler.type, p.handler.sql, p.handler.table)
        self.sink = sink or make_sink(self.runner, p.sink)
        self.dlq = dlq or (make_sink(self.runner, p.on_error.dlq) if p.on_error.dlq else None)
        self.managers = [
            TumblingManager(self.runner, w.collect_closed_windows_sql, w.delete_closed_windows_sql, make_sink(self.runner, t.manager.sink), w.poll_interval_seconds, self.lock)
            for t in conf.tables
            if t.manager and (w := t.manager.tumbling_window)
        ]

    # --- one batch ------------------------------------------------------------------------------

    def process(self, messages: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Handler, then sink. Errors go by the policy; a sink's error is always raised, so the batch comes again."""
        began, policy = time.perf_counter(), self.conf.pipeline.on_error.policy
        messages = messages.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n, odd = messages.agg(F.count("*"), F.count_if(not_objects(F.col("value")))).first()
            if not n:
                return
            self.stats.messages += n
            good = messages
            if policy is not Policy.RAISE:
                good, bad = self.handler.split(messages)
                odd = 0
                failed = bad.count()
                if failed:
                    self.stats.errors += failed
                    self._bury(bad.select("error", F.col("value").alias("message"), F.lit("handler.write").alias("phase")))
            rows = None
            try:
                with self.lock:
                    self.runner.use(messages.sparkSession)
                    rows = self.handler.invoke(good, batch, objects=not odd)
                    if rows is not None and policy is Policy.RAISE and isinstance(self.sink, NoopSink):
                        seen = Observation()  # one job computes, counts and drops the rows
                        rows.observe(seen, F.count("*").alias("n")).write.format("noop").mode("overwrite").save()
                        self.stats.rows_out += seen.get["n"]
                        self.stats.sink_flushes += 1
                        rows = None
                    elif rows is not None:
                        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
                        rows_out = rows.count()  # errors of the SQL come up here, not in the sink
            except Exception as e:
                self.stats.errors += 1
                if policy is Policy.RAISE:
                    raise
                # the whole batch failed: each of its messages is kept
                self._bury(good.select(F.lit(str(e)[:2000]).alias("error"), F.col("value").alias("message"), F.lit("handler.invoke").alias("phase")))
                rows = None
            if rows is not None:
                flushing = time.perf_counter()
                with self.lock:
                    self.sink.write(rows)
                self.stats.sink_seconds += time.perf_counter() - flushing
                self.stats.sink_flushes += 1
                self.stats.rows_out += rows_out
                rows.unpersist()
            self.stats.batches += 1
        finally:
            messages.unpersist()
            self.stats.batch_seconds += time.perf_counter() - began

    def _bury(self, rows: DataFrame) -> None:
        if self.dlq is not None:
            now = datetime.now(UTC).isoformat()
            self.dlq.write(rows.withColumn("timestamp", F.lit(now)))

    # --- runs -------------------------------------------------------------------------------------

    def invoke(self, fixture: str, write: bool = False, collect_windows: bool = False, now: str | None = None) -> list:
        """All lines of a file as one batch; the rows. ``collect_windows``: those of the first managed table instead."""
        rows = self.handler.invoke(read_lines(self.spark, fixture))
        if collect_windows and self.managers:
            rows = self.managers[0].collect_closed(now)
        if rows is None:
            return []
        if write:
            self.sink.write(rows)
        return rows.collect()

    def run(self, checkpoint: str | None = None, once: bool = False, max_messages: int | None = None, stream: DataFrame | None = None, spool: str | None = None, on_start: Callable | None = None) -> Stats:
        """Until stopped; ``once``: until what is there is done; ``max_messages``: until so many were taken.

        Offsets are in the checkpoint and are committed after the sink has a batch: each message is
        handled at least once, and state tables take each batch once.
        """
        p, closing = self.conf.pipeline, None
        if stream is None:
            stream, closing = open_source(self.spark, p.source, p.batch_size, spool)
        checkpoint = checkpoint or self._checkpoint()
        name = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex
        trigger = {"availableNow": True} if once else {"processingTime": f"{p.flush_interval_seconds} seconds" if p.batch_size > 1 else "0 seconds"}
        query = (
            stream.writeStream.foreachBatch(lambda df, batch_id: self.process(df, (name, batch_id))).option("checkpointLocation", checkpoint).trigger(**trigger).start()
        )
        if on_start:
            on_start(query)
        for m in self.managers:
            m.start()
        try:
            while not query.awaitTermination(0.2 if max_messages else 3600):
                if max_messages and self.stats.messages >= max_messages:
                    query.stop()
                    break
        finally:
            if query.isActive:
                query.stop()
            for m in self.managers:
                m.stop()
            if closing is not None:
                closing.close()
        return self.stats

    def _checkpoint(self) -> str:
        return f"{shared_folder(self.spark)}/query-{uuid.uuid4().hex}"


def recording(spark: SparkSession, conf: Conf, **options) -> tuple[Engine, RecordingSink]:
    """An engine whose sink keeps what it gets."""
    sink = RecordingSink()
    return Engine(spark, conf, sink=sink, **options), sink
