"""Handlers: a batch of raw messages to rows by a pipeline's SQL."""

from __future__ import annotations

import json
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark import StorageLevel

from pipequery.plans.session import SQLRunner

METADATA = ("kafka_offset", "kafka_partition", "kafka_topic")


class HandlerWriteError(ValueError):
    """A message that can't be decoded."""


class Handler(Protocol):
    def split(self, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``messages(value string, ...)`` that can be decoded, and the others with ``error``."""

    def invoke(self, messages: DataFrame, batch: tuple[str, int] | None = None, objects: bool = False) -> DataFrame | None:
        """The rows that the SQL gives for a batch; None if it gives none."""


def _split(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON objects, and what is none."""
    parsed = F.try_parse_json(F.col("value"))
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT<"), F.lit(False))
    error = F.when(parsed.isNull(), F.lit("invalid JSON")).otherwise(F.lit("not a JSON object"))
    return messages.where(is_object), messages.where(~is_object).withColumn("error", error)


def not_objects(value: Column) -> Column:
    """Texts that can't be JSON objects, told from their first character; broken objects are found by inference."""
    return ~F.ltrim(value).startswith("{")


def infer_json(messages: DataFrame) -> DataFrame | None:
    """Typed rows of JSON objects, None if one can't be read: columns and their order are the first message's keys, types are those of all messages.

    Keys that a later message lacks are null; keys that only later messages have are left out.
    Nested objects have the fields of all messages. The parsing is JVM-side.
    """
    spark = messages.sparkSession
    first = messages.select("value").first()
    if first is None:
        return spark.createDataFrame([], T.StructType())
    try:
        keys = list(json.loads(first["value"]))
    except ValueError:
        return None
    encoder = spark._jvm.org.apache.spark.sql.Encoders.STRING()
    schema = DataFrame(spark._jsparkSession.read().json(getattr(messages.select("value")._jdf, "as")(encoder)), spark).schema
    if "_corrupt_record" in schema.names and "_corrupt_record" not in keys:
        return None
    kinds = {f.name: T.StringType() if isinstance(f.dataType, T.NullType) else f.dataType for f in schema}
    picked = T.StructType([T.StructField(k, kinds.get(k, T.StringType())) for k in keys])
    rest = [c for c in METADATA if c in messages.columns]
    return messages.select(F.from_json("value", picked).alias("_v"), *rest).select("_v.*", *rest)


class InferredBatch:
    """SQL over a relation ``batch`` whose schema is inferred anew for each batch. ``disk``: the batch is held on disk only."""

    def __init__(self, runner: SQLRunner, sql: str, disk: bool = False):
        self.runner, self.sql, self.disk, self.held = runner, sql, disk, None

    split = staticmethod(_split)

    def invoke(self, messages: DataFrame, batch: tuple[str, int] | None = None, objects: bool = False) -> DataFrame | None:
        """``objects``: the caller knows that each message begins as an object."""
        if not objects and not messages.where(not_objects(F.col("value"))).isEmpty():
            self._refuse(messages)
        rows = infer_json(messages)
        if rows is None:
            self._refuse(messages)
        if not rows.columns:
            return None
        if self.disk:
            if self.held is not None:
                self.held.unpersist()
            self.held = rows = rows.persist(StorageLevel.DISK_ONLY)
        rows.createOrReplaceTempView("batch")
        return self.runner.run(self.sql, batch=batch)

    def _refuse(self, messages: DataFrame) -> None:
        bad = self.split(messages)[1].select("value", "error").first()
        raise HandlerWriteError(f"{bad['error']}: {bad['value'][:200]}" if bad else "a message can't be read")


class StructuredBatch:
    """Messages coerced to a table's schema and added to it; SQL over the table, so over all batches that it has kept."""

    def __init__(self, runner: SQLRunner, sql: str, table: str):
        self.runner, self.sql, self.table = runner, sql, table
        if not table:
            raise ValueError("a structured handler needs a table")

    split = staticmethod(_split)

    def coerce(self, messages: DataFrame) -> DataFrame:
        """Rows by the table's schema: further keys are ignored, missing ones null, a value of another type is an error."""
        schema = self.runner.table(self.table).schema
        strict = F.from_json("value", schema, {"mode": "FAILFAST"})
        return messages.select(strict.alias("_v")).select("_v.*")

    def invoke(self, messages: DataFrame, batch: tuple[str, int] | None = None, objects: bool = False) -> DataFrame | None:
        self.runner.table(self.table).append(self.coerce(messages), by_name=True, batch=(f"{batch[0]}/in", batch[1]) if batch else None)
        return self.runner.run(self.sql, batch=batch)


def make_handler(runner: SQLRunner, kind: str, sql: str, table: str | None = None) -> Handler:
    """A handler by its type string."""
    if kind == "handlers.InferredMemBatch":
        return InferredBatch(runner, sql)
    if kind == "handlers.InferredDiskBatch":
        return InferredBatch(runner, sql, disk=True)
    if kind == "handlers.StructuredBatch":
        return StructuredBatch(runner, sql, table or "")
    raise NotImplementedError(f"handler type {kind!r}")
