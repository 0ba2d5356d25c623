"""Sinks: where the rows of a batch go."""

from __future__ import annotations

import json
import socket
import sys
import uuid
from datetime import date, datetime
from decimal import Decimal
from typing import Protocol, TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipequery.config import KafkaSink, Sink, SQLCommandSink
from pipequery.plans.session import SQLRunner
from pipequery.sources import kafka_security


class SinkProtocol(Protocol):
    def write(self, rows: DataFrame) -> None: ...


def as_json(rows: DataFrame, name: str = "value") -> DataFrame:
    """One JSON text a row; null fields are written."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def _plain(x):
    if isinstance(x, datetime | date):
        return x.isoformat()
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, bytes | bytearray):
        return bytes(x).hex()
    raise TypeError(f"{type(x).__name__} is not JSON serializable")


class ConsoleSink:
    """A JSON line a row; rows come to the driver a partition at a time."""

    def __init__(self, to: TextIO | None = None):
        self.to = to or sys.stdout

    def write(self, rows: DataFrame) -> None:
        for row in rows.toLocalIterator():
            print(json.dumps(row.asDict(recursive=True), default=_plain), file=self.to)
        self.to.flush()


class KafkaTopicSink:
    """A JSON message a row, without key."""

    def __init__(self, conf: KafkaSink):
        self.topic = conf.topic
        self.options = {"kafka.bootstrap.servers": ",".join(conf.brokers), "topic": conf.topic, "kafka.client.id": socket.gethostname()} | kafka_security(conf)

    def write(self, rows: DataFrame) -> None:
        as_json(rows).write.format("kafka").options(**self.options).save()


class SQLSink:
    """Runs a statement over the rows, a relation named ``conf.relation``; each variable is one new UUID a write. Without rows nothing is run."""

    def __init__(self, runner: SQLRunner, conf: SQLCommandSink):
        self.runner, self.conf = runner, conf

    def write(self, rows: DataFrame) -> None:
        if rows.isEmpty():
            return
        sql = self.conf.sql
        for s in self.conf.substitutions:
            sql = sql.replace(s.var, str(uuid.uuid4()))
        rows.createOrReplaceTempView(self.conf.relation)
        self.runner.run(sql)


class NoopSink:
    """Drops the rows, but computes them."""

    def write(self, rows: DataFrame) -> None:
        rows.write.format("noop").mode("overwrite").save()


class TableSink:
    """Appends to a catalog table by name; with a lakehouse catalog configured that is its own append."""

    def __init__(self, table: str):
        self.table = table

    def write(self, rows: DataFrame) -> None:
        spark = rows.sparkSession
        if not spark.catalog.tableExists(self.table):
            rows.write.format("parquet").saveAsTable(self.table)
        else:
            rows.select(*spark.table(self.table).columns).write.insertInto(self.table)


class JDBCSink:
    """Appends to a table by JDBC, in batches, from the executors."""

    def __init__(self, url: str, table: str, **options: str):
        self.options = {"url": url, "dbtable": table, "batchsize": "10000"} | options

    def write(self, rows: DataFrame) -> None:
        rows.write.format("jdbc").options(**self.options).mode("append").save()


class RecordingSink:
    """Keeps what is written; for tests."""

    def __init__(self):
        self.batches: list[list] = []

    def write(self, rows: DataFrame) -> None:
        self.batches.append(rows.collect())

    @property
    def rows(self) -> list:
        return [r for b in self.batches for r in b]


def clickhouse_url(dsn: str) -> str:
    """``clickhouse://user:password@host:port/db`` as a JDBC URL."""
    return "jdbc:" + dsn if not dsn.startswith("jdbc:") else dsn


def make_sink(runner: SQLRunner, conf: Sink) -> SinkProtocol:
    if conf.type == "kafka":
        return KafkaTopicSink(conf.kafka)
    if conf.type == "console":
        return ConsoleSink()
    if conf.type == "sqlcommand":
        return SQLSink(runner, conf.sqlcommand)
    if conf.type == "noop":
        return NoopSink()
    if conf.type == "iceberg":
        name = f"{conf.iceberg.catalog_name}.{conf.iceberg.table_name}"
        has_catalog = runner.spark.conf.get(f"spark.sql.catalog.{conf.iceberg.catalog_name}", None)
        return TableSink(name if has_catalog else conf.iceberg.table_name)
    if conf.type == "clickhouse":
        return JDBCSink(clickhouse_url(conf.clickhouse.dsn), conf.clickhouse.table, driver="com.clickhouse.jdbc.ClickHouseDriver")
    raise NotImplementedError(f"sink type {conf.type!r}")
