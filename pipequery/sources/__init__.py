"""Sources: streaming DataFrames of ``(value string, kafka_topic, kafka_partition, kafka_offset)``."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipequery.config import KafkaSink, KafkaSource, Source


def kafka_security(conf: KafkaSource | KafkaSink) -> dict[str, str]:
    """Spark's ``kafka.`` options of a security section."""
    out = {}
    if conf.security_protocol:
        out["kafka.security.protocol"] = conf.security_protocol
    if conf.sasl:
        login = "org.apache.kafka.common.security.scram.ScramLoginModule" if conf.sasl.mechanism.upper().startswith("SCRAM") else "org.apache.kafka.common.security.plain.PlainLoginModule"
        out["kafka.sasl.mechanism"] = conf.sasl.mechanism
        out["kafka.sasl.jaas.config"] = f'{login} required username="{conf.sasl.username}" password="{conf.sasl.password}";'
    if conf.ssl:
        pairs = {
            "kafka.ssl.truststore.location": conf.ssl.ca_location,
            "kafka.ssl.keystore.location": conf.ssl.certificate_location,
            "kafka.ssl.keystore.key": conf.ssl.key_location,
            "kafka.ssl.key.password": conf.ssl.key_password,
            "kafka.ssl.endpoint.identification.algorithm": conf.ssl.endpoint_identification_algorithm,
        }
        out |= {k: ("" if v == "none" else v) for k, v in pairs.items() if v is not None}
        if conf.ssl.ca_location:
            out |= {"kafka.ssl.truststore.type": "PEM"}
        if conf.ssl.certificate_location:
            out |= {"kafka.ssl.keystore.type": "PEM"}
    return out


def kafka_options(conf: KafkaSource, batch_size: int | None = None) -> dict[str, str]:
    """Options of ``readStream.format("kafka")``. Offsets are kept in the query's checkpoint."""
    out = {"kafka.bootstrap.servers": ",".join(conf.brokers), "subscribe": ",".join(conf.topics), "kafka.group.id": conf.group_id, "startingOffsets": conf.auto_offset_reset, "failOnDataLoss": "true"}
    if batch_size and batch_size > 1:
        out["maxOffsetsPerTrigger"] = str(batch_size)
    return out | kafka_security(conf)


def messages_of_kafka(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("value").cast("string").alias("value"), F.col("topic").alias("kafka_topic"), F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A fixture: one message a line, trimmed; blank lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value != ''")


def read_all_kafka(spark: SparkSession, brokers: str, topic: str) -> DataFrame:
    """All messages of a topic, as a batch."""
    return messages_of_kafka(spark.read.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic).load())


def open_source(spark: SparkSession, conf: Source, batch_size: int | None = None, spool: str | None = None) -> tuple[DataFrame, object | None]:
    """``(stream, what to close)`` of a source's configuration."""
    if conf.type == "kafka":
        return messages_of_kafka(spark.readStream.format("kafka").options(**kafka_options(conf.kafka, batch_size)).load()), None
    if conf.type == "websocket":
        from pipequery.sources.websocket import WebsocketDataSource

        spark.dataSource.register(WebsocketDataSource)
        return spark.readStream.format("websocket").option("uri", conf.websocket.uri).load(), None
    if conf.type == "webhook":
        from pipequery.sources.webhook import Webhook

        server = Webhook(spool or tempfile.mkdtemp(prefix="pipequery-spool-"), conf.webhook.hmac).start()
        return _spooled(spark, server.spool), server
    if conf.type == "file":
        return _spooled(spark, conf.file.path), None
    raise NotImplementedError(f"source type {conf.type!r}")


def _spooled(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", 1000).text(path)
    return lines.select(F.trim("value").alias("value")).where("value != ''")


CITIES = ("New York", "Baltimore", "San Francisco", "Austin", "Chicago")


def synthetic_events(spark: SparkSession, n: int, kind: str = "event", seed: int = 42) -> DataFrame:
    """``n`` messages for tests and benchmarks: ``event`` (a random city) or ``user_action``; made JVM-side."""
    pick = lambda names, s: F.element_at(F.array(*map(F.lit, names)), (F.rand(s) * len(names)).cast("int") + 1)
    at = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if kind == "user_action":
        row = F.struct(at.alias("timestamp"), (F.rand(seed) * 1000).cast("int").alias("user_id"), pick(("click", "view", "buy"), seed + 1).alias("action"), pick(("a", "b", "c", "d", "e"), seed + 2).alias("browser"))
    elif kind == "event":
        place = F.struct(pick(CITIES, seed).alias("city"), F.lit("US").alias("country"))
        row = F.struct(F.lit("10.0.0.1").alias("ip"), F.lit("search").alias("event"), place.alias("properties"), at.alias("timestamp"), F.lit("track").alias("type"), F.col("id").cast("string").alias("userId"))
    else:
        raise ValueError(f"kind {kind!r}")
    return spark.range(n).select(F.to_json(row).alias("value"))
