"""Registered queries over the driver's tables, and the DuckDB statements that check them.

The first part runs the engine's own operators; the second, ``delegated_*``, the SQL surface that
handler SQL reaches as it is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def register(name: str, sql: str | None = None):
    """Add a query under ``name``; ``sql`` is its DuckDB equivalent."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Temporary views of the tables that a statement names."""
    for t in TABLES:
        if t in text:
            table(spark, sf_dir, t).createOrReplaceTempView(t)


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """A query in handler SQL, through the dialect bridge; the same text is the oracle's unless another is given."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from pipequery.plans.session import SQLRunner

        views(spark, sf_dir, text)
        return SQLRunner(spark).run(text)

    register(name, oracle or text)(run)


def _runner(spark: SparkSession):
    """A runner whose state tables are in a folder of their own under the shared one."""
    from pipequery.plans.session import SQLRunner
    from pipequery.shared import shared_folder

    return SQLRunner(spark, f"{shared_folder(spark)}/state-{uuid.uuid4().hex}")


def _messages(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))


# --- handlers -----------------------------------------------------------------------------------


@register("agg_count_by_key", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def agg_count_by_key(spark, sf_dir):
    """Messages through the inferred handler, counted by a key."""
    from pipequery.plans.handlers import InferredBatch

    sql = "SELECT event_type, count(*) AS n FROM batch GROUP BY event_type ORDER BY n DESC"
    return InferredBatch(_runner(spark), sql).invoke(_messages(table(spark, sf_dir, "events"), "event_id", "event_type"))


@register("agg_count_by_key_disk", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def agg_count_by_key_disk(spark, sf_dir):
    """The same with the batch held on disk."""
    from pipequery.plans.handlers import InferredBatch

    sql = "SELECT event_type, count(*) AS n FROM batch GROUP BY event_type"
    return InferredBatch(_runner(spark), sql, disk=True).invoke(_messages(table(spark, sf_dir, "events"), "event_id", "event_type"))


@register("structured_coerce", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def structured_coerce(spark, sf_dir):
    """JSON coerced to a table's schema; further keys are ignored."""
    from pipequery.plans.handlers import StructuredBatch

    runner = _runner(spark)
    runner.run("CREATE OR REPLACE TABLE typed_orders (o_orderkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE)")
    return StructuredBatch(runner, "SELECT * FROM typed_orders", "typed_orders").invoke(_messages(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey"))


@register("structured_accumulate", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def structured_accumulate(spark, sf_dir):
    """A structured table keeps all batches: after three batches its SQL sees them all."""
    from pipequery.plans.handlers import StructuredBatch

    runner = _runner(spark)
    runner.run("CREATE OR REPLACE TABLE seen_orders (o_orderkey BIGINT, o_orderstatus VARCHAR)")
    handler = StructuredBatch(runner, "SELECT o_orderstatus, count(*) AS n FROM seen_orders GROUP BY o_orderstatus", "seen_orders")
    orders, out = table(spark, sf_dir, "orders"), None
    for i in range(3):
        out = handler.invoke(_messages(orders.where(F.col("o_orderkey") % 3 == i), "o_orderkey", "o_orderstatus"))
    return out


@register(
    "dlq_split",
    """SELECT CASE WHEN event_id % 10 = 0 THEN 'bad' ELSE 'good' END AS kind, count(*) AS n FROM events GROUP BY 1""",
)
def dlq_split(spark, sf_dir):
    """Bad JSON is told from good without a failure."""
    from pipequery.plans.handlers import InferredBatch

    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 == 0, F.lit("{!invalid!")).otherwise(F.to_json(F.struct("event_id"))).alias("value"))
    good, bad = InferredBatch.split(rows)
    return good.select(F.lit("good").alias("kind")).union(bad.select(F.lit("bad"))).groupBy("kind").agg(F.count("*").alias("n"))


sql_query("agg_count_all", "SELECT count(*) AS n FROM events")
sql_query("agg_max_by_key", "SELECT event_type, user_id % 10 AS bucket, max(event_id) AS top, max(value) AS top_value FROM events GROUP BY event_type, user_id % 10")
sql_query("project_passthrough", "SELECT * FROM nation")
sql_query("project_cast", "SELECT event_id, CAST(user_id AS VARCHAR) AS user_text, value::INT AS whole, 'extra' AS extra, 1 AS one FROM events WHERE value IS NOT NULL",
          "SELECT event_id, CAST(user_id AS VARCHAR) AS user_text, CAST(trunc(value) AS INT) AS whole, 'extra' AS extra, 1 AS one FROM events WHERE value IS NOT NULL")
sql_query("project_struct_literal", "SELECT event_id, s.kind AS kind, s.inner_part.u AS u FROM (SELECT event_id, {'kind': event_type, 'inner_part': {'u': user_id}} AS s FROM events)")
sql_query("filter_or_null", "SELECT event_id, user_id FROM events LEFT JOIN customer ON user_id = c_custkey WHERE c_custkey IS NULL OR c_acctbal > 5000")
sql_query("order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
sql_query("json_extract_key", "SELECT event_id, props ->> 'k' AS k FROM events", "SELECT event_id, props ->> '$.k' AS k FROM events")
sql_query("json_extract_nested", "SELECT event_id, j ->> 'a' ->> 'b' AS b FROM (SELECT event_id, concat('{\"a\":{\"b\":', event_id, '}}') AS j FROM events)",
          "SELECT event_id, CAST(event_id AS VARCHAR) AS b FROM events")
sql_query(
    "epoch_micros_format",
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS t FROM events",
)
sql_query("join_inner_dim_agg", "SELECT n_name, count(*) AS n, CAST(round(sum(o_totalprice), 2) AS DECIMAL(20,2)) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
          "SELECT n_name, count(*) AS n, CAST(round(sum(o_totalprice), 2) AS DECIMAL(20,2)) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
sql_query("join_left_struct_pack", "SELECT event_id, s.name AS name, s.balance AS balance FROM (SELECT event_id, {'name': c_name, 'balance': c_acctbal} AS s FROM events LEFT JOIN customer ON user_id = c_custkey)")


@register(
    "join_lookup_limit1",
    """SELECT n_nationkey, n_name, c_custkey, c_name FROM nation LEFT JOIN
       (SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1) ON c_nationkey = n_nationkey""",
)
def join_lookup_limit1(spark, sf_dir):
    """Left join with the first row of each key."""
    from pipequery.operators.joins import first_match

    found = first_match(table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer"), F.col("n_nationkey"), "c_nationkey", ["c_custkey"])
    return found.select("n_nationkey", "n_name", "c_custkey", "c_name")


BANDS = [(i, i * 500.0 - 1000, i * 500.0 - 500.01) for i in range(24)]


@register(
    "join_range",
    "SELECT c_custkey, band FROM customer LEFT JOIN (VALUES " + ", ".join(f"({b}, {lo}, {hi})" for b, lo, hi in BANDS) + ") AS t(band, lo, hi) ON c_acctbal >= lo AND c_acctbal <= hi",
)
def join_range(spark, sf_dir):
    """Range join by buckets: an equi-join, not a nested loop."""
    from pipequery.operators.joins import range_join

    bands = spark.createDataFrame(BANDS, "band int, lo double, hi double")
    return range_join(table(spark, sf_dir, "customer"), bands, "c_acctbal", "lo", "hi", 500.0).select("c_custkey", "band")


@register(
    "join_ip_range",
    """SELECT event_id, band FROM (SELECT event_id, (event_id * 7919) % 16777216 AS ip FROM events) LEFT JOIN (SELECT range AS band, range * 65536 AS lo, range * 65536 + 32767 AS hi FROM range(256)) ON ip >= lo AND ip <= hi""",
)
def join_ip_range(spark, sf_dir):
    """Addresses to the networks that hold them."""
    from pipequery.functions import inet4
    from pipequery.operators.joins import range_join

    n = (F.col("event_id") * 7919) % 16777216
    text = F.concat_ws(".", F.lit("0"), F.floor(n / 65536).cast("string"), (F.floor(n / 256) % 256).cast("string"), (n % 256).cast("string"))
    ips = table(spark, sf_dir, "events").select("event_id", inet4(text).alias("ip"))
    networks = spark.range(256).select(F.col("id").alias("band"), (F.col("id") * 65536).alias("lo"), (F.col("id") * 65536 + 32767).alias("hi"))
    return range_join(ips, networks, "ip", "lo", "hi", 65536.0).select("event_id", "band")


# --- windows and state ------------------------------------------------------------------------------


@register("tumbling_hour", "SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_hour(spark, sf_dir):
    from pipequery.streaming.windows import tumbling_counts

    return tumbling_counts(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"]).select("bucket", "event_type", "n")


sql_query("tumbling_minute", "SELECT time_bucket(INTERVAL '1 minute', ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY bucket, event_type")
sql_query("tumbling_trunc", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS bucket, count(*) AS n FROM events GROUP BY 1", "SELECT date_trunc('hour', ts) AS bucket, count(*) AS n FROM events GROUP BY 1")

HOURLY = "SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n FROM {0} GROUP BY 1, 2"
UPSERT = f"INSERT INTO hourly BY NAME {HOURLY.format('batch')} ON CONFLICT (bucket, event_type) DO UPDATE SET n = n + EXCLUDED.n"


def _hourly(spark: SparkSession, sf_dir: str, batches: int, replay: bool = False):
    """Hourly counts gathered in a state table batch by batch."""
    runner, events = _runner(spark), table(spark, sf_dir, "events")
    runner.run("CREATE OR REPLACE TABLE hourly (bucket TIMESTAMP, event_type VARCHAR, n BIGINT, PRIMARY KEY (bucket, event_type))")
    for i in range(batches):
        events.where(F.col("event_id") % batches == i).createOrReplaceTempView("batch")
        for _ in range(1 + replay):
            runner.run(UPSERT, batch=("hourly", i))
    return runner


def _naive(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@register("upsert_additive_microbatches", HOURLY.format("events"))
def upsert_additive_microbatches(spark, sf_dir):
    return _naive(_hourly(spark, sf_dir, 3).table("hourly").read())


@register("idempotent_batches", HOURLY.format("events"))
def idempotent_batches(spark, sf_dir):
    """Each batch comes twice, as after a failure; it counts once."""
    return _naive(_hourly(spark, sf_dir, 2, replay=True).table("hourly").read())


@register("window_closed_split", f"SELECT * FROM ({HOURLY.format('events')}) WHERE bucket < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL '60' SECOND")
def window_closed_split(spark, sf_dir):
    """What the window manager collects at an instant."""
    from pipequery.sinks import NoopSink
    from pipequery.streaming.windows import TumblingManager

    closed = "bucket < (now()::timestamptz - INTERVAL '60' SECOND)"
    manager = TumblingManager(_hourly(spark, sf_dir, 1), f"SELECT * FROM hourly WHERE {closed}", f"DELETE FROM hourly WHERE {closed}", NoopSink())
    return _naive(manager.collect_closed("2024-01-15 00:00:00"))


@register("window_delete_closed", f"SELECT * FROM ({HOURLY.format('events')}) WHERE NOT bucket < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL '60' SECOND")
def window_delete_closed(spark, sf_dir):
    """What is left after closed windows were written and deleted."""
    from pipequery.sinks import NoopSink
    from pipequery.streaming.windows import TumblingManager

    runner, closed = _hourly(spark, sf_dir, 1), "bucket < (now()::timestamptz - INTERVAL '60' SECOND)"
    TumblingManager(runner, f"SELECT * FROM hourly WHERE {closed}", f"DELETE FROM hourly WHERE {closed}", NoopSink()).poll("2024-01-15 00:00:00")
    return _naive(runner.table("hourly").read())


@register("idempotent_replay", "SELECT event_id, event_type FROM events")
def idempotent_replay(spark, sf_dir):
    """Overlapping replays filtered by the stored offset of each partition."""
    from pipequery.operators.state import newer_than_stored

    events = table(spark, sf_dir, "events").withColumn("part", F.col("event_id") % 4)
    top = events.agg(F.max("event_id")).first()[0]
    seen, stored = None, spark.createDataFrame([], "part long, event_id long")
    for upto in (top // 3, top // 2, top):  # each reads from the start again
        new = newer_than_stored(events.where(F.col("event_id") <= upto), stored, ["part"], "event_id")
        seen = new if seen is None else seen.union(new)
        stored = events.where(F.col("event_id") <= upto).groupBy("part").agg(F.max("event_id").alias("event_id"))
    return seen.select("event_id", "event_type")


@register("sqlcommand_parquet_roundtrip", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def sqlcommand_parquet_roundtrip(spark, sf_dir):
    """Rows through the SQL sink's COPY to a Parquet file named by a new UUID, and back."""
    from pipequery.config import SQLCommandSink, Substitution
    from pipequery.sinks import SQLSink

    runner = _runner(spark)
    folder = f"{runner.root}/copied"
    sink = SQLSink(runner, SQLCommandSink(f"COPY sink_batch TO '{folder}/$id.parquet' (FORMAT 'parquet')", [Substitution("$id", "uuid4")]))
    sink.write(table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n")))
    return spark.read.parquet(f"{folder}/*.parquet")


@register("insert_by_name", "SELECT s_suppkey, s_name FROM supplier")
def insert_by_name(spark, sf_dir):
    runner = _runner(spark)
    table(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    runner.run("CREATE OR REPLACE TABLE named (s_suppkey BIGINT, s_name VARCHAR); INSERT INTO named BY NAME SELECT s_name, s_suppkey FROM supplier")
    return runner.table("named").read()


@register("insert_positional", "SELECT s_suppkey AS a, s_name AS b, s_acctbal AS c FROM supplier")
def insert_positional(spark, sf_dir):
    runner = _runner(spark)
    table(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    runner.run("CREATE OR REPLACE TABLE placed (a BIGINT, b VARCHAR, c DOUBLE); INSERT INTO placed SELECT s_suppkey, s_name, s_acctbal FROM supplier")
    return runner.table("placed").read()


@register("delete_where", "SELECT s_suppkey, s_acctbal FROM supplier WHERE NOT (s_acctbal < 1000)")
def delete_where(spark, sf_dir):
    runner = _runner(spark)
    table(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    runner.run("CREATE OR REPLACE TABLE rich (s_suppkey BIGINT, s_acctbal DOUBLE); INSERT INTO rich SELECT s_suppkey, s_acctbal FROM supplier; DELETE FROM rich WHERE s_acctbal < 1000")
    return runner.table("rich").read()


@register("upsert_latest", "SELECT user_id, max(event_id) AS last_event FROM events GROUP BY 1")
def upsert_latest(spark, sf_dir):
    """ON CONFLICT that sets the new value."""
    runner, events = _runner(spark), table(spark, sf_dir, "events")
    runner.run("CREATE OR REPLACE TABLE latest (user_id BIGINT PRIMARY KEY, last_event BIGINT)")
    middle = events.agg(F.max("event_id")).first()[0] // 2
    for part in (events.where(F.col("event_id") <= middle), events.where(F.col("event_id") > middle)):
        part.createOrReplaceTempView("batch")
        runner.run("INSERT INTO latest SELECT user_id, max(event_id) AS last_event FROM batch GROUP BY user_id ON CONFLICT (user_id) DO UPDATE SET last_event = EXCLUDED.last_event")
    return runner.table("latest").read()


@register(
    "udf_registered_domain",
    r"""SELECT page_id, CASE WHEN regexp_matches(h, '^[0-9.]+$') OR NOT contains(h, '.') THEN '' ELSE regexp_extract(h, '([^.]+\.[^.]+)$', 1) END AS domain
        FROM (SELECT page_id, regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:@]*)', 1) AS h FROM pages)""",
)
def udf_registered_domain(spark, sf_dir):
    from pipequery.functions import registered_domain

    return table(spark, sf_dir, "pages").select("page_id", registered_domain(F.col("url")).alias("domain"))


# --- streams -----------------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str, files: int) -> DataFrame:
    """``events`` as a stream of ``files`` files, one a trigger."""
    folder = f"{_runner(spark).root}/events-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    events.repartition(files, "event_id").write.parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _checkpoint(spark: SparkSession) -> str:
    return f"{_runner(spark).root}/checkpoint-{uuid.uuid4().hex}"


@register("stream_tumbling_complete", "SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_complete(spark, sf_dir):
    """Hourly counts of a stream in complete mode: nothing late is lost."""
    from pipequery.streaming.windows import tumbling_counts

    out = f"{_checkpoint(spark)}-out"
    counts = tumbling_counts(_event_stream(spark, sf_dir, 3), "ts", "1 hour", ["event_type"]).select("bucket", "event_type", "n")
    writer = counts.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    writer.option("checkpointLocation", _checkpoint(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@register("stream_batched_agg", HOURLY.format("events"))
def stream_batched_agg(spark, sf_dir):
    """A stream through foreachBatch into a state table."""
    runner = _runner(spark)
    runner.run("CREATE OR REPLACE TABLE hourly (bucket TIMESTAMP, event_type VARCHAR, n BIGINT, PRIMARY KEY (bucket, event_type))")

    def process(df: DataFrame, batch_id: int) -> None:
        runner.use(df.sparkSession)
        df.createOrReplaceTempView("batch")
        runner.run(UPSERT, batch=("stream", batch_id))

    _event_stream(spark, sf_dir, 3).writeStream.foreachBatch(process).option("checkpointLocation", _checkpoint(spark)).trigger(availableNow=True).start().awaitTermination()
    runner.use(spark)
    return _naive(runner.table("hourly").read())


@register("sliding_window", """SELECT bucket, event_type, count(*) AS n FROM (
    SELECT event_type, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS bucket FROM events) GROUP BY 1, 2""")  # fmt: skip
def sliding_window(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.window("ts", "1 hour", "30 minutes").start.alias("bucket"), "event_type").agg(F.count("*").alias("n"))


@register("session_window", """SELECT user_id, min(ts) AS began, count(*) AS n FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
      SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events))
    GROUP BY user_id, s""")  # fmt: skip
def session_window(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = events.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("began"), "n")


@register("delegated_as_of_join", """SELECT p.event_id, k.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1, 2) k ON p.user_id = k.user_id AND p.ts >= k.ts""")  # fmt: skip
def delegated_as_of_join(spark, sf_dir):
    """Each purchase with the user's latest click: one shuffle, one ordered window."""
    from pipequery.operators.joins import as_of_join

    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    clicks = events.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return as_of_join(events.where("event_type = 'purchase'"), clicks, ["user_id"], "ts", "ts", ["click_id"]).select("event_id", "click_id")


# --- the SQL surface that handler SQL reaches --------------------------------------------------------

DELEGATED: dict[str, str | tuple[str, str]] = {
    "right_join": "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey",
    "full_join": "SELECT s_suppkey, c_custkey FROM supplier FULL OUTER JOIN customer ON s_suppkey = c_custkey",
    "cross_join": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "semi_join": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)",
    "anti_join": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "in_subquery": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "interval_join": "SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '1' HOUR",
    "predicates": "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 20 AND p_brand LIKE 'Brand%' AND p_type IS NOT NULL AND p_partkey NOT IN (1, 2, 3)",
    "case_coalesce": "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.05 THEN 'high' WHEN l_discount > 0 THEN 'low' ELSE 'none' END AS band, COALESCE(NULLIF(l_returnflag, 'N'), '-') AS flag FROM lineitem",
    "aggregates": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "spread": "SELECT event_type, round(stddev_samp(value), 6) AS sd, round(var_pop(value), 6) AS vp FROM events GROUP BY event_type",
    "count_distinct": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "distinct": "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer",
    "median": ("SELECT event_type, median(value) AS m, percentile(value, 0.9) AS p90 FROM events GROUP BY event_type", "SELECT event_type, median(value) AS m, quantile_cont(value, 0.9) AS p90 FROM events GROUP BY event_type"),
    "filter_clause": "SELECT event_type, count(*) FILTER (WHERE value > 50) AS big, count(*) AS n FROM events GROUP BY event_type",
    "arg_max": ("SELECT o_custkey, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS best FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best FROM orders GROUP BY o_custkey"),
    "list_agg": ("SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "group_by_all_having": "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 3",
    "ranking": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders",
    "distribution": "SELECT s_suppkey, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS q, round(percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS pr, round(cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS cd FROM supplier",
    "lag_lead": "SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS after, first_value(event_id) OVER w AS first_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "frames": "SELECT event_id, sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s3, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS running FROM events",
    "union_by_name": ("SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey AS id, c_name AS name FROM customer", "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL BY NAME SELECT c_name AS name, c_custkey AS id FROM customer"),
    "intersect": "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey AS k FROM customer",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier",
    "except_all": "SELECT o_orderstatus AS s FROM orders EXCEPT ALL SELECT 'O' AS s FROM customer",
    "top_k_offset": "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10 OFFSET 5",
    "strings": "SELECT c_custkey, upper(c_name) AS u, trim(c_mktsegment) AS t, substring(c_name, 2, 4) AS s, length(c_name) AS n, replace(c_name, '#', '-') AS r, concat_ws('/', c_name, c_mktsegment) AS j, regexp_replace(c_name, '[0-9]+', 'N') AS x, levenshtein(c_name, c_mktsegment) AS lev FROM customer",
    "dates": ("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, datediff(DATE '2002-01-01', CAST(o_orderdate AS DATE)) AS d, last_day(o_orderdate) AS l FROM orders",
              "SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, datediff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01')::INT AS d, last_day(o_orderdate) AS l FROM orders"),
    "math": "SELECT l_orderkey, l_linenumber, floor(l_quantity) AS f, ceil(l_extendedprice) AS c, round(sqrt(l_extendedprice), 6) AS r, abs(l_discount - l_tax) AS a, l_orderkey % 7 AS m, round(ln(l_extendedprice), 6) AS g, round(pow(l_tax, 2), 8) AS p FROM lineitem",
    "arrays": ("SELECT n_nationkey, size(split(n_name, '')) AS n, array_join(transform(sequence(1, 3), i -> i * n_nationkey), ',') AS t, array_contains(array(1, 2, n_regionkey), 2) AS c FROM nation",
               "SELECT n_nationkey, length(n_name)::INT AS n, array_to_string(list_transform([1, 2, 3], lambda i: i * n_nationkey), ',') AS t, list_contains([1, 2, n_regionkey], 2) AS c FROM nation"),
    "explode": ("SELECT conv_id, turn, w FROM conversations LATERAL VIEW explode(filter(split(text, ' '), x -> x != '')) AS w", "SELECT conv_id, turn, unnest(list_filter(string_split(text, ' '), lambda x: x != '')) AS w FROM conversations"),
    "maps": ("SELECT r_regionkey, element_at(map('k', r_name, 'z', 'x'), 'k') AS v, size(map('a', 1, 'b', 2)) AS n FROM region", "SELECT r_regionkey, r_name AS v, 2 AS n FROM region"),
    "json": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k, to_json(named_struct('id', event_id)) AS j FROM events", "SELECT event_id, CAST(props ->> '$.k' AS INT) AS k, '{\"id\":' || event_id || '}' AS j FROM events"),
    "cte_scalar_subquery": "WITH big AS (SELECT * FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)) SELECT o_orderstatus, count(*) AS n FROM big GROUP BY o_orderstatus",
    "correlated": "SELECT s_suppkey FROM supplier a WHERE s_acctbal = (SELECT max(s_acctbal) FROM supplier b WHERE b.s_nationkey = a.s_nationkey)",
    "pivot": ("SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))",
              "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1"),
    "unpivot": ("SELECT s_suppkey, k, v FROM (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS nk, s_acctbal AS bal FROM supplier) UNPIVOT (v FOR k IN (nk, bal))",
                "SELECT s_suppkey, 'nk' AS k, CAST(s_nationkey AS DOUBLE) AS v FROM supplier UNION ALL SELECT s_suppkey, 'bal', s_acctbal FROM supplier"),
    "values_range": ("SELECT v.a, r.id AS b FROM VALUES (1, 'x'), (2, 'y') AS v(a, t) JOIN range(5) AS r ON r.id >= v.a", "SELECT v.a, r.range AS b FROM (VALUES (1, 'x'), (2, 'y')) AS v(a, t) JOIN range(5) AS r ON r.range >= v.a"),
    "lateral": ("SELECT n_name, t.c_custkey FROM nation, LATERAL (SELECT max(c_custkey) AS c_custkey FROM customer WHERE c_nationkey = n_nationkey) t", "SELECT n_name, max(c_custkey) AS c_custkey FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name"),
    "star_exclude": ("SELECT * EXCLUDE (r_name) FROM region", "SELECT * EXCLUDE (r_name) FROM region"),
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "revenue_by_nation": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
}
for _name, _text in DELEGATED.items():
    sql_query(f"delegated_{_name}", *((_text,) if isinstance(_text, str) else _text))


@register("delegated_approx_distinct")
def delegated_approx_distinct(spark, sf_dir):
    """A sketch's estimate has no exact counterpart; tests hold it to its error."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"), F.percentile_approx("value", 0.5).alias("m"))
