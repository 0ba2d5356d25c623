"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``availableNow`` stream, through the engine; the others are joins, windows and aggregates on tables.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

os.environ["PYTHONPATH"] = os.path.dirname(os.path.abspath(__file__)) + os.pathsep + os.environ.get("PYTHONPATH", "")

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

SHAPES = {
    "agg_mem": ("handlers.InferredMemBatch", "SELECT props.city AS city, count(*) AS n FROM batch GROUP BY city"),
    "agg_disk": ("handlers.InferredDiskBatch", "SELECT props.city AS city, count(*) AS n FROM batch GROUP BY city"),
    "enrich": ("handlers.InferredMemBatch", "SELECT *, {'something': props.city} AS nested_city, 'extra' AS extra FROM batch"),
    "csv_disk_join": ("handlers.InferredMemBatch", "SELECT state, count(*) AS n FROM batch JOIN read_csv('CSV', header=true) AS l ON l.city = props.city GROUP BY state"),
    "csv_mem_join": ("handlers.InferredMemBatch", "SELECT props.city AS city, state FROM batch LEFT JOIN (SELECT * FROM locations WHERE locations.city = props.city LIMIT 1) AS one ON one.city = props.city"),
    "tumbling": ("handlers.InferredMemBatch", "INSERT INTO counts BY NAME SELECT date_trunc('hour', CAST(ts AS TIMESTAMP)) AS bucket, props.city AS city, count(*) AS n FROM batch GROUP BY bucket, city ON CONFLICT (bucket, city) DO UPDATE SET n = n + EXCLUDED.n"),
}
TABLES = ["tumbling_hour", "join_range", "join_lookup_limit1", "delegated_as_of_join", "delegated_pricing_summary", "delegated_revenue_by_nation", "delegated_ranking", "delegated_cube", "sliding_window"]


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.doubleQuotedIdentifiers", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from pipequery import catalog, config
    from pipequery.streaming.engine import Engine

    work = tempfile.mkdtemp(prefix="pipequery-bench-")
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    rows = events.count()
    message = F.to_json(F.struct("event_id", F.col("ts").cast("string").alias("ts"), "event_type", F.struct(F.col("event_type").alias("city"), F.col("user_id").alias("id")).alias("props")))
    events.repartition(int(CPUS)).select(message).write.text(f"{work}/messages")
    with open(f"{work}/locations.csv", "w") as f:
        f.write("city,state\n" + "".join(f"{r[0]},{r[0].upper()}\n" for r in events.select("event_type").distinct().collect()))
    commands = [
        {"name": "v", "sql": f"CREATE VIEW locations AS SELECT * FROM read_csv_auto('{work}/locations.csv', header=True)"},
        {"name": "t", "sql": "CREATE OR REPLACE TABLE counts (bucket TIMESTAMP, city VARCHAR, n BIGINT, PRIMARY KEY (bucket, city))"},
    ]

    def engine(shape: str, run: str) -> Engine:
        kind, sql = SHAPES[shape]
        d = {"commands": commands, "pipeline": {"batch_size": 100_000, "source": {"type": "file", "file": {"path": f"{work}/messages"}}, "handler": {"type": kind, "sql": sql.replace("CSV", f"{work}/locations.csv")}, "sink": {"type": "noop"}}}
        return Engine(spark, config.from_dict(d), state_root=f"file://{work}/state-{shape}-{run}")

    def batch(shape: str, run: str) -> float:
        e = engine(shape, run)
        began = time.perf_counter()
        e.process(spark.read.text(f"{work}/messages"))
        return time.perf_counter() - began

    def stream(shape: str, run: str) -> float:
        e = engine(shape, run)
        began = time.perf_counter()
        e.run(checkpoint=f"{work}/check-{shape}-{run}", once=True)
        return time.perf_counter() - began

    def on_tables(name: str, _: str) -> float:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    times = {}
    for name, f, arg in [*((s, batch, s) for s in SHAPES), *((f"{s}_stream", stream, s) for s in SHAPES), *((t, on_tables, t) for t in TABLES)]:
        f(arg, "warm")
        times[name] = round(min(f(arg, "one"), f(arg, "two")), 3)
    shutil.rmtree(work, ignore_errors=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR).removeprefix("sf"),
                "rows_per_second": {s: round(rows / times[s]) for s in [*SHAPES, *(f"{s}_stream" for s in SHAPES)]},
            }
        )
    )
    sys.stdout.flush()


if __name__ == "__main__":
    main()
