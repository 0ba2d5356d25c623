import io
import json
import time

import pytest

from pipequery import config
from pipequery.operators.state import StateTable
from pipequery.plans.handlers import HandlerWriteError
from pipequery.sinks import ConsoleSink, RecordingSink
from pipequery.streaming.engine import Engine

EVENTS = [
    {"event": "search", "properties": {"city": "New York"}, "user": {"id": "1"}},
    {"event": "search", "properties": {"city": "Baltimore"}, "user": {"id": "2"}},
]
TIMED = [{"timestamp": f"2015-12-12T19:11:0{i}.249Z"} | EVENTS[i % 2] for i in range(4)]


def conf(sql, handler="handlers.InferredMemBatch", sink=None, **more):
    table = more.pop("table", None)
    p = {"batch_size": 10, "source": {"type": "file", "file": {"path": "/none"}}, "handler": {"type": handler, "sql": sql} | ({"table": table} if table else {}), "sink": sink or {"type": "noop"}}
    return config.from_dict({"pipeline": p | more.pop("pipeline", {})} | more)


@pytest.fixture
def fixture(tmp_path):
    def write(rows, name="in.jsonl"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True, parents=True)
        path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows) + "\n")
        return str(path)

    return write


def engine(spark, tmp_path, c, **options):
    return Engine(spark, c, state_root=f"file://{tmp_path}/state", **options)


AGG = "SELECT properties.city as city, count(*) as city_count FROM batch GROUP BY city ORDER BY city DESC"


@pytest.mark.parametrize("handler", ["handlers.InferredMemBatch", "handlers.InferredDiskBatch"])
def test_count_by_key(spark, tmp_path, fixture, handler):
    rows = engine(spark, tmp_path, conf(AGG, handler)).invoke(fixture(EVENTS))
    assert [tuple(r) for r in rows] == [("New York", 1), ("Baltimore", 1)]


def test_structured_handler_and_accumulation(spark, tmp_path, fixture):
    commands = [{"name": "t", "sql": "CREATE TABLE source (event STRING, properties STRUCT(city TEXT), user STRUCT(id TEXT));"}]
    e = engine(spark, tmp_path, conf("SELECT properties.city as city, count(*) AS n FROM source GROUP BY 1 ORDER BY 1", "handlers.StructuredBatch", table="source", commands=commands))
    path = fixture(EVENTS)
    assert [tuple(r) for r in e.invoke(path)] == [("Baltimore", 1), ("New York", 1)]
    assert [tuple(r) for r in e.invoke(path)] == [("Baltimore", 2), ("New York", 2)]


def test_structured_handler_refuses_other_types(spark, tmp_path, fixture):
    commands = [{"name": "t", "sql": "CREATE TABLE people (id INT, name STRING)"}]
    e = engine(spark, tmp_path, conf("SELECT * FROM people", "handlers.StructuredBatch", table="people", commands=commands))
    with pytest.raises(Exception):
        e.invoke(fixture([{"id": "invalid_id", "name": "Alice"}]))
    assert [tuple(r) for r in e.invoke(fixture([{"id": 1, "name": "Bob", "more": 2}, {"name": "Eve"}]))] == [(1, "Bob"), (None, "Eve")]


def test_enrich(spark, tmp_path, fixture):
    [row] = engine(spark, tmp_path, conf("SELECT *, {'something': properties.city} as nested_city, 'extra' as extra FROM batch")).invoke(fixture(EVENTS[:1]))
    assert row.asDict(True) == EVENTS[0] | {"nested_city": {"something": "New York"}, "extra": "extra"}
    assert list(row.asDict()) == ["event", "properties", "user", "nested_city", "extra"]


def test_columns_are_the_first_messages_keys(spark, tmp_path, fixture):
    rows = engine(spark, tmp_path, conf("SELECT * FROM batch")).invoke(fixture([{"b": 1, "a": {"x": 1}}, {"a": {"y": 2}, "c": 3}]))
    assert [r.asDict(True) for r in rows] == [{"b": 1, "a": {"x": 1, "y": None}}, {"b": None, "a": {"x": None, "y": 2}}]


def test_csv_lookup_takes_the_first_row(spark, tmp_path, fixture):
    csv = tmp_path / "locations.csv"
    csv.write_text("city,state_full\nBaltimore,Maryland\nNew York,New York\nBaltimore,Ohio\n")
    sql = """SELECT properties.city, state_full FROM batch LEFT JOIN (
        SELECT * FROM locations WHERE locations.city = properties.city LIMIT 1) AS single_location
        ON single_location.city = properties.city ORDER BY properties.city ASC"""
    commands = [{"name": "v", "sql": f"CREATE VIEW locations AS SELECT * FROM read_csv_auto('{csv}', header=True)"}]
    rows = engine(spark, tmp_path, conf(sql, commands=commands)).invoke(fixture(TIMED))
    assert [tuple(r) for r in rows] == [("Baltimore", "Maryland")] * 2 + [("New York", "New York")] * 2
    sql = f"SELECT state_full, count(*) AS n FROM batch JOIN read_csv('{csv}', auto_detect=true, header=true) AS l ON l.city = batch.properties.city GROUP BY 1 ORDER BY 1"
    assert [tuple(r) for r in engine(spark, tmp_path, conf(sql)).invoke(fixture(TIMED))] == [("Maryland", 2), ("New York", 2), ("Ohio", 2)]


WINDOW = dict(
    tables={
        "sql": [
            {
                "name": "agg_cities_count",
                "sql": "CREATE TABLE agg_cities_count (bucket TIMESTAMPTZ, city VARCHAR, count INT); CREATE UNIQUE INDEX i ON agg_cities_count (bucket, city);",
                "manager": {
                    "tumbling_window": {
                        "collect_closed_windows_sql": "SELECT strftime(date_trunc('hour', bucket), '%Y-%m-%dT%H:%M:%S') AS bucket, city, count FROM agg_cities_count WHERE bucket < (now()::timestamptz - INTERVAL '60' SECOND) ORDER BY city",
                        "delete_closed_windows_sql": "DELETE FROM agg_cities_count WHERE bucket < (now()::timestamptz - INTERVAL '60' SECOND)",
                    },
                    "sink": {"type": "console"},
                },
            }
        ]
    }
)
UPSERT = """INSERT INTO agg_cities_count BY NAME
    SELECT date_trunc('hour', CAST(timestamp as TIMESTAMP)) as bucket, properties.city as city, count(*) as count FROM batch GROUP BY bucket, city
    ON CONFLICT (bucket, city) DO UPDATE SET count = count + EXCLUDED.count"""


def test_tumbling_window_upsert_collect_delete(spark, tmp_path, fixture):
    e = engine(spark, tmp_path, conf(UPSERT, **WINDOW))
    path = fixture(TIMED)
    assert [tuple(r) for r in e.invoke(path)] == [(2,)]
    e.invoke(path)
    m, m.sink = e.managers[0], RecordingSink()
    assert m.poll("2015-12-12 19:00:30") == 0  # nothing is closed
    assert m.poll("2015-12-12 21:00:00") == 2
    assert [tuple(r) for r in m.sink.rows] == [("2015-12-12T19:00:00", "Baltimore", 4), ("2015-12-12T19:00:00", "New York", 4)]
    assert m.poll("2015-12-12 21:00:00") == 0
    assert e.invoke(path, collect_windows=True)[0]["count"] == 2


def test_state_table_takes_a_batch_once(spark, tmp_path):
    from pyspark.sql import types as T

    t = StateTable(spark, "s", f"file://{tmp_path}/s", T._parse_datatype_string("k string, n int"), ["k"])
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    for batch in (0, 0, 1):
        t.upsert(rows, {"n": "n + EXCLUDED.n"}, batch=("q", batch))
    assert sorted(map(tuple, t.read().collect())) == [("a", 2), ("b", 4)]
    assert t.delete("k = 'a'") == 1 and t.delete("k = 'z'") == 0
    again = StateTable(spark, "s", f"file://{tmp_path}/s", t.schema, ["k"])
    assert [tuple(r) for r in again.read().collect()] == [("b", 4)]


def test_idempotent_ingest(spark, tmp_path):
    sql = """BEGIN TRANSACTION;
      CREATE OR REPLACE TEMPORARY TABLE filtered_batch AS SELECT b.* FROM batch b LEFT JOIN my_db.events_metadata em
        ON b.kafka_topic = em.topic AND b.kafka_partition = em.partition WHERE em."offset" IS NULL OR b.kafka_offset > em."offset";
      INSERT INTO my_db.events SELECT event, properties ->> 'city' AS city FROM filtered_batch;
      INSERT INTO my_db.events_metadata (partition, "offset", topic)
        SELECT kafka_partition AS partition, MAX(kafka_offset) AS "offset", kafka_topic AS topic, FROM filtered_batch WHERE kafka_offset IS NOT NULL GROUP BY kafka_partition, kafka_topic
        ON CONFLICT (topic, partition) DO UPDATE SET "offset" = EXCLUDED."offset", updated_at = now();
      COMMIT;"""
    commands = [
        {"name": "a", "sql": "ATTACH 'md:my_db'"},
        {"name": "e", "sql": "CREATE TABLE IF NOT EXISTS my_db.events (event VARCHAR, city VARCHAR)"},
        {"name": "m", "sql": 'CREATE TABLE IF NOT EXISTS my_db.events_metadata (partition INTEGER, "offset" BIGINT, topic VARCHAR, updated_at TIMESTAMP DEFAULT now(), PRIMARY KEY (topic, partition))'},
    ]
    e = engine(spark, tmp_path, conf(sql, commands=commands))
    rows = [(json.dumps(EVENTS[i % 2]), "t", 0, i) for i in range(6)]
    schema = "value string, kafka_topic string, kafka_partition int, kafka_offset bigint"
    for part in (rows[:4], rows[2:6], rows):  # replays overlap
        e.process(spark.createDataFrame(part, schema))
    assert e.runner.table("my_db.events").read().count() == 6
    assert [(r["topic"], r["offset"]) for r in e.runner.table("my_db.events_metadata").read().collect()] == [("t", 5)]


def test_policies(spark, tmp_path):
    bad = spark.createDataFrame([("{!invalidJSON!",), ("[1]",), (json.dumps(EVENTS[0]),)], "value string")
    with pytest.raises(HandlerWriteError):
        engine(spark, tmp_path, conf(AGG), sink=RecordingSink()).process(bad)
    sink = RecordingSink()
    e = engine(spark, tmp_path, conf(AGG, pipeline={"on_error": {"policy": "ignore"}}), sink=sink)
    e.process(bad)
    assert [tuple(r) for r in sink.rows] == [("New York", 1)] and e.stats.errors == 2
    sink, dlq = RecordingSink(), RecordingSink()
    dlq_conf = {"on_error": {"policy": "DLQ", "dlq": {"type": "console"}}}
    engine(spark, tmp_path, conf(AGG, pipeline=dlq_conf), sink=sink, dlq=dlq).process(bad)
    assert sorted((r["message"], r["phase"]) for r in dlq.rows) == [("[1]", "handler.write"), ("{!invalidJSON!", "handler.write")]
    assert set(dlq.rows[0].asDict()) == {"error", "message", "phase", "timestamp"}
    dlq = RecordingSink()
    engine(spark, tmp_path, conf("SELECT nothing FROM batch", pipeline=dlq_conf), sink=RecordingSink(), dlq=dlq).process(bad)
    assert [r["phase"] for r in dlq.rows].count("handler.invoke") == 1  # the batch's one good message is kept


def test_sinks(spark, tmp_path, fixture):
    out = io.StringIO()
    ConsoleSink(out).write(spark.createDataFrame([("hello", None)], "greeting string, name string"))
    assert out.getvalue() == '{"greeting": "hello", "name": null}\n'
    sql = f"COPY sink_batch TO '{tmp_path}/out/$id.parquet' (FORMAT 'parquet');"
    sink = {"type": "sqlcommand", "sqlcommand": {"sql": sql, "substitutions": [{"var": "$id", "type": "uuid4"}]}}
    engine(spark, tmp_path, conf("SELECT COUNT(*) as num_records FROM batch", sink=sink)).invoke(fixture(TIMED), write=True)
    [made] = list((tmp_path / "out").iterdir())
    assert spark.read.parquet(str(made)).collect()[0]["num_records"] == 4


def test_streaming_run_restart_and_stats(spark, tmp_path, fixture):
    folder = tmp_path / "stream"
    spark.catalog.dropTempView("batch")  # of other tests
    fixture(EVENTS, "stream/a.json")
    c = conf(AGG, pipeline={"source": {"type": "file", "file": {"path": str(folder)}}})
    sink = RecordingSink()
    stats = engine(spark, tmp_path, c, sink=sink).run(checkpoint=f"{tmp_path}/check", once=True)
    assert stats.messages == 2 and len(sink.rows) == 2 and stats.sink_flushes == 1
    fixture(TIMED, "stream/b.json")
    sink = RecordingSink()
    assert engine(spark, tmp_path, c, sink=sink).run(checkpoint=f"{tmp_path}/check", once=True).messages == 4  # only what is new


def test_window_stream_end_to_end(spark, tmp_path, fixture):
    spark.catalog.dropTempView("batch")
    fixture(TIMED, "stream/a.json")
    c = conf(UPSERT, pipeline={"source": {"type": "file", "file": {"path": str(tmp_path / "stream")}}}, **WINDOW)
    e = engine(spark, tmp_path, c)
    e.managers[0].sink = RecordingSink()
    e.run(once=True)
    assert [r["count"] for r in e.managers[0].sink.rows] == [2, 2]
    assert e.runner.table("agg_cities_count").read().count() == 0


def test_debug_server(spark, tmp_path):
    import urllib.error
    import urllib.request

    from pipequery.streaming.http import DebugServer

    server = DebugServer(engine(spark, tmp_path, conf(AGG)), port=0).start()
    base = f"http://127.0.0.1:{server.port}"
    get = lambda path: urllib.request.urlopen(base + path, timeout=60)
    assert json.load(get("/debug?sql=SELECT%201%20AS%20a")) == [[1]]
    assert b"message_count_total 0" in get("/metrics").read()
    for path, status in (("/debug", 400), ("/debug?sql=SELECT%20nope", 500), ("/x", 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            get(path)
        assert e.value.code == status
    server.close()


def test_webhook(spark, tmp_path):
    import hashlib
    import hmac
    import urllib.error
    import urllib.request

    from pipequery.sources.webhook import Webhook

    server = Webhook(str(tmp_path / "spool"), config.HMAC("X-Sig", "k", "secret"), "127.0.0.1", 0).start()
    body = json.dumps(EVENTS[0], indent=1).encode()

    def post(headers):
        request = urllib.request.Request(f"http://127.0.0.1:{server.port}/events", body, headers)
        try:
            return urllib.request.urlopen(request, timeout=10).status
        except urllib.error.HTTPError as e:
            return e.code

    good = "sha256=" + hmac.new(b"secret", body, hashlib.sha256).hexdigest()
    assert [post({}), post({"X-Sig": "sha256=0"}), post({"X-Sig": good})] == [400, 403, 200]
    time.sleep(0.1)
    server.close()
    assert spark.read.json(str(tmp_path / "spool")).first()["properties"]["city"] == "New York"
    assert server.requests == {400: 1, 403: 1, 200: 1}
