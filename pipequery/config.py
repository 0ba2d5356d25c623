"""Pipeline configuration: templates to YAML, YAML to dataclasses, checks, and a commented skeleton."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

import yaml

ENV_PREFIX = "PIPEQUERY_"  #: variables of the environment that templates see
SETTINGS = {"STATIC_ROOT": "/tmp/pipequery/static", "SQL_RESULTS_CACHE_DIR": "/tmp/pipequery/resultscache"}


class ConfigError(ValueError):
    pass


class Policy(Enum):
    RAISE = "raise"
    IGNORE = "ignore"
    DLQ = "dlq"


@dataclass
class SSL:
    ca_location: str | None = None
    certificate_location: str | None = None
    key_location: str | None = None
    key_password: str | None = None
    endpoint_identification_algorithm: str | None = None


@dataclass
class SASL:
    mechanism: str
    username: str
    password: str


@dataclass
class KafkaSource:
    brokers: list[str]
    group_id: str
    auto_offset_reset: str
    topics: list[str]
    security_protocol: str | None = None
    ssl: SSL | None = None
    sasl: SASL | None = None


@dataclass
class WebsocketSource:
    uri: str


@dataclass
class HMAC:
    header: str
    sig_key: str
    secret: str


@dataclass
class WebhookSource:
    signature_type: str | None = None
    hmac: HMAC | None = None


@dataclass
class FileSource:
    path: str


@dataclass
class Source:
    type: str
    kafka: KafkaSource | None = None
    websocket: WebsocketSource | None = None
    webhook: WebhookSource | None = None
    file: FileSource | None = None


@dataclass
class Substitution:
    var: str
    type: str


@dataclass
class SQLCommandSink:
    sql: str
    substitutions: list[Substitution] = field(default_factory=list)
    relation: str = "sink_batch"


@dataclass
class KafkaSink:
    brokers: list[str]
    topic: str
    security_protocol: str | None = None
    ssl: SSL | None = None
    sasl: SASL | None = None


@dataclass
class IcebergSink:
    catalog_name: str
    table_name: str


@dataclass
class ClickhouseSink:
    dsn: str
    table: str


@dataclass
class Sink:
    type: str
    format: str | None = None
    kafka: KafkaSink | None = None
    sqlcommand: SQLCommandSink | None = None
    iceberg: IcebergSink | None = None
    clickhouse: ClickhouseSink | None = None


@dataclass
class TumblingWindow:
    collect_closed_windows_sql: str
    delete_closed_windows_sql: str
    poll_interval_seconds: int = 10


@dataclass
class TableManager:
    tumbling_window: TumblingWindow
    sink: Sink


@dataclass
class TableSQL:
    name: str
    sql: str
    manager: TableManager | None = None


@dataclass
class UDF:
    function_name: str
    import_path: str


@dataclass
class Command:
    name: str
    sql: str


@dataclass
class Handler:
    type: str
    sql: str
    table: str | None = None
    sql_results_cache_dir: str = SETTINGS["SQL_RESULTS_CACHE_DIR"]


@dataclass
class ErrorPolicy:
    policy: Policy = Policy.RAISE
    dlq: Sink | None = None


@dataclass
class Pipeline:
    source: Source
    handler: Handler
    sink: Sink
    batch_size: int = 1
    flush_interval_seconds: int = 30
    on_error: ErrorPolicy = field(default_factory=ErrorPolicy)
    name: str | None = None
    description: str | None = None


@dataclass
class Conf:
    pipeline: Pipeline
    tables: list[TableSQL] = field(default_factory=list)
    udfs: list[UDF] = field(default_factory=list)
    commands: list[Command] = field(default_factory=list)


# --- templates -----------------------------------------------------------------------------------

_VARIABLE = re.compile(r"\{\{\s*(\w+)\s*(?:\|\s*default\(\s*(?:'([^']*)'|\"([^\"]*)\"|([^)'\"]*))\s*\)\s*)?\}\}")


def render(text: str, overrides: dict[str, Any] | None = None, environ: dict[str, str] | None = None, prefix: str = ENV_PREFIX) -> str:
    """``{{ NAME|default(x) }}`` filled in: settings, then the environment's names with the prefix, then overrides; the last wins. A name without value or default is empty."""
    environ = dict(os.environ) if environ is None else environ
    known = SETTINGS | {k: v for k, v in environ.items() if k.startswith(prefix)} | (overrides or {})

    def value(m: re.Match) -> str:
        default = next((g for g in m.groups()[1:] if g is not None), "")
        return str(known.get(m[1], default.strip()))

    return _VARIABLE.sub(value, text)


def load(path: str, overrides: dict[str, Any] | None = None, environ: dict[str, str] | None = None, prefix: str = ENV_PREFIX) -> Conf:
    """The configuration in a file."""
    with open(path) as f:
        return from_dict(yaml.safe_load(render(f.read(), overrides, environ, prefix)))


# --- dictionaries ----------------------------------------------------------------------------------


def _make(cls, d: dict, where: str):
    """A dataclass from a dictionary; unknown and missing keys are errors."""
    names = cls.__dataclass_fields__
    if unknown := set(d) - set(names):
        raise ConfigError(f"{where}: unknown keys {sorted(unknown)}")
    try:
        return cls(**d)
    except TypeError as e:
        raise ConfigError(f"{where}: {e}") from None


def _kafka(cls, d: dict, where: str):
    d = dict(d)
    for name, kind in (("ssl", SSL), ("sasl", SASL)):
        if d.get(name) is not None:
            d[name] = _make(kind, d[name], f"{where}.{name}")
    return _make(cls, d, where)


def source_from(d: dict) -> Source:
    kind = d.get("type")
    part = d.get(kind) or {}
    if kind == "kafka":
        return Source(kind, kafka=_kafka(KafkaSource, part, "source.kafka"))
    if kind == "websocket":
        return Source(kind, websocket=_make(WebsocketSource, part, "source.websocket"))
    if kind == "webhook":
        part = dict(part)
        if part.get("hmac") is not None:
            part["hmac"] = _make(HMAC, part["hmac"], "source.webhook.hmac")
        return Source(kind, webhook=_make(WebhookSource, part, "source.webhook"))
    if kind == "file":
        return Source(kind, file=_make(FileSource, part, "source.file"))
    raise NotImplementedError(f"source type {kind!r}")


SINKS = ("kafka", "console", "sqlcommand", "noop", "iceberg", "clickhouse")


def sink_from(d: dict | None) -> Sink:
    """An absent sink is noop."""
    if not d:
        return Sink("noop")
    kind = d.get("type")
    if kind not in SINKS:
        raise ConfigError(f"sink type {kind!r}: one of {', '.join(SINKS)}")
    form = (d.get("format") or {}).get("type")
    if form not in (None, "parquet"):
        raise ConfigError(f"sink format {form!r}")
    part = dict(d.get(kind) or {})
    if kind == "kafka":
        return Sink(kind, form, kafka=_kafka(KafkaSink, part, "sink.kafka"))
    if kind == "sqlcommand":
        part["substitutions"] = [_make(Substitution, s, "sink.sqlcommand.substitutions") for s in part.get("substitutions") or ()]
        if bad := [s.type for s in part["substitutions"] if s.type != "uuid4"]:
            raise ConfigError(f"substitution type {bad[0]!r}")
        return Sink(kind, form, sqlcommand=_make(SQLCommandSink, part, "sink.sqlcommand"))
    if kind == "iceberg":
        return Sink(kind, form, iceberg=_make(IcebergSink, part, "sink.iceberg"))
    if kind == "clickhouse":
        return Sink(kind, form, clickhouse=_make(ClickhouseSink, part, "sink.clickhouse"))
    return Sink(kind, form)


def from_dict(d: dict) -> Conf:
    """The configuration in a dictionary, checked."""
    if problems := validate(d):
        raise ConfigError("; ".join(problems))
    p = dict(d["pipeline"])
    tables = []
    for t in ((d.get("tables") or {}).get("sql")) or ():
        t = dict(t)
        if manager := t.pop("manager", None):
            window = _make(TumblingWindow, manager["tumbling_window"], "tumbling_window")
            t["manager"] = TableManager(window, sink_from(manager.get("sink")))
        tables.append(_make(TableSQL, t, "tables.sql"))
    on_error = p.pop("on_error", None) or {}
    try:
        policy = Policy[str(on_error.get("policy", "RAISE")).upper()]
    except KeyError:
        raise ConfigError(f"on_error.policy {on_error.get('policy')!r}") from None
    errors = ErrorPolicy(policy, sink_from(on_error["dlq"]) if on_error.get("dlq") else None)
    if policy is Policy.DLQ and errors.dlq is None:
        raise ConfigError("on_error.policy DLQ needs on_error.dlq")
    p |= {"source": source_from(p["source"]), "sink": sink_from(p["sink"]), "handler": _make(Handler, p["handler"], "handler"), "on_error": errors}
    return Conf(
        _make(Pipeline, p, "pipeline"),
        tables,
        [_make(UDF, u, "udfs") for u in d.get("udfs") or ()],
        [_make(Command, c, "commands") for c in d.get("commands") or ()],
    )


#: key: (type, required, note) or a nested dictionary; the skeleton and the checks are made of it
SCHEMA: dict[str, Any] = {
    "commands": (list, False, "SQL run before the pipeline: name, sql"),
    "udfs": (list, False, "Python functions for SQL: function_name, import_path"),
    "tables": (dict, False, "managed tables: sql: [name, sql, manager]"),
    "pipeline": {
        "name": (str, False, "a name"),
        "description": (str, False, "what it does"),
        "batch_size": (int, True, "messages of a batch"),
        "flush_interval_seconds": (int, False, "a batch waits no longer"),
        "source": (dict, True, "type: kafka, websocket, webhook or file, and its part"),
        "handler": (dict, True, "type: handlers.InferredMemBatch, handlers.InferredDiskBatch or handlers.StructuredBatch; sql; table"),
        "sink": (dict, True, "type: kafka, console, sqlcommand, noop, iceberg or clickhouse, and its part"),
        "on_error": (dict, False, "policy: RAISE, IGNORE or DLQ; dlq: a sink"),
    },
}


def validate(d: Any) -> list[str]:
    """What is wrong with a rendered configuration; empty if nothing is."""
    if not isinstance(d, dict):
        return ["the configuration is not a mapping"]
    out = [f"unknown key {k!r}" for k in d if k not in SCHEMA]
    if not isinstance(d.get("pipeline"), dict):
        return [*out, "'pipeline' is missing"]
    rules = SCHEMA["pipeline"]
    out += [f"unknown key 'pipeline.{k}'" for k in d["pipeline"] if k not in rules]
    for part, names in ((d, {k: v for k, v in SCHEMA.items() if k != "pipeline"}), (d["pipeline"], rules)):
        for name, (kind, required, _) in names.items():
            value = part.get(name)
            if value is None:
                if required and name not in part and name != "batch_size":
                    out.append(f"{name!r} is missing")
            elif not isinstance(value, kind):
                out.append(f"{name!r} is not a {kind.__name__}")
    return out


def example() -> str:
    """A commented skeleton of a configuration."""

    def lines(rules: dict, indent: str) -> list[str]:
        out = []
        for name, rule in rules.items():
            if isinstance(rule, dict):
                out += [f"{indent}{name}:", *lines(rule, indent + "  ")]
            else:
                kind, required, note = rule
                empty = {list: "[]", dict: "{}", int: "1", str: "''"}[kind]
                out.append(f"{indent}{name}: {empty}  # {'required, ' if required else ''}{note}")
        return out

    return "\n".join(lines(SCHEMA, "")) + "\n"
