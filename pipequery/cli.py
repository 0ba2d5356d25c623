"""``python -m pipequery``: run, dev invoke, config validate, config example, publish."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

import yaml


def session(name: str = "pipequery"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.ansi.doubleQuotedIdentifiers", "true")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("WARN")
    return spark


def main(argv: list[str] | None = None) -> int:
    from pipequery import config

    logging.basicConfig(level=os.environ.get(f"{config.ENV_PREFIX}LOG_LEVEL", "INFO"))
    parser = argparse.ArgumentParser("pipequery")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="run a pipeline")
    run.add_argument("config")
    run.add_argument("--max-msgs-to-process", type=int)
    run.add_argument("--once", action="store_true", help="stop when what is there is done")
    run.add_argument("--with-http-debug", action="store_true")
    run.add_argument("--metrics", choices=["prometheus"])
    run.add_argument("--checkpoint")
    dev = commands.add_parser("dev", help="for development").add_subparsers(dest="sub", required=True)
    invoke = dev.add_parser("invoke", help="run a pipeline's SQL over a file")
    invoke.add_argument("config")
    invoke.add_argument("fixture")
    conf = commands.add_parser("config", help="configurations").add_subparsers(dest="sub", required=True)
    conf.add_parser("validate").add_argument("config")
    conf.add_parser("example")
    publish = commands.add_parser("publish", help="write synthetic messages to a file or topic")
    publish.add_argument("to", help="a folder, or kafka://broker/topic")
    publish.add_argument("--num-messages", type=int, default=1000)
    publish.add_argument("--kind", choices=["event", "user_action"], default="event")
    args = parser.parse_args(argv)

    if args.command == "config":
        if args.sub == "example":
            print(config.example(), end="")
            return 0
        with open(args.config) as f:
            problems = config.validate(yaml.safe_load(config.render(f.read())))
        print("\n".join(problems) or "valid")
        return int(bool(problems))
    if args.command == "publish":
        from pipequery.sources import synthetic_events

        rows = synthetic_events(session(), args.num_messages, args.kind)
        if args.to.startswith("kafka://"):
            broker, _, topic = args.to.removeprefix("kafka://").partition("/")
            rows.write.format("kafka").option("kafka.bootstrap.servers", broker).option("topic", topic).save()
        else:
            rows.write.mode("append").text(args.to)
        return 0

    from pipequery.streaming.engine import Engine

    loaded = config.load(args.config)
    engine = Engine(session(), loaded)
    if args.command == "dev":
        for row in engine.invoke(args.fixture, collect_windows=bool(engine.managers)):
            print(json.dumps(row.asDict(recursive=True), default=str))
        return 0
    servers = []
    if args.with_http_debug or args.metrics:
        from pipequery.streaming.http import DebugServer

        servers = [DebugServer(engine, p).start() for p in ([5000] * args.with_http_debug + [8000] * bool(args.metrics))]
    stats = engine.run(args.checkpoint, args.once, args.max_msgs_to_process)
    print(json.dumps({"messages": stats.messages, "errors": stats.errors, "messages_per_second": stats.messages_per_second}), file=sys.stderr)
    for s in servers:
        s.close()
    return 0
