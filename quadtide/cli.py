"""Command line: `python -m quadtide.cli serve|replay|query|info`."""

from __future__ import annotations

import argparse
import json
import sys
import time

from .session import session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quadtide", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    s = sub.add_parser("serve", help="run the HTTP and WebSocket server")
    s.add_argument("--host", default="127.0.0.1")
    s.add_argument("--port", type=int, default=8080)
    s.add_argument("--storage-dir", default="./data")
    s.add_argument("--broker-dir", default="./broker")
    s.add_argument("--flush-interval-s", type=float, default=5.0)
    s.add_argument("--max-batch-events", type=int, default=100_000)
    s.add_argument("--max-queries", type=int)
    s.add_argument("--stream", action="append", default=[], help="IRI of a stream whose topic in the broker folder is read")

    r = sub.add_parser("replay", help="replay an N-Quads file to a broker folder and the log")
    r.add_argument("--input", required=True)
    r.add_argument("--broker", choices=("none", "file", "mqtt"), default="none")
    r.add_argument("--topics", default="default", help="comma-separated; the first is published to")
    r.add_argument("--rate", type=int, default=0, help="events a second, 0 for no limit")
    r.add_argument("--loop", action="store_true")
    r.add_argument("--add-timestamps", action="store_true")
    r.add_argument("--storage-path", default="./data")
    r.add_argument("--broker-dir", default="./broker")
    r.add_argument("--mqtt-host", default="localhost")
    r.add_argument("--mqtt-port", type=int, default=1883)
    r.add_argument("--bulk", action="store_true", help="load by a distributed job, without a rate")

    q = sub.add_parser("query", help="evaluate a hybrid or SPARQL query over a log")
    q.add_argument("--storage-path", default="./data")
    q.add_argument("--file", required=True, help="the query's text; - for standard input")
    q.add_argument("--now", type=int, help="the time that sliding windows end at, in milliseconds")
    q.add_argument("--limit", type=int, default=100)

    i = sub.add_parser("info", help="what a log holds")
    i.add_argument("--storage-path", default="./data")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from .sources.log import LogConfig, QuadLog

    spark = session()
    if args.command == "serve":
        from .api import Engine, QueryRegistry
        from .server import serve
        from .sources.broker import FileBroker, parse_broker_uri

        log = QuadLog(spark, args.storage_dir, LogConfig(max_events=args.max_batch_events, max_age_s=args.flush_interval_s))
        log.start_background()
        broker = FileBroker(args.broker_dir)
        streams = {uri: (lambda uri=uri: broker.subscribe(spark, parse_broker_uri(uri)[2])) for uri in args.stream}
        engine = Engine(spark, log, streams, registry=QueryRegistry(args.max_queries), live_options={"trigger": {"processingTime": "1 second"}})
        server = serve(engine, args.host, args.port, args.broker_dir)
        print(f"listening on http://{args.host}:{args.port}", flush=True)
        try:
            while True:
                time.sleep(1)
        except KeyboardInterrupt:
            server.shutdown()
            engine.close()
            log.close()
        return 0
    log = QuadLog(spark, args.storage_path)
    if args.command == "replay":
        from .sources.broker import FileBroker, MqttPublisher
        from .sources.replay import Replay, ReplayConfig, bulk_load

        if args.bulk:
            m = bulk_load(spark, args.input, log)
        else:
            topics = tuple(t.strip() for t in args.topics.split(",") if t.strip())
            broker = {"none": lambda: None, "file": lambda: FileBroker(args.broker_dir), "mqtt": lambda: MqttPublisher(args.mqtt_host, args.mqtt_port)}[args.broker]()
            m = Replay(ReplayConfig(args.input, topics, args.rate, args.loop, args.add_timestamps), log, broker).run()
        print(json.dumps({"events_read": m.events_read, "events_published": m.events_published, "events_stored": m.events_stored, "publish_errors": m.publish_errors, "storage_errors": m.storage_errors, "events_per_second": round(m.events_per_second, 1), "elapsed_seconds": round(m.elapsed_seconds, 3)}))
        return 0
    if args.command == "info":
        from pyspark.sql import functions as F

        r = log.quads().agg(F.count(F.lit(1)).alias("quads"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.approx_count_distinct("p").alias("predicates")).first()
        print(json.dumps(r.asDict()))
        return 0
    text = sys.stdin.read() if args.file == "-" else open(args.file, encoding="utf-8").read()
    if "WINDOW" in text.upper():
        from .plans.hybrid import HybridEvaluation

        out = HybridEvaluation(text, log=log, now_ms=args.now).historical()
    else:
        from .sparql import query

        out = query(log.quads(), text)
    for row in out.limit(args.limit).toLocalIterator():
        print(json.dumps(row.asDict(), default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
