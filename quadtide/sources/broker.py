"""Brokers: mapping of stream URIs, a file-backed broker, and MQTT where a client library is there.

The file-backed broker keeps a topic as a folder of line files, so publishers and streaming readers
in different processes meet through any shared file system. Kafka is a built-in source of Spark and
needs nothing here but `kafka_quads`.
"""

from __future__ import annotations

import queue
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ReplayError
from ..model import typed
from ..workspace import scratch, write_text
from .nquads import parse_lines

DEFAULT_PORT = 1883
#: Lines that a queue gives at once, at most.
POLLED = 10_000


def parse_broker_uri(uri: str) -> tuple[str, int, str]:
    """(host, port, topic). mqtt:// and mqtts:// name a broker, an empty path is the topic "default";
    any other URI means localhost and the last segment of its path."""
    parts = urlsplit(uri)
    if parts.scheme in ("mqtt", "mqtts"):
        try:
            port = parts.port or DEFAULT_PORT
        except ValueError:
            port = DEFAULT_PORT
        return parts.hostname or "localhost", port, parts.path.strip("/") or "default"
    tail = uri.rstrip("/").rsplit("/", 1)[-1].rsplit("#", 1)[-1]
    return "localhost", DEFAULT_PORT, tail or "default"


@dataclass(frozen=True)
class FileBroker:
    """Topics as folders below a root."""

    root: str

    def folder(self, topic: str) -> Path:
        return Path(self.root) / topic.replace("/", "__")

    def publish(self, topic: str, lines: list[str]) -> None:
        folder = self.folder(topic)
        folder.mkdir(parents=True, exist_ok=True)
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.nq"
        hidden = folder / f"_{name}"
        hidden.write_text("\n".join(lines) + "\n", encoding="utf-8")
        hidden.rename(folder / name)

    def subscribe(self, spark: SparkSession, topic: str, arrival_time: bool = False, max_files: int | None = None) -> DataFrame:
        """The topic as a stream of quads. arrival_time: events take the time of reading and lose their graph."""
        self.folder(topic).mkdir(parents=True, exist_ok=True)
        reader = spark.readStream
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        quads = parse_lines(reader.text(str(self.folder(topic)))).where("error IS NULL")
        if arrival_time:
            quads = quads.withColumn("ts_ms", F.unix_millis(F.current_timestamp())).withColumn("g", F.lit(""))
        return typed(quads)


def kafka_quads(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """A Kafka topic of N-Quads lines as a stream of quads (needs Spark's Kafka package on the class path)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load()
    return typed(parse_lines(raw.select(F.col("value").cast("string").alias("value"))).where("error IS NULL"))


# --- a generic stream source: anything that can be polled for lines ------------------------------------

class LineSource:
    """Base of stream sources: poll() returns new lines since the last call; subscribe() calls back."""

    def __init__(self):
        self._stopped = False

    def poll(self) -> list[str]:
        raise NotImplementedError

    def subscribe(self, topics: list[str], callback: Callable[[str, str], None], every_s: float = 0.1) -> None:
        """Calls callback(topic, line) until stop(); the topic is the first one unless poll gives pairs."""
        while not self._stopped:
            for item in self.poll():
                topic, line = item if isinstance(item, tuple) else (topics[0] if topics else "default", item)
                callback(topic, line)
            time.sleep(every_s)

    def stop(self) -> None:
        self._stopped = True


class QueueSource(LineSource):
    """Lines that other threads put, at most `most` waiting: put() then waits, and so does who calls it."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self._lines: queue.Queue = queue.Queue(most)

    def put(self, line: str, topic: str | None = None) -> None:
        self._lines.put(line if topic is None else (topic, line))

    def poll(self) -> list:
        out = []
        try:
            while len(out) < POLLED:
                out.append(self._lines.get_nowait())
        except queue.Empty:
            pass
        return out


def _mqtt_client(host: str, port: int):
    try:
        import paho.mqtt.client as mqtt
    except ImportError:
        raise ReplayError("MQTT needs the client library paho-mqtt") from None
    client = mqtt.Client(mqtt.CallbackAPIVersion.VERSION2)
    client.reconnect_delay_set(1, 1)
    client.connect(host, port)
    return client


class MqttSource(QueueSource):
    """An MQTT subscriber, if the client library paho is installed."""

    def __init__(self, host: str, port: int, topic: str):
        super().__init__()
        self._client = _mqtt_client(host, port)
        self._client.on_message = lambda c, u, m: self.put(m.payload.decode("utf-8", "replace"), m.topic)
        self._client.on_connect = lambda c, *a: c.subscribe(topic, qos=1)
        self._client.loop_start()

    def stop(self) -> None:
        super().stop()
        self._client.loop_stop()


class MqttPublisher:
    """Publishes lines to an MQTT broker; a line that isn't acknowledged is an error."""

    def __init__(self, host: str, port: int, wait_s: float = 10.0):
        self._client, self._wait = _mqtt_client(host, port), wait_s
        self._client.loop_start()

    def publish(self, topic: str, lines: list[str]) -> None:
        sent = [self._client.publish(topic, line, qos=1) for line in lines]
        for m in sent:
            m.wait_for_publish(self._wait)
            if m.rc or not m.is_published():
                raise ReplayError(f"the broker didn't take a line for {topic}")

    def stop(self) -> None:
        self._client.loop_stop()


# --- any source of lines as a stream of quads -------------------------------------------------------------

class LineStream:
    """A source's lines as a stream of quads. A thread polls the source and puts what came as files into
    a folder of the shared file system; Spark's file stream reads them, each once, also after a restart.

    arrival_time: events take the time at which their line came and lose their graph, as from a broker
    that carries neither."""

    def __init__(self, spark: SparkSession, source: LineSource, topics: list[str], folder: str | None = None, arrival_time: bool = True, every_s: float = 0.1):
        self.spark, self.source, self.topics, self.every_s = spark, source, topics, every_s
        self.folder, self.arrival_time = folder or scratch(spark, "broker"), arrival_time
        self.lines = 0
        self.failure: Exception | None = None
        write_text(spark, self.folder, "_start", "")
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def start(self) -> LineStream:
        self._thread.start()
        return self

    def _run(self) -> None:
        while not self._stop.is_set():
            try:
                got = [x if isinstance(x, str) else x[1] for x in self.source.poll()]
                if got:
                    now = int(time.time() * 1000)
                    body = "\n".join(f"{now}\t{line}" for text in got for line in text.splitlines())
                    write_text(self.spark, self.folder, f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.txt", body)
                    self.lines += len(got)
            except Exception as e:
                self.failure = e
                return
            if not got:
                self._stop.wait(self.every_s)

    def quads(self, max_files: int | None = None) -> DataFrame:
        reader = self.spark.readStream
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        raw = reader.text(self.folder)
        came = F.split_part("value", F.lit("\t"), F.lit(1)).try_cast("long").alias("came")
        raw = raw.select(came, F.substr("value", F.instr("value", "\t") + 1).alias("value"))
        quads = parse_lines(raw).where("error IS NULL")
        if self.arrival_time:
            quads = quads.withColumn("ts_ms", F.col("came")).withColumn("g", F.lit(""))
        return typed(quads)

    def stop(self) -> None:
        self._stop.set()
        self.source.stop()
        if self._thread.is_alive():
            self._thread.join(timeout=10)


def file_connector(spark: SparkSession, broker: FileBroker, arrival_time: bool = True) -> Callable[[str], DataFrame]:
    """Gives the stream of a stream IRI from a file broker's topic, for Engine(connect=...)."""
    return lambda uri: broker.subscribe(spark, parse_broker_uri(uri)[2], arrival_time)


def mqtt_connector(spark: SparkSession, source: Callable[[str, int, str], LineSource] = MqttSource) -> Callable[[str], DataFrame]:
    """Gives the stream of a stream IRI from the MQTT broker that it names, for Engine(connect=...). Each
    topic is subscribed once."""
    open_: dict[tuple[str, int, str], LineStream] = {}

    def connect(uri: str) -> DataFrame:
        at = parse_broker_uri(uri)
        if at not in open_:
            open_[at] = LineStream(spark, source(*at), [at[2]]).start()
        return open_[at].quads()

    connect.open = open_
    return connect
