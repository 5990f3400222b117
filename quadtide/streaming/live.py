"""Live windows on Structured Streaming.

Each micro-batch's quads go to a part of their own, a folder of Parquet files beside the checkpoint. When
all streams have passed a window's end, its content is read from the parts that can hold some of it and
goes through the same batch plan that replays use. So a quad is written once, however many windows it is
in, a stream and its replay give the same results, and nothing of a window is kept in executors' memory.

Parts that no open window needs are dropped; many small ones are merged. What is kept after a micro-batch
(parts, how far each stream is, up to where windows have closed) is a small file, a mark, so a query that is started again
from its checkpoint goes on from the last one that was finished.
"""

from __future__ import annotations

import json
import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import LiveError
from ..model import QUAD, typed, valid_iri
from ..operators import r2s, windows
from ..plans.ast import Group, HybridQuery, WindowSpec, bodies, wanted_predicates
from ..plans.compiler import Dataset, Plan, presented
from ..plans.hybrid import _rewrite, split, stamped, streamed
from ..plans.parser import parse_hybrid
from ..workspace import remove, scratch, write_text

SENTINEL = "urn:quadtide:sentinel"
#: Results that wait in a query's queue, at most; static predicates that a query plans with, at most.
MOST_RESULTS, MOST_PREDICATES = 100_000, 1000
#: Parts of a live query's content beyond which the smaller half is merged, and rows of a merged part's file.
MOST_PARTS, PART_ROWS = 32, 1_000_000
#: Rows of content from which on repeated quads are looked for before quads are put into windows, and the most
#: that are then made a set by themselves.
LOOK_ROWS, MOST_REPEATS = 1_000_000, 100_000


def _milliseconds(n: int) -> str:
    return f"{n} milliseconds"


def assigned(stream: DataFrame, spec: WindowSpec, reach: int = 0, lateness: str = "0 seconds") -> DataFrame:
    """The stream's quads with w, a column of windows that end where spec's instances do and begin `reach`
    before them. stream: quads."""
    timed = stream.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", lateness)
    length, slide = spec.width + reach, spec.slide
    if slide <= length:
        at = F.window("ts", _milliseconds(length), _milliseconds(slide), _milliseconds(-reach % slide))
    else:  # windows with gaps: tumble by the slide and drop what falls into the gap
        # by the event time column itself, or the filter goes below the watermark, which then misses events
        timed = timed.where(F.pmod(F.unix_millis("ts") - spec.width, F.lit(slide)) >= slide - length)
        at = F.window("ts", _milliseconds(slide), _milliseconds(slide), _milliseconds(spec.width % slide))
    return timed.withColumn("w", at)


def closed_windows(streams: list[tuple[WindowSpec, DataFrame, set[str] | None]], lateness: str = "0 seconds") -> DataFrame:
    """Closed windows as a stream for other sinks, kept in Spark's state store, a state row for each quad of
    each window; LiveQuery keeps parts of files instead, which takes far less for large windows. Rows are
    (by, src, ws, we, at_ms, last_ms and a quad), when the watermark passes a window's end: the content of
    each instance of window `by` as far as it comes from the stream of window `src`. last_ms: the last
    time of the quad; where src is another window than by, each time of it is a row of its own, at_ms.

    streams: for each window its stream and the predicates that its patterns can match (None: any). Of
    other quads only the last time is kept, in a row without a quad; nothing is dropped before the
    aggregation, as what a filter drops wouldn't move the watermark."""
    parts = []
    for by, (spec, _, _) in enumerate(streams):
        for src, (other, stream, predicates) in enumerate(streams):
            found = assigned(stream, spec, 0 if src == by else other.width, lateness)
            real = ~F.col("s").startswith(SENTINEL)
            wanted = real if predicates is None else real & F.col("p").isin(*predicates)
            at = F.when(wanted & F.lit(src != by), F.col("ts_ms"))
            parts.append(found.select("w", F.lit(by).alias("by"), F.lit(src).alias("src"), at.alias("at_ms"), F.when(wanted, F.struct(*windows.TERMS)).alias("quad"), F.when(real, F.col("ts_ms")).alias("ts_ms")))
    both = reduce(DataFrame.unionByName, parts)
    kept = both.groupBy("w", "by", "src", "at_ms", "quad").agg(F.max("ts_ms").alias("last_ms")).where("last_ms IS NOT NULL")
    widths = F.element_at(F.array(*(F.lit(spec.width) for spec, _, _ in streams)), F.col("by") + 1)
    we = F.unix_millis("w.end")
    return kept.select("by", "src", (we - widths).alias("ws"), we.alias("we"), "at_ms", "last_ms", "quad")


def taken(streams: list[tuple[DataFrame, set[str] | None]]) -> DataFrame:
    """What a query keeps of its streams: (src, ts_ms, real and a quad). real: not a sentinel. Quads that no
    pattern can match (predicates; None: any) count for the times alone and lose their terms."""
    parts = []
    for src, (stream, predicates) in enumerate(streams):
        real = F.coalesce(~F.col("s").startswith(SENTINEL), F.lit(False))
        wanted = real if predicates is None else real & F.col("p").isin(*predicates)
        parts.append(stream.where("ts_ms IS NOT NULL").select(F.lit(src).alias("src"), "ts_ms", real.alias("real"), *(F.when(wanted, F.col(c)).alias(c) for c in windows.TERMS)))
    return reduce(DataFrame.unionByName, parts)


def ends_between(spec: WindowSpec, after: int | None, upto: int) -> bool:
    """Whether an instance of the window ends in (after, upto]."""
    return after is None or (upto - spec.width) // spec.slide > (after - spec.width) // spec.slide


class LiveQuery:
    """A hybrid query's live part, running over streaming DataFrames of quads by stream IRI.

    on_result is called in the driver with each micro-batch's result DataFrame; without it, rows are
    put into a queue that receive() and try_receive() read."""

    def __init__(self, query: HybridQuery | str, streams: dict[str, DataFrame], static: DataFrame | None = None, on_result: Callable[[DataFrame], None] | None = None, lateness: str = "0 seconds", checkpoint: str | None = None, style: str = "plain", trigger: dict | None = None):
        self.query = parse_hybrid(query) if isinstance(query, str) else query
        if not self.query.live_windows:
            raise LiveError("the query has no live window")
        self.streams, self.static, self.style = streams, static, style
        self.lateness, self.checkpoint, self.trigger = lateness, checkpoint, trigger or {"availableNow": True}
        self.results: queue.Queue = queue.Queue(MOST_RESULTS)
        self._stopped = threading.Event()
        self.on_result = on_result or self._enqueue
        self.plan = split(self.query).live
        self.plan.where = _rewrite(self.plan.where)
        self.static_predicates: frozenset[str] | None = None
        self.running: list = []

    def _enqueue(self, out: DataFrame) -> None:
        """Results wait for their reader once MOST_RESULTS are there; stopping the query lets go."""
        for row in out.toLocalIterator():
            while not self._stopped.is_set():
                try:
                    self.results.put(row.asDict(), timeout=0.2)
                    break
                except queue.Full:
                    pass

    def start(self) -> LiveQuery:
        if self.running:
            raise LiveError("the query runs already")
        streams = []
        for w in self.query.live_windows:
            if w.stream not in self.streams:
                raise LiveError(f"the stream {w.stream} isn't registered")
            streams.append((w, self.streams[w.stream], wanted_predicates(Group(bodies(self.plan.where, w.name)))))
        spark = streams[0][1].sparkSession
        self.use_static(self.static)
        at = self.checkpoint or scratch(spark, "live")
        self.held, self.at, self.mark = f"{at}/changes", f"{at}/content", None
        self.late_ms = spark.range(1).select(F.unix_millis(F.timestamp_millis(F.lit(0)) + F.expr(f"INTERVAL '{self.lateness}'"))).first()[0]
        self.wanted = {w.name: names for w, _, names in streams}
        self.uris = list(dict.fromkeys(w.stream for w, *_ in streams))
        both = []
        for uri in self.uris:
            names = [self.wanted[w.name] for w, *_ in streams if w.stream == uri]
            both.append((self.streams[uri], None if None in names else set().union(*names)))
        writer = taken(both).writeStream.option("checkpointLocation", f"{at}/taken").trigger(**self.trigger)
        self.running.append(writer.foreachBatch(self._take).start())
        return self

    def use_static(self, static: DataFrame | None) -> None:
        """The static quads from the next micro-batch on."""
        predicates = None
        if static is not None:
            found = static.where("g = ''").select("p").distinct().limit(MOST_PREDICATES + 1).collect()
            predicates = frozenset(r[0] for r in found) if len(found) <= MOST_PREDICATES else None
        self.static, self.static_predicates = static, predicates

    def _take(self, batch: DataFrame, number: int) -> None:
        """Keeps a micro-batch's quads, and evaluates the windows that close with it."""
        spark, specs = batch.sparkSession, self.query.live_windows
        before = self._before(spark, number)
        name = f"{number:09d}"
        batch.write.mode("overwrite").parquet(f"{self.at}/{name}")
        found = spark.read.schema(batch.schema).parquet(f"{self.at}/{name}").groupBy("src").agg(F.min("ts_ms"), F.max("ts_ms"), F.count(F.lit(1))).collect()
        parts, seen, after = list(before["parts"]), dict(before["seen"]), before["closed"]
        if found:
            parts.append({"name": name, "high": max(r[2] for r in found), "rows": sum(r[3] for r in found)})
        for src, _, high, _ in found:
            seen[str(src)] = max(high, seen.get(str(src), high))
        upto = min(seen.values()) - self.late_ms if len(seen) == len(self.uris) else None
        # content that windows ending after some time can hold begins so long before it
        reach = max(w.width for w in specs) * (1 if len(specs) == 1 else 2)
        if upto is None or after is not None and upto <= after:
            upto = after
        elif any(ends_between(w, after, upto) for w in specs):
            low = None if after is None else after - reach
            many = sum(p["rows"] for p in parts if low is None or p["high"] >= low)
            self._fire(self._content(spark, batch.schema, parts, low).where(F.col("ts_ms") < upto), after, upto, number, many)
        if upto is not None:
            parts = [p for p in parts if p["high"] >= upto - reach]
        if len(parts) > MOST_PARTS:
            parts = self._merged(spark, batch.schema, parts, None if upto is None else upto - reach, f"{name}-merged")
        self._finish(spark, number, {"parts": parts, "seen": seen, "closed": upto})

    def _content(self, spark: SparkSession, schema, parts: list[dict], low: int | None) -> DataFrame:
        """The rows of parts, from a time on."""
        paths = [f"{self.at}/{p['name']}" for p in parts if low is None or p["high"] >= low]
        rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
        return rows if low is None else rows.where(F.col("ts_ms") >= low)

    def _merged(self, spark: SparkSession, schema, parts: list[dict], low: int | None, name: str) -> list[dict]:
        """The smaller half of the parts as one: a row is written again about once each time the content doubles."""
        small = sorted(parts, key=lambda p: p["rows"])[: len(parts) // 2 + 1]
        rows = sum(p["rows"] for p in small)
        self._content(spark, schema, small, low).coalesce(rows // PART_ROWS + 1).write.mode("overwrite").parquet(f"{self.at}/{name}")
        return [p for p in parts if p not in small] + [{"name": name, "high": max(p["high"] for p in small), "rows": rows}]

    def _before(self, spark: SparkSession, number: int) -> dict:
        """The mark of the last micro-batch before this one; what it doesn't name goes, as no micro-batch
        from this one on, run again or not, reads that."""
        root = spark._jvm.org.apache.hadoop.fs.Path(self.at)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        last = max((n for n in names if n.endswith(".json") and int(n[:-5]) < number), default=None)
        if self.mark is None and last is not None:
            file = fs.open(spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{last}"))
            self.mark = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
            file.close()
        mark = self.mark or {"parts": [], "seen": {}, "closed": None}
        for n in set(names) - {p["name"] for p in mark["parts"]} - {last}:
            remove(spark, f"{self.at}/{n}")
        return mark

    def _finish(self, spark: SparkSession, number: int, mark: dict) -> None:
        write_text(spark, self.at, f"{number:09d}.json", json.dumps(mark))
        self.mark = mark

    def _fire(self, rows: DataFrame, after: int | None, upto: int, number: int, many: int = 0) -> None:
        """Evaluates the windows that end in (after, upto]. rows: all that can be in them, at most `many`."""
        streams = []
        for w in self.query.live_windows:
            mine = rows.where((F.col("src") == self.uris.index(w.stream)) & F.col("real"))
            streams.append((w, mine.select("ts_ms", *windows.TERMS), self.wanted[w.name]))
        if all(windows.ending(windows.assign_live(q.select("ts_ms"), w.width, w.slide), (after, upto)).isEmpty() for w, q, _ in streams):
            return
        found, sets = None, windows.as_set
        if len(streams) == 1 and many >= LOOK_ROWS:
            _, quads, names = streams[0]
            at = f"{self.at}/{number:09d}-repeated"
            windows.repeated(quads if names is None else quads.where(F.col("p").isin(*names))).write.mode("overwrite").parquet(at)
            found = rows.sparkSession.read.schema("_name long").parquet(at)
            repeats = found.count()
            if repeats <= MOST_REPEATS:
                sets = lambda quads, *keys: windows.as_set_but(quads, found if repeats else None, *keys)
        out = self.evaluate(windows.closing_datasets(streams, (after, upto), sets))
        operator = self.query.operator.lower()
        self.on_result(out.drop("by") if operator in ("rstream", "stream") else self._changes(out, number))
        if found is not None:
            remove(rows.sparkSession, at)

    def evaluate(self, data: dict[str, Dataset]) -> DataFrame:
        """The live plan over closed windows: every result, with stamps and, of several windows, `by`."""
        specs = self.query.live_windows
        static = None if self.static is None else self.static.select(*windows.TERMS)
        for w in specs:
            data[w.name].extra_graphs = (w.stream,)
            data[w.name].static, data[w.name].static_predicates = static, self.static_predicates
        first = data[specs[0].name].quads
        outer = Dataset(static if static is not None else first.select(*windows.TERMS).where(F.lit(False)))
        rel = Plan(outer, data).select(self.plan)
        return stamped(presented(rel, self.style).join(data[specs[0].name].stamps, list(rel.keys)), self.query)

    def _changes(self, out: DataFrame, number: int) -> DataFrame:
        """What IStream or DStream says of the windows that closed, given the results of the last ones
        before, which are kept as a table beside the query's checkpoint, one for each micro-batch.

        IStream: results that the window before doesn't have. DStream: results of the window before
        that the closed one doesn't have, under the window that had them; so the last closed window's
        are not known to be lost until another window closes."""
        spark = out.sparkSession
        out.write.mode("overwrite").parquet(f"{self.held}/{number:09d}-now")
        now = spark.read.schema(out.schema).parquet(f"{self.held}/{number:09d}-now").withColumn("_new", F.lit(True))
        both, last = now, self._last(spark, number)
        if last is not None:
            both = both.unionByName(spark.read.schema(out.schema).parquet(last).withColumn("_new", F.lit(False)))
        names = ["by"] if "by" in out.columns else []
        top = both.groupBy(*names).agg(F.max("ws").alias("_top"))
        at = both.join(top, names) if names else both.crossJoin(top)  # one row: the newest window
        kept = at.where("ws = _top").drop("_top", "_new")
        kept.write.mode("overwrite").parquet(f"{self.held}/{number:09d}")
        if self.query.operator.lower() == "istream":
            found = streamed(both.drop("_new"), self.query)
            fresh = now.select("ws", "we").distinct()
            return found.join(fresh, ["ws", "we"], "left_semi").select(*found.columns)
        decided = at.where("ws < _top").select(*names, "ws", "we").distinct()
        lost = r2s.apply("dstream", both.drop("_new"), self._slide(out))
        lost = lost.join(decided, [*names, "ws", "we"], "left_semi")
        return lost.select(*[c for c in out.columns if c != "by"])

    def _slide(self, out: DataFrame):
        slides = [w.slide for w in self.query.live_windows]
        return F.element_at(F.array(*(F.lit(s) for s in slides)), F.col("by") + 1) if "by" in out.columns else slides[0]

    def _last(self, spark: SparkSession, number: int) -> str | None:
        """The table kept by the last micro-batch before this one that had results."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.held)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        before = sorted(n for n in names if n.isdigit() and int(n) < number)
        for old in before[:-2]:  # a batch that is run again needs the one before it
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{self.held}/{old}"), True)
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{self.held}/{old}-now"), True)
        return f"{self.held}/{before[-1]}" if before else None

    # -- pulling results
    def receive(self, timeout: float | None = None) -> dict | None:
        """The next result; waits for it, up to timeout seconds."""
        end = None if timeout is None else time.monotonic() + timeout
        while True:
            try:
                return self.results.get(timeout=0.05)
            except queue.Empty:
                if (end is not None and time.monotonic() >= end) or (not self.active() and self.results.empty()):
                    return None

    def try_receive(self) -> dict | None:
        try:
            return self.results.get_nowait()
        except queue.Empty:
            return None

    def collect_results(self, most: int | None = None) -> list[dict]:
        out = []
        while most is None or len(out) < most:
            row = self.try_receive()
            if row is None:
                return out
            out.append(row)
        return out

    def active(self) -> bool:
        return any(q.isActive for q in self.running)

    def await_end(self) -> None:
        """Waits until every stream is used up (with the availableNow trigger); raises what failed. Results
        beyond MOST_RESULTS must be read meanwhile."""
        for q in self.running:
            q.awaitTermination()

    def stop(self) -> None:
        self._stopped.set()
        for q in self.running:
            q.stop()
        self.running = []


class StreamInput:
    """A stream that is fed quad by quad: events become JSON files in a folder that a file stream reads."""

    def __init__(self, spark: SparkSession, uri: str, folder: str | None = None):
        self.spark, self.uri = spark, uri
        self.folder = folder or scratch(spark, "stream")
        self._files, self.closed = 0, False
        spark.createDataFrame([], QUAD).write.mode("ignore").json(self.folder + "/start")

    def add(self, ts_ms: int, s: str, p: str, o: str, g: str = "") -> None:
        self.add_all([(ts_ms, s, p, o, g)])

    def add_all(self, rows: Iterable[tuple[int, str, str, str, str]], one_time: bool = False) -> None:
        """one_time: all quads get the first one's time."""
        if self.closed:
            raise LiveError(f"the stream {self.uri} is closed")
        rows = list(rows)
        if not rows:
            return
        if any(not 0 <= r[0] < 2**63 for r in rows):
            raise LiveError("a time doesn't fit into 63 bits")
        for _, s, p, _, g in rows:
            bad = next((x for x in (s, p, *([g] if g and g != "default" else [])) if not valid_iri(x)), None)
            if bad is not None:
                raise LiveError(f"invalid IRI: {bad!r}")
        if one_time:
            rows = [(rows[0][0], *r[1:]) for r in rows]
        self._put(rows)

    def _put(self, rows) -> None:
        name = f"{self._files:09d}-{uuid.uuid4().hex}.json"
        self._files += 1
        write_text(self.spark, self.folder, name, "\n".join(json.dumps(dict(zip(("ts_ms", "s", "p", "o", "g"), r))) for r in rows))

    def close(self, final_ms: int) -> None:
        """A last event that carries the watermark past final_ms, so that windows up to it close."""
        self._put([(final_ms, SENTINEL, SENTINEL, SENTINEL, "")])
        self.closed = True

    def read(self, max_files: int | None = None, arrival_time: bool = False) -> DataFrame:
        """The stream as typed quads. arrival_time: events take the time at which they are read and
        lose their graph, as from a broker that carries neither."""
        reader = self.spark.readStream.schema("ts_ms long, s string, p string, o string, g string")
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        raw = reader.json(self.folder)
        if arrival_time:
            raw = raw.withColumn("ts_ms", F.unix_millis(F.current_timestamp())).withColumn("g", F.lit(""))
        return typed(raw, live=True)


class LiveProcessor:
    """Registers streams, adds events and static data, and runs one live query over them."""

    def __init__(self, spark: SparkSession, query: str | HybridQuery, **options):
        self.spark = spark
        self.query = parse_hybrid(query) if isinstance(query, str) else query
        if not self.query.live_windows:
            raise LiveError("the query has no live window")
        self.inputs: dict[str, StreamInput] = {}
        self.static: list[tuple] = []
        self.options, self.live = options, None

    def register_stream(self, uri: str) -> StreamInput:
        if uri not in {w.stream for w in self.query.live_windows}:
            raise LiveError(f"the query doesn't read the stream {uri}")
        return self.inputs.setdefault(uri, StreamInput(self.spark, uri))

    def _input(self, uri: str) -> StreamInput:
        if uri not in self.inputs:
            raise LiveError(f"the stream {uri} isn't registered")
        return self.inputs[uri]

    def add_event(self, uri: str, ts_ms: int, s: str, p: str, o: str, g: str = "") -> None:
        self._input(uri).add(ts_ms, s, p, o, g)

    def add_events(self, uri: str, rows: Iterable[tuple]) -> None:
        """A batch: all quads get the first one's time."""
        self._input(uri).add_all(rows, one_time=True)

    def close_stream(self, uri: str, final_ms: int) -> None:
        self._input(uri).close(final_ms)

    def add_static(self, s: str, p: str, o: str, g: str = "") -> None:
        self.static.append((0, s, p, o, g))

    def start(self) -> LiveQuery:
        static = typed(self.spark.createDataFrame(self.static, "ts_ms long, s string, p string, o string, g string")) if self.static else None
        given = self.options.pop("static", None)
        if given is not None:
            static = given if static is None else given.unionByName(static)
        if static is not None:
            static = static.dropDuplicates(["s", "p", "o", "g"])
        self.live = LiveQuery(self.query, {u: i.read() for u, i in self.inputs.items()}, static, **self.options)
        return self.live.start()


__all__ = ["LiveProcessor", "LiveQuery", "StreamInput", "closed_windows"]
