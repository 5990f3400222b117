"""The engine: registration and life cycle of hybrid queries, and one stream of results for each."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ExecutionError, InvalidState, QueryExists, QueryNotFound, TooManyQueries
from .plans.ast import HybridQuery
from .plans.hybrid import HybridEvaluation
from .plans.parser import parse_hybrid
from .sources.log import QuadLog
from .streaming.live import LiveQuery
from .workspace import materialize


class Status(Enum):
    REGISTERED = "Registered"
    WARMING_BASELINE = "WarmingBaseline"
    RUNNING = "Running"
    STOPPED = "Stopped"
    FAILED = "Failed"
    COMPLETED = "Completed"


@dataclass
class QueryResult:
    """source: "Historical" or "Live"; bindings: variable to term, N-Triples for historical results and
    bare lexical forms for live ones unless a style is asked for."""

    query_id: str
    timestamp: int
    source: str
    bindings: list[dict[str, str]]


@dataclass
class QueryMetadata:
    query_id: str
    query_text: str
    parsed: HybridQuery
    baseline_mode: str = "aggregate"
    registered_at: int = field(default_factory=lambda: int(time.time()))
    execution_count: int = 0
    status: Status = Status.REGISTERED
    subscribers: list[str] = field(default_factory=list)
    error: str = ""


class QueryRegistry:
    """Registered queries by id."""

    def __init__(self, max_queries: int | None = None):
        self.max_queries = max_queries
        self._queries: dict[str, QueryMetadata] = {}
        self._lock = threading.RLock()

    def register(self, query_id: str, text: str, baseline_mode: str = "aggregate") -> QueryMetadata:
        if baseline_mode not in ("aggregate", "last"):
            raise InvalidState(f"unknown baseline mode {baseline_mode!r}: aggregate or last")
        parsed = parse_hybrid(text)
        with self._lock:
            if query_id in self._queries:
                raise QueryExists(f"the query {query_id} is registered already")
            if self.max_queries is not None and len(self._queries) >= self.max_queries:
                raise TooManyQueries(f"there are {self.max_queries} queries already")
            self._queries[query_id] = QueryMetadata(query_id, text, parsed, baseline_mode)
            return self._queries[query_id]

    def get(self, query_id: str) -> QueryMetadata:
        with self._lock:
            if query_id not in self._queries:
                raise QueryNotFound(f"there is no query {query_id}")
            return self._queries[query_id]

    def add_subscriber(self, query_id: str, subscriber: str) -> None:
        with self._lock:
            self.get(query_id).subscribers.append(subscriber)

    def increment(self, query_id: str) -> int:
        with self._lock:
            m = self.get(query_id)
            m.execution_count += 1
            return m.execution_count

    def set_status(self, query_id: str, status: Status, only_from: tuple[Status, ...] | None = None) -> bool:
        """Sets a status, if the present one is among only_from; whether it was set. Atomic."""
        with self._lock:
            m = self.get(query_id)
            if only_from is not None and m.status not in only_from:
                return False
            m.status = status
            return True

    def unregister(self, query_id: str) -> QueryMetadata:
        with self._lock:
            self.get(query_id)
            return self._queries.pop(query_id)

    def list_all(self) -> list[str]:
        with self._lock:
            return sorted(self._queries)

    def clear(self) -> None:
        with self._lock:
            self._queries.clear()

    def statistics(self) -> dict[str, int]:
        with self._lock:
            every = list(self._queries.values())
        return {"total_queries": len(every), "total_executions": sum(m.execution_count for m in every), "total_subscribers": sum(len(m.subscribers) for m in every), **{s.value: sum(m.status is s for m in every) for s in Status}}


#: Results of a query that wait for their reader, at most; the query waits then.
RESULTS_WAITING = 10_000


class QueryHandle:
    """Results of a started query, historical and live ones on one channel."""

    def __init__(self, query_id: str):
        self.query_id = query_id
        self._results: queue.Queue = queue.Queue(RESULTS_WAITING)
        self.done = threading.Event()

    def put(self, r: QueryResult, stop: threading.Event | None = None) -> None:
        """Waits while RESULTS_WAITING results are unread, unless the query is stopped."""
        while stop is None or not stop.is_set():
            try:
                self._results.put(r, timeout=0.2)
                return
            except queue.Full:
                pass

    def receive(self, timeout: float | None = None) -> QueryResult | None:
        """The next result; waits for it. None when the query has ended or the time is over."""
        end = None if timeout is None else time.monotonic() + timeout
        while True:
            try:
                return self._results.get(timeout=0.05)
            except queue.Empty:
                if self.done.is_set() and self._results.empty():
                    return None
                if end is not None and time.monotonic() >= end:
                    return None

    def try_receive(self) -> QueryResult | None:
        try:
            return self._results.get_nowait()
        except queue.Empty:
            return None

    def __iter__(self) -> Iterator[QueryResult]:
        while (r := self.receive()) is not None:
            yield r


@dataclass
class _Run:
    handle: QueryHandle
    live: LiveQuery | None = None
    threads: list[threading.Thread] = field(default_factory=list)
    stop: threading.Event = field(default_factory=threading.Event)
    left: int = 0


#: Rows of one historical result; a window with more gives several, so one result is bounded.
RESULT_ROWS = 10_000


class Engine:
    """Runs registered queries over a log and named streams.

    streams: stream IRI to a function that gives the streaming DataFrame of quads. connect: gives that of
    any other stream IRI, such as sources.broker's connectors do. Each window over the past and the live
    part run in threads of their own. The baseline is computed before the live part starts, so the first
    live window meets it already; with async_baseline=True live windows start at once and see the baseline
    once it is there.
    """

    def __init__(self, spark: SparkSession, log: QuadLog | DataFrame | None = None, streams: dict[str, Callable[[], DataFrame]] | None = None, static: DataFrame | None = None, registry: QueryRegistry | None = None, live_options: dict | None = None, async_baseline: bool = False, connect: Callable[[str], DataFrame] | None = None):
        self.spark, self.log, self.static, self.connect = spark, log, static, connect
        self.streams = streams or {}
        self.registry = registry or QueryRegistry()
        self.live_options, self.async_baseline = live_options or {}, async_baseline
        self._runs: dict[str, _Run] = {}
        self._lock = threading.RLock()

    def register_query(self, query_id: str, text: str, baseline_mode: str = "aggregate") -> QueryMetadata:
        return self.registry.register(query_id, text, baseline_mode)

    def start_query(self, query_id: str, now_ms: int | None = None) -> QueryHandle:
        meta = self.registry.get(query_id)
        with self._lock:
            if self.is_running(query_id):
                raise InvalidState(f"the query {query_id} is running")
            q = meta.parsed
            warms = bool(q.live_windows and q.historical_windows and self.log is not None)
            for w in q.live_windows:
                if w.stream not in self.streams and self.connect is None:
                    raise ExecutionError(f"there is no stream {w.stream}")
            self.registry.set_status(query_id, Status.WARMING_BASELINE if warms else Status.RUNNING)
            self.registry.increment(query_id)
            run = self._runs[query_id] = _Run(QueryHandle(query_id))
        now = now_ms if now_ms is not None else int(time.time() * 1000)
        h = HybridEvaluation(q, log=self.log, static=self.static, now_ms=now, baseline_mode=meta.baseline_mode)
        jobs = [lambda w=w: self._historical(query_id, run, h, w) for w, _ in h.split.historical] if self.log is not None else []
        if q.live_windows:
            jobs.append(lambda: self._run_live(meta, run, h, warms))
        run.left = len(jobs)
        run.threads = [threading.Thread(target=self._work, args=(meta, run, job), daemon=True) for job in jobs]
        if not jobs:
            self._ended(meta, run)
        for t in run.threads:
            t.start()
        return run.handle

    def _work(self, meta: QueryMetadata, run: _Run, job: Callable[[], None]) -> None:
        """One part of a query; the first one that fails stops the others."""
        try:
            if not run.stop.is_set():
                job()
        except Exception as e:
            if not run.stop.is_set():
                meta.error = str(e)
                self.registry.set_status(meta.query_id, Status.FAILED)
                run.stop.set()
                if run.live is not None:
                    run.live.stop()
        finally:
            with self._lock:
                run.left -= 1
                last = run.left == 0
            if last:
                self._ended(meta, run)

    def _ended(self, meta: QueryMetadata, run: _Run) -> None:
        if not run.stop.is_set():
            self.registry.set_status(meta.query_id, Status.COMPLETED, (Status.RUNNING, Status.WARMING_BASELINE))
        run.handle.done.set()

    def _run_live(self, meta: QueryMetadata, run: _Run, h: HybridEvaluation, warms: bool) -> None:
        base = self._baseline(h) if warms and not self.async_baseline else None
        if run.stop.is_set():
            return
        uris = {w.stream for w in meta.parsed.live_windows}
        streams = {u: self.streams[u]() if u in self.streams else self.connect(u) for u in uris}
        static = self.static if base is None else self._with(base)
        run.live = LiveQuery(meta.parsed, streams, static, on_result=lambda out: self._live(meta.query_id, run, out), **self.live_options)
        run.live.start()
        if warms and self.async_baseline:  # live windows that fire before see no baseline
            base = self._baseline(h)
            if base is not None:
                run.live.use_static(self._with(base))
        self.registry.set_status(meta.query_id, Status.RUNNING, (Status.WARMING_BASELINE, Status.RUNNING))
        if run.stop.is_set():
            run.live.stop()
        run.live.await_end()

    def _baseline(self, h: HybridEvaluation) -> DataFrame | None:
        base = h.baseline()
        return None if base is None else materialize(base, "baseline")

    def _with(self, base: DataFrame) -> DataFrame:
        return base if self.static is None else self.static.unionByName(base.select(*self.static.columns))

    def _historical(self, query_id: str, run: _Run, h: HybridEvaluation, w) -> None:
        """One result for each window, also for windows without solutions; large ones in parts."""
        out = h.historical(w.name, "ntriples")
        names = [c for c in out.columns if c not in ("ws", "we")]
        if w.kind == "fixed":
            windows_ = {(w.start, w.end)}
        else:
            from .operators.windows import sliding_starts

            first, n = sliding_starts(w, h.now_ms)
            windows_ = {(first + k * w.slide, min(first + k * w.slide + w.width, h.now_ms)) for k in range(n)}
        held, at, seen = [], None, set()

        def give() -> None:
            if at is not None:
                seen.add(at)
                run.handle.put(QueryResult(query_id, at[1], "Historical", held), run.stop)

        for row in out.orderBy("ws").toLocalIterator():
            if run.stop.is_set():
                return
            key = (row["ws"], row["we"])
            if key != at or len(held) >= RESULT_ROWS:
                give()
                held, at = [], key
            held.append({c: row[c] for c in names if row[c] is not None})
        give()
        for key in sorted(windows_ - seen):
            run.handle.put(QueryResult(query_id, key[1], "Historical", []), run.stop)

    def _live(self, query_id: str, run: _Run, out: DataFrame) -> None:
        names = [c for c in out.columns if c not in ("ws", "we", "ts", "last_ms")]
        for row in out.orderBy("ts").toLocalIterator():
            run.handle.put(QueryResult(query_id, row["ts"], "Live", [{c: row[c] for c in names if row[c] is not None}]), run.stop)

    def stop_query(self, query_id: str) -> None:
        self.registry.get(query_id)
        with self._lock:
            run = self._runs.get(query_id)
            if run is None or run.handle.done.is_set():
                raise InvalidState(f"the query {query_id} isn't running")
            run.stop.set()
        if run.live is not None:
            run.live.stop()
        for t in run.threads:
            t.join(timeout=30)
        run.handle.done.set()
        self.registry.set_status(query_id, Status.STOPPED)

    def is_running(self, query_id: str) -> bool:
        run = self._runs.get(query_id)
        return run is not None and not run.handle.done.is_set()

    def get_query_status(self, query_id: str) -> Status:
        return self.registry.get(query_id).status

    def delete_query(self, query_id: str) -> None:
        self.registry.get(query_id)
        if self.is_running(query_id):
            raise InvalidState(f"the query {query_id} is running: stop it first")
        self.registry.unregister(query_id)
        self._runs.pop(query_id, None)

    def close(self) -> None:
        for query_id in list(self._runs):
            if self.is_running(query_id):
                self.stop_query(query_id)


def envelope(results: DataFrame, query_id: str, source: str, stamp: str = "we", most: int = RESULT_ROWS) -> DataFrame:
    """Results as rows (query_id, timestamp, source, bindings array<map<string,string>>): one for each window,
    or several of about `most` bindings each, so that no row holds an unbounded window."""
    names = [c for c in results.columns if c not in ("ws", "we", "ts", "last_ms")]
    binding = F.map_filter(F.create_map(*(x for c in names for x in (F.lit(c), F.col(f"`{c}`")))), lambda k, v: v.isNotNull())
    keys = [c for c in ("ws", "we", "ts") if c in results.columns]
    parts = results.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_parts"))
    dealt = results.select(*keys, binding.alias("_binding"), F.xxhash64(*(F.col(f"`{c}`") for c in names), F.monotonically_increasing_id()).alias("_deal")).join(parts, keys)
    dealt = dealt.withColumn("_part", F.pmod("_deal", F.col("_parts")))
    return dealt.groupBy(*keys, "_part").agg(F.collect_list("_binding").alias("bindings")).select(F.lit(query_id).alias("query_id"), F.col(stamp).alias("timestamp"), F.lit(source).alias("source"), "bindings")
