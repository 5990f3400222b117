"""Splits a hybrid query into one query for each window over the past and one for all live windows,
and evaluates them over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ExecutionError
from ..model import checked
from ..operators import baseline as baselines
from ..operators import r2s, windows
from .ast import Const, Exists, Filter, Graph, Group, HybridQuery, Select, Triple, Var, WindowPattern, WindowSpec, bodies, variables, wanted_predicates
from .compiler import Dataset, Plan, Rel, Wide, _find_aggregates, presented
from .parser import parse_hybrid

LOG_GRAPH = "_log_graph"


@dataclass
class Split:
    historical: list[tuple[WindowSpec, Select]]
    live: Select | None


def split(q: HybridQuery) -> Split:
    """The parts of a query. A body over a log may lie in any one named graph; one over a stream lies
    in the graph named like the stream. What lies outside of windows stays in the live query."""
    past = {w.name: w for w in q.historical_windows}
    single = len(q.windows) == 1
    out = []
    for w in q.historical_windows:
        bodies = [p.group for p in q.select.where.parts if isinstance(p, WindowPattern) and p.window == w.name]
        if not bodies:
            continue
        body = bodies[0] if len(bodies) == 1 else Group(list(bodies))
        own = variables(body) | ({LOG_GRAPH} if w.source == "log" else set())
        graph = Var(LOG_GRAPH) if w.source == "log" else Const(w.stream, 0)
        where = Group([Graph(graph, body)])
        if single:  # filters and static patterns outside have no other query to stay in
            where.parts += [p for p in q.select.where.parts if not isinstance(p, WindowPattern)]
        out.append((w, narrowed(q.select, own, where, single)))
    live = None
    if q.live_windows:
        parts = [p for p in q.select.where.parts if not (isinstance(p, WindowPattern) and p.window in past)]
        where = Group(parts)
        seen = variables(where)
        live = narrowed(q.select, seen, where, True)
    return Split(out, live)


def narrowed(q: Select, own: set[str], where: Group, whole: bool) -> Select:
    """The query over a body that binds `own`: projected items that mention one of these variables
    (all of the body's if none does), and the modifiers that only mention these."""
    items = None if q.items is None else [i for i in q.items if variables(i.expr if i.expr is not None else Var(i.name)) & own or (whole and i.expr is not None)]
    named = own | {i.name for i in items or []}
    groups = [g for g in q.group_by if variables(g) <= named] if whole or all(variables(g) <= named for g in q.group_by) else []
    having = [h for h in q.having if variables(h) <= named]
    order = [(e, up) for e, up in q.order_by if variables(e) <= named]
    aggregated: list = []
    _find_aggregates([items or [], having], aggregated)
    if not groups and not aggregated:
        having = []
    if (groups or aggregated) and items:  # what isn't grouped can't be projected
        grouped = {g.name for g in groups}
        items = [i for i in items if i.expr is not None or i.name in grouped]
    return Select(items or None, where, q.distinct, groups, having, order, q.limit if whole else None, q.offset if whole else 0)


def _rewrite(node):
    """Predicates of baselines in any namespace become this library's."""
    if isinstance(node, Const) and node.kind == 0:
        return replace(node, lex=baselines.own_namespace(node.lex))
    if isinstance(node, Triple):
        return Triple(_rewrite(node.s), _rewrite(node.p), _rewrite(node.o))
    if isinstance(node, Group):
        return Group([_rewrite(p) for p in node.parts])
    if isinstance(node, (WindowPattern, Graph)) or hasattr(node, "group") and not isinstance(node, Exists):
        return replace(node, group=_rewrite(node.group))
    if hasattr(node, "groups"):
        return replace(node, groups=[_rewrite(g) for g in node.groups])
    return node


class HybridEvaluation:
    """Evaluates a hybrid query in batch: log is the stored past (a QuadLog, quads or a wide table), streams the live quads by stream IRI
    (or one DataFrame for all), static the background quads. Results are lazy."""

    def __init__(self, query: HybridQuery | str, log=None, streams: dict[str, DataFrame] | DataFrame | Wide | None = None, static: DataFrame | None = None, now_ms: int | None = None, functional: frozenset[str] = frozenset(), baseline_mode: str = "aggregate", strict: bool = False, static_predicates: frozenset[str] | None = None):
        """strict: a quad of the log with an invalid IRI fails the windows that it is in. static_predicates: all
        predicates of the static quads, if they are known; patterns with others then meet no static quads."""
        self.strict, self.static_predicates = strict, static_predicates
        self.query = parse_hybrid(query) if isinstance(query, str) else query
        self.log, self.streams, self.static, self.now_ms = log, streams, static, now_ms
        self.functional, self.baseline_mode = functional, baseline_mode
        self.split = split(self.query)

    def _now(self) -> int:
        if self.now_ms is None:
            import time

            self.now_ms = int(time.time() * 1000)
        return self.now_ms

    def historical_rel(self, window: WindowSpec, select: Select) -> Rel:
        if self.log is None:
            raise ExecutionError(f"there is no log for the window {window.name}")
        log = self.log
        if hasattr(log, "scan"):  # a quad log prunes its buckets
            log = log.scan(*((window.start, window.end) if window.kind == "fixed" else (windows.sliding_starts(window, self._now())[0], self._now())))
        if self.strict and isinstance(log, DataFrame):
            log = checked(log)
        if window.kind == "fixed":
            data = windows.fixed_dataset(log, window, functional=self.functional)
        else:
            data = windows.sliding_dataset(log, window, self._now(), functional=self.functional)
        return Plan(data, now_ms=self.now_ms).select(select)

    def historical(self, window: str | None = None, style: str = "plain") -> DataFrame:
        """The solutions of a window over the past (the first by default); sliding windows have ws and
        we, a fixed one its bounds."""
        for w, select in self.split.historical:
            if window in (None, w.name):
                rel = self.historical_rel(w, select)
                out = presented(rel, style)
                if w.kind == "fixed":
                    cols = [f"`{c}`" for c in out.columns]
                    out = out.selectExpr(f"CAST({w.start} AS BIGINT) AS ws", f"CAST({w.end} AS BIGINT) AS we", *cols)
                return out
        raise ExecutionError(f"no window over the past named {window}")

    def baseline(self) -> DataFrame:
        """The baseline's static quads: of the named window, or without USING BASELINE of all windows
        over the past, each by itself. The clause's mode goes before the registered one."""
        clause = self.query.baseline
        mode = clause.mode if clause else self.baseline_mode
        parts = None
        for w, select in self.split.historical:
            if clause and w.name != clause.window:
                continue
            rel = self.historical_rel(w, replace(select, limit=None, offset=0, order_by=[]))
            last = None
            if w.kind == "sliding":
                first, n = windows.sliding_starts(w, self._now())
                last = first + (n - 1) * w.slide
            found = baselines.statements(rel, mode, last)
            parts = found if parts is None else parts.unionByName(found)
        if parts is None:
            return None
        return baselines.as_static(parts)

    def _stream(self, w: WindowSpec) -> DataFrame:
        if isinstance(self.streams, (DataFrame, Wide)):
            return self.streams
        got = (self.streams or {}).get(w.stream)
        if got is None:
            raise ExecutionError(f"there is no stream {w.stream}")
        return got

    def live_rel(self) -> Rel:
        """The solutions with the windows' keys ws and we (and by, which window fired, if there are several)."""
        return self._live()[0]

    def _live(self) -> tuple[Rel, DataFrame]:
        if self.split.live is None:
            raise ExecutionError("the query has no live window")
        static, predicates = self.static, self.static_predicates
        if self.query.historical_windows and self.log is not None:
            base = self.baseline()
            if base is not None:
                if static is None:
                    predicates = self._baseline_predicates()
                elif predicates is not None:
                    predicates = predicates | self._baseline_predicates()
                static = base if static is None else static.unionByName(base)
        q = replace(self.split.live, where=_rewrite(self.split.live.where))
        return live_plan(self.query, q, {w.name: self._stream(w) for w in self.query.live_windows}, static, self.now_ms, self.functional, predicates)

    def _baseline_predicates(self) -> frozenset[str]:
        """The predicates that a baseline can have: one for each variable of the windows over the past."""
        names: set[str] = set()
        for _, select in self.split.historical:
            names |= {i.name for i in select.items} if select.items is not None else variables(select.where)
        return frozenset(baselines.NAMESPACE + n for n in names)

    def live(self, style: str = "plain") -> DataFrame:
        """The solutions of every live window that has content: ws, we, ts (the last quad's time plus
        the window's width) and the variables; after the query's relation-to-stream operator."""
        rel, stamps = self._live()
        return streamed(stamped(presented(rel, style).join(stamps, list(rel.keys)), self.query), self.query)


def live_plan(query: HybridQuery, q: Select, streams: dict[str, DataFrame], static: DataFrame | None, now_ms: int | None = None, functional: frozenset[str] = frozenset(), static_predicates: frozenset[str] | None = None) -> tuple[Rel, DataFrame]:
    """Evaluates the live query over the streams' quads; the solutions and the windows' stamps. In a window, the default graph holds quads
    without a graph, those in the graph named like the stream, and the static quads."""
    specs = query.live_windows
    options = {"functional": functional}
    if len(specs) == 1:
        w = specs[0]
        data = {w.name: windows.live_dataset(streams[w.name], w, **options)}
    else:
        data = windows.joined_live_datasets([(w, streams[w.name], wanted_predicates(Group(bodies(q.where, w.name)))) for w in specs], **options)
    for w in specs:
        data[w.name].extra_graphs = (w.stream,)
    first = data[specs[0].name].quads
    empty = first.select(*windows.TERMS).where(F.lit(False)) if static is None else static.select(*windows.TERMS)
    outer = Dataset(empty)
    if static is not None:  # patterns inside of windows see static quads as well
        for d in data.values():
            d.static, d.static_predicates = static, static_predicates
    where = Group([*[p for p in q.where.parts if not isinstance(p, Filter)], *[p for p in q.where.parts if isinstance(p, Filter)]])
    return Plan(outer, data, now_ms).select(replace(q, where=where)), data[specs[0].name].stamps


def stamped(out: DataFrame, query: HybridQuery) -> DataFrame:
    widths = [w.width for w in query.live_windows]
    if "by" in out.columns:
        width = F.element_at(F.array(*(F.lit(w) for w in widths)), F.col("by") + 1)
    else:
        width = F.lit(widths[0])
    return out.withColumn("ts", (F.col("last_ms") + width).cast("long")).drop("last_ms")


def streamed(out: DataFrame, query: HybridQuery) -> DataFrame:
    """Stamped results after the query's relation-to-stream operator; each window's results are compared
    with those of its own neighbours."""
    slides = [w.slide for w in query.live_windows]
    slide = F.element_at(F.array(*(F.lit(s) for s in slides)), F.col("by") + 1) if "by" in out.columns else slides[0]
    return r2s.apply(query.operator, out, slide).drop("by")

