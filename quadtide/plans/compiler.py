"""Compiles query algebra to lazy DataFrames.

A relation has the key columns of its dataset (a window's start, for instance) and, for each
variable, one column if it can only be an IRI or else three. Key columns are part of every join, so
all windows of a query run in one job. Equi-joins are used wherever the shared variables are bound
for certain; only maybe-unbound ones need a null-tolerant condition.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import UnsupportedError
from ..functions.expressions import Compiler, Value, number_value, text_value
from ..model import DECIMAL, INTEGER, IRI, ntriples
from ..workspace import discard, materialize
from .ast import (
    Aggregate, Alternative, Ask, Bind, Call, Const, Construct, Describe, Exists, Filter, Graph, Group, Inverse, Item, Link, Minus,
    NotIn, Optional_, Repeat, Select, Sequence, SubSelect, Triple, Union_, Values, Var, WindowPattern, variables,
)


@dataclass(frozen=True)
class Info:
    certain: bool
    iri: bool


@dataclass
class Wide:
    """A relational table seen as quads: patterns with these constant predicates read its columns, and
    patterns on one subject are one scan. subject: its IRI column; fields: predicate to (lexical
    column, kind, number column or None). Each row is a subject of its own."""

    df: DataFrame
    subject: str
    fields: dict[str, tuple[str, int, str | None]]
    graph: str = ""

    def quads(self) -> DataFrame:
        """The same as quads, for patterns with other predicates: (other columns..., s, p, o, g, o_kind, o_num)."""
        own = {self.subject, *(c for f in self.fields.values() for c in (f[0], f[2]) if c)}
        keep = [c for c in self.df.columns if c not in own]
        cells = [F.struct(F.lit(p).alias("p"), F.col(lex).cast("string").alias("o"), F.lit(kind).cast("tinyint").alias("o_kind"), (F.col(num).cast("double") if num else F.lit(None).cast("double")).alias("o_num")) for p, (lex, kind, num) in self.fields.items()]
        long = self.df.select(*keep, F.col(self.subject).alias("s"), F.explode(F.array(*cells)).alias("c"))
        return long.select(*keep, "s", "c.p", "c.o", F.lit(self.graph).alias("g"), "c.o_kind", "c.o_num").where("o IS NOT NULL")


@dataclass
class Dataset:
    """Quads (keys..., s, p, o, g, o_kind, o_num) that patterns match. functional: predicates that
    have at most one object for each subject, graph and key, so stars over them need no join.
    extra_graphs: graphs that count as the default graph too. static: quads without keys that every
    key sees, in the default graph; small ones are broadcast by the engine's own size check. stamps:
    (keys..., last_ms), the time of each window's last quad, joined to results that need it."""

    quads: DataFrame
    keys: tuple[str, ...] = ()
    functional: frozenset[str] = frozenset()
    extra_graphs: tuple[str, ...] = ()
    static: DataFrame | None = None
    #: The predicates that static quads can have; None if they can have any.
    static_predicates: frozenset[str] | None = None
    wide: Wide | None = None
    stamps: DataFrame | None = None


#: Patterns of a group that are matched by windows' and by static quads in every combination, at most.
MOST_EITHER = 4
#: Steps of a path that a round goes from a constant start.
HOPS = 3


@dataclass
class Rel:
    df: DataFrame
    vars: dict[str, Info] = field(default_factory=dict)
    keys: tuple[str, ...] = ()

    def columns(self, name: str) -> list[str]:
        return [name] if self.vars[name].iri else [name, f"{name}__k", f"{name}__n"]

    def value(self, name: str) -> Value | None:
        info = self.vars.get(name)
        if info is None:
            return None
        if info.iri:
            return Value(F.col(f"`{name}`"), IRI)
        return Value(F.col(f"`{name}`"), F.col(f"`{name}__k`"), F.col(f"`{name}__n`"))


def _value_columns(v: Value, name: str, iri: bool = False) -> list[Column]:
    if iri:
        return [v.lex.alias(name)]
    kind = F.when(v.lex.isNotNull(), v.kind_column).cast("tinyint")
    return [v.lex.alias(name), kind.alias(f"{name}__k"), v.number.cast("double").alias(f"{name}__n")]


class Plan:
    """Compiles patterns and queries over a dataset; windows: datasets by window name."""

    def __init__(self, dataset: Dataset, windows: dict[str, Dataset] | None = None, now_ms: int | None = None):
        self.dataset, self.windows, self.now_ms = dataset, windows or {}, now_ms
        self.spark = dataset.quads.sparkSession

    # -- scans
    def quads(self, data: Dataset, graph) -> DataFrame:
        """The quads of the active graph: None for the default graph, a Const or a Var."""
        q = data.quads
        if isinstance(graph, Const):
            return q.where(F.col("g") == graph.lex)
        if isinstance(graph, Var):
            return q.where(F.col("g") != "")
        q = q.where(F.col("g").isin("", *data.extra_graphs)) if data.extra_graphs else q.where(F.col("g") == "")
        if data.static is None:
            return q
        cols = [*data.keys, "s", "p", "o", "g", "o_kind", "o_num"]
        fixed = data.static.where(F.col("g") == "")
        if data.keys:
            fixed = data.quads.select(*data.keys).distinct().crossJoin(fixed)
        return q.select(*cols).unionByName(fixed.select(*cols))

    def triple(self, t: Triple, data: Dataset, graph) -> Rel:
        if not isinstance(t.p, (Var, Const)):
            return self.path_rel(t, data, graph)
        return self.match(self.quads(data, graph), t, data.keys, graph)

    def with_static(self, triples: list[Triple], data: Dataset) -> Rel:
        """Patterns over windows' quads and static ones, which have no keys. Each pattern that static
        quads can match is matched by either kind: for every choice, the windows' part and the static
        part are joined on their variables, and only solutions that are static alone are paired with
        the windows. Paths, and patterns beyond the first few such ones, take copies of static quads."""
        live, fixed = replace(data, static=None), Dataset(data.static)
        simple = [t for t in triples if isinstance(t.p, (Var, Const))]
        known = data.static_predicates
        either = [t for t in simple if known is None or isinstance(t.p, Var) or t.p.lex in known]
        either, copied = either[:MOST_EITHER], either[MOST_EITHER:] + [t for t in triples if t not in simple]
        rels = []
        for chosen in range(1 << len(either)):
            still = [t for k, t in enumerate(either) if chosen >> k & 1]
            moving = [t for t in simple if t not in still and t not in copied]
            rel = self.bgp(moving, live, None) if moving else None
            if still:
                found = self.bgp(still, fixed, None)
                if rel is None:
                    rel = Rel(data.quads.select(*data.keys).distinct().crossJoin(found.df), found.vars, data.keys)
                else:
                    rel = self.join(rel, found)
            if rel is not None:
                rels.append(rel)
        out = self.union(rels) if rels else None
        for t in copied:
            rel = self.triple(t, data, None)
            out = rel if out is None else self.join(out, rel)
        return out

    def match(self, q: DataFrame, t: Triple, keys: tuple[str, ...], graph) -> Rel:
        out: dict[str, Info] = {}
        cols: list[Column] = [F.col(k) for k in keys]
        test: list[Column] = []

        def bind(term, column: str, iri: bool) -> None:
            if isinstance(term, Const):
                if column != "o" or term.kind == IRI:
                    test.append(F.col(column) == term.lex)
                    if column == "o":
                        test.append(F.col("o_kind") == IRI)
                    elif term.kind != IRI:
                        test.append(F.lit(False))
                elif term.num is not None:
                    test.append(F.col("o_num") == term.num)
                else:
                    test.append((F.col("o") == term.lex) & (F.col("o_kind") == term.kind))
            elif term.name in out:
                first = seen[term.name]
                test.append(F.col(column) == F.col(first))
                if not iri:
                    test.append(F.col("o_kind") == IRI)
            else:
                seen[term.name] = column
                out[term.name] = Info(True, iri)
                if iri:
                    cols.append(F.col(column).alias(term.name))
                else:
                    cols.extend([F.col("o").alias(term.name), F.col("o_kind").alias(f"{term.name}__k"), F.col("o_num").alias(f"{term.name}__n")])

        seen: dict[str, str] = {}
        bind(t.s, "s", True)
        bind(t.p, "p", True)
        if isinstance(graph, Var):
            bind(graph, "g", True)
        bind(t.o, "o", False)
        for c in test:
            q = q.where(c)
        return Rel(q.select(*cols), out, keys)

    def star(self, triples: list[Triple], data: Dataset, graph) -> Rel | None:
        """Several functional predicates of one subject: one scan and one aggregation in place of joins."""
        if len(triples) < 2 or not data.functional or (data.static is not None and graph is None):
            return None
        names = [t.o.name for t in triples if isinstance(t.o, Var)]
        if not all(isinstance(t.p, Const) and t.p.lex in data.functional and isinstance(t.o, Var) for t in triples):
            return None
        if len(set(names)) < len(triples) or not isinstance(triples[0].s, Var) or triples[0].s.name in names or isinstance(graph, Var) and graph.name in names:
            return None
        if len({t.p.lex for t in triples}) < len(triples):
            return None
        s = triples[0].s.name
        keys = [*data.keys, "s", "g"]
        obj = F.struct("o", "o_kind", "o_num")
        q = self.quads(data, graph).where(F.col("p").isin(*(t.p.lex for t in triples)))
        wide = q.groupBy(*keys).agg(*(F.max(F.when(F.col("p") == t.p.lex, obj)).alias(f"_o{k}") for k, t in enumerate(triples)))
        for k in range(len(triples)):
            wide = wide.where(F.col(f"_o{k}").isNotNull())
        cols, out = [F.col(k) for k in data.keys] + [F.col("s").alias(s)], {s: Info(True, True)}
        if isinstance(graph, Var) and graph.name != s:
            cols.append(F.col("g").alias(graph.name))
            out[graph.name] = Info(True, True)
        for k, t in enumerate(triples):
            cols += [F.col(f"_o{k}.o").alias(t.o.name), F.col(f"_o{k}.o_kind").alias(f"{t.o.name}__k"), F.col(f"_o{k}.o_num").alias(f"{t.o.name}__n")]
            out[t.o.name] = Info(True, False)
        return Rel(wide.select(*cols), out, data.keys)

    def wide(self, triples: list[Triple], data: Dataset, graph) -> Rel | None:
        """Patterns on one subject over the columns of a wide table; None if they aren't in it."""
        w = data.wide
        if w is None or data.static is not None and graph is None:
            return None
        in_graph = w.graph != "" if isinstance(graph, Var) else w.graph == graph.lex if isinstance(graph, Const) else w.graph in ("", *data.extra_graphs)
        s = triples[0].s
        names = [t.o.name for t in triples if isinstance(t.o, Var)] + [x.name for x in (s, graph) if isinstance(x, Var)]
        if len(set(names)) < len(names) or any(isinstance(t.o, Const) and t.o.num is None and w.fields[t.p.lex][1] != t.o.kind for t in triples):
            return None
        df, cols, out = w.df, [F.col(k) for k in data.keys], {}
        if not in_graph:
            df = df.where(F.lit(False))
        if isinstance(s, Const):
            df = df.where(F.col(w.subject) == s.lex)
        else:
            cols.append(F.col(w.subject).alias(s.name))
            out[s.name] = Info(True, True)
        if isinstance(graph, Var):
            cols.append(F.lit(w.graph).alias(graph.name))
            out[graph.name] = Info(True, True)
        for t in triples:
            lex, kind, num = w.fields[t.p.lex]
            if isinstance(t.o, Const):
                df = df.where(F.col(num) == t.o.num if t.o.num is not None and num else F.lit(False) if t.o.num is not None else F.col(lex) == t.o.lex)
                continue
            df = df.where(F.col(num or lex).isNotNull())
            if kind == IRI:
                cols.append(F.col(lex).alias(t.o.name))
                out[t.o.name] = Info(True, True)
            else:
                cols += [F.col(lex).cast("string").alias(t.o.name), F.lit(kind).cast("tinyint").alias(f"{t.o.name}__k"), (F.col(num).cast("double") if num else F.lit(None).cast("double")).alias(f"{t.o.name}__n")]
                out[t.o.name] = Info(True, False)
        return Rel(df.select(*cols), out, data.keys)

    def bgp(self, triples: list[Triple], data: Dataset, graph) -> Rel:
        """Triple patterns in an order that joins connected ones first."""
        if data.static is not None and data.keys and graph is None:
            return self.with_static(triples, data)
        rels: list[Rel] = []
        rest = list(triples)
        if data.wide is not None:
            stars: dict[object, list[Triple]] = {}
            for t in rest:
                if isinstance(t.p, Const) and t.p.lex in data.wide.fields:
                    stars.setdefault(t.s, []).append(t)
            for group in stars.values():
                found = self.wide(group, data, graph)
                if found is not None:
                    rels.append(found)
                    rest = [t for t in rest if not any(t is x for x in group)]
        by_subject: dict[str, list[Triple]] = {}
        for t in rest:
            if isinstance(t.s, Var) and isinstance(t.p, Const) and t.p.lex in data.functional and isinstance(t.o, Var):
                by_subject.setdefault(t.s.name, []).append(t)
        for group in by_subject.values():
            star = self.star(group, data, graph)
            if star is not None:
                rels.append(star)
                rest = [t for t in rest if not any(t is x for x in group)]
        rels += [self.triple(t, data, graph) for t in rest]
        out = rels.pop(0)
        while rels:
            k = next((k for k, r in enumerate(rels) if set(r.vars) & set(out.vars)), 0)
            out = self.join(out, rels.pop(k))
        return out

    # -- joins
    def _meet(self, left: Rel, right: Rel) -> tuple[DataFrame, Column, list[str]]:
        """The right side under other names, the join condition and the shared variables."""
        renamed = right.df.select(*(F.col(f"`{c}`").alias(f"_r_{c}") for c in right.df.columns))
        cond = F.lit(True)
        for k in left.keys:
            if k in right.keys:
                cond = cond & (F.col(k) == F.col(f"_r_{k}"))
        shared = [v for v in left.vars if v in right.vars]
        for v in shared:
            a, b = left.vars[v], right.vars[v]
            same = F.col(f"`{v}`") == F.col(f"`_r_{v}`")
            if a.iri != b.iri:
                same = same & (F.col(f"`_r_{v}__k`" if a.iri else f"`{v}__k`") == IRI)
            elif not a.iri:
                same = same & (F.col(f"`{v}__k`") == F.col(f"`_r_{v}__k`"))
            if not a.certain:
                same = same | F.col(f"`{v}`").isNull()
            if not b.certain:
                same = same | F.col(f"`_r_{v}`").isNull()
            cond = cond & same
        return renamed, cond, shared

    def _merged(self, left: Rel, right: Rel, shared: list[str], optional: bool) -> tuple[list[Column], dict[str, Info]]:
        cols = [F.col(k) for k in left.keys] + [F.col(f"_r_{k}").alias(k) for k in right.keys if k not in left.keys]
        out: dict[str, Info] = {}
        for v, info in left.vars.items():
            if v in shared and not info.certain:
                other = right.vars[v]
                iri = info.iri and other.iri
                out[v] = Info(other.certain and not optional, iri)
                a, b = self._as_value(v, info), self._as_value(f"_r_{v}", other)
                missing = F.col(f"`{v}`").isNull()
                pick = lambda x, y, m=missing: F.when(m, y).otherwise(x)
                cols += _value_columns(Value(pick(a.lex, b.lex), pick(a.kind_column, b.kind_column), pick(a.number, b.number)), v, iri)
            else:
                out[v] = info
                cols += [F.col(f"`{c}`") for c in left.columns(v)]
        for v, info in right.vars.items():
            if v not in left.vars:
                out[v] = Info(info.certain and not optional, info.iri)
                cols += [F.col(f"`_r_{c}`").alias(c) for c in right.columns(v)]
        return cols, out

    def _as_value(self, column: str, info: Info) -> Value:
        if info.iri:
            return Value(F.col(f"`{column}`"), IRI)
        return Value(F.col(f"`{column}`"), F.col(f"`{column}__k`"), F.col(f"`{column}__n`"))

    def join(self, left: Rel, right: Rel) -> Rel:
        renamed, cond, shared = self._meet(left, right)
        cols, out = self._merged(left, right, shared, False)
        linked = shared or any(k in right.keys for k in left.keys)
        met = left.df.join(renamed, cond, "inner") if linked else left.df.crossJoin(renamed)
        return Rel(met.select(*cols), out, tuple(dict.fromkeys([*left.keys, *right.keys])))

    def left_join(self, left: Rel, right: Rel, filters: list) -> Rel:
        renamed, cond, shared = self._meet(left, right)

        def env(name: str) -> Value | None:
            if name in left.vars and (left.vars[name].certain or name not in right.vars):
                return self._as_value(name, left.vars[name])
            if name in right.vars:
                return self._as_value(f"_r_{name}", right.vars[name])
            return None

        for f in filters:
            cond = cond & F.coalesce(Compiler(env, self.now_ms).truth(f), F.lit(False))
        cols, out = self._merged(left, right, shared, True)
        return Rel(left.df.join(renamed, cond, "left").select(*cols), out, left.keys)

    def semi(self, left: Rel, right: Rel, negated: bool, filters: Iterable = (), minus: bool = False) -> Rel:
        renamed, cond, shared = self._meet(left, right)
        if minus:
            some = F.lit(False)
            for v in shared:
                some = some | (F.col(f"`{v}`").isNotNull() & F.col(f"`_r_{v}`").isNotNull())
            if not shared:
                return left
            if not all(left.vars[v].certain and right.vars[v].certain for v in shared):
                cond = cond & some

        def env(name: str) -> Value | None:
            if name in right.vars and name not in left.vars:
                return self._as_value(f"_r_{name}", right.vars[name])
            return left.value(name)

        for f in filters:
            cond = cond & F.coalesce(Compiler(env, self.now_ms).truth(f), F.lit(False))
        return Rel(left.df.join(renamed, cond, "left_anti" if negated else "left_semi"), left.vars, left.keys)

    def union(self, rels: list[Rel]) -> Rel:
        out: dict[str, Info] = {}
        keys = tuple(dict.fromkeys(k for r in rels for k in r.keys))
        for r in rels:
            for v in r.vars:
                infos = [x.vars.get(v) for x in rels]
                out[v] = Info(all(i is not None and i.certain for i in infos), all(i is None or i.iri for i in infos))
        frames = []
        for r in rels:
            cols = [F.col(k) if k in r.keys else F.lit(None).cast("long").alias(k) for k in keys]
            for v, info in out.items():
                value = r.value(v) or Value(F.lit(None).cast("string"), F.lit(None).cast("tinyint"), F.lit(None).cast("double"))
                cols += _value_columns(value, v, info.iri)
            frames.append(r.df.select(*cols))
        df = frames[0]
        for f in frames[1:]:
            df = df.unionByName(f)
        return Rel(df, out, keys)

    # -- property paths: pairs (keys..., s, o, o_kind, o_num); s_kind is needed once paths go backwards
    def path_rel(self, t: Triple, data: Dataset, graph) -> Rel:
        pairs = self.pairs(t.p, data, graph, t.s if isinstance(t.s, Const) else None)
        if isinstance(t.s, Const):
            pairs = pairs.where((F.col("s") == t.s.lex) & (F.col("s_kind") == t.s.kind))
        if isinstance(t.o, Const):
            pairs = pairs.where((F.col("o") == t.o.lex) & (F.col("o_kind") == t.o.kind)) if t.o.num is None else pairs.where(F.col("o_num") == t.o.num)
        cols, out = [F.col(k) for k in data.keys], {}
        if isinstance(t.s, Var) and isinstance(t.o, Var) and t.s.name == t.o.name:
            pairs = pairs.where((F.col("s") == F.col("o")) & (F.col("s_kind") == F.col("o_kind")))
        for term, c in ((t.s, "s"), (t.o, "o")):
            if isinstance(term, Var) and term.name not in out:
                cols += [F.col(c).alias(term.name), F.col(f"{c}_kind").alias(f"{term.name}__k"), F.col(f"{c}_num").alias(f"{term.name}__n")]
                out[term.name] = Info(True, False)
        if isinstance(graph, Var):
            cols.append(F.col("_g").alias(graph.name))
            out[graph.name] = Info(True, True)
        return Rel(pairs.select(*cols), out, data.keys)

    def pairs(self, path, data: Dataset, graph, start: Const | None = None) -> DataFrame:
        named = isinstance(graph, Var)
        keys = [*data.keys] + ["_g"] * named
        ends = ["s", "s_kind", "s_num", "o", "o_kind", "o_num"]
        if isinstance(path, (Link, NotIn)):
            q = self.quads(data, graph)
            if named:
                q = q.withColumn("_g", F.col("g"))
            q = q.withColumn("s_kind", F.lit(IRI).cast("tinyint")).withColumn("s_num", F.lit(None).cast("double"))
            if isinstance(path, Link):
                return q.where(F.col("p") == path.iri).select(*keys, *ends)
            frames = []
            if path.forward or not path.backward:
                frames.append(q.where(~F.col("p").isin(*path.forward)).select(*keys, *ends))
            if path.backward:
                frames.append(self.swapped(q.where(~F.col("p").isin(*path.backward)).select(*keys, *ends), keys))
            return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
        if isinstance(path, Inverse):
            return self.swapped(self.pairs(path.path, data, graph), keys)
        if isinstance(path, Alternative):
            return self.pairs(path.left, data, graph, start).unionByName(self.pairs(path.right, data, graph, start))
        if isinstance(path, Sequence):
            return self.chained(self.pairs(path.left, data, graph, start), self.pairs(path.right, data, graph), keys)
        if isinstance(path, Repeat):
            step = self.pairs(path.path, data, graph).distinct()
            out = self.closure(step, keys, start) if path.many else step
            if path.least == 0:
                out = out.unionByName(self.identity(data, graph, keys, start)).distinct()
            return out
        raise UnsupportedError(f"not a path: {path!r}")

    def swapped(self, pairs: DataFrame, keys: list[str]) -> DataFrame:
        return pairs.select(*keys, *(F.col(a).alias(b) for a, b in (("o", "s"), ("o_kind", "s_kind"), ("o_num", "s_num"), ("s", "o"), ("s_kind", "o_kind"), ("s_num", "o_num"))))

    def chained(self, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        other = right.select(*(F.col(c).alias(f"_m_{c}") for c in right.columns))
        cond = (F.col("o") == F.col("_m_s")) & (F.col("o_kind") == F.col("_m_s_kind"))
        for k in keys:
            cond = cond & (F.col(k) == F.col(f"_m_{k}"))
        return left.join(other, cond).select(*keys, "s", "s_kind", "s_num", F.col("_m_o").alias("o"), F.col("_m_o_kind").alias("o_kind"), F.col("_m_o_num").alias("o_num"))

    def identity(self, data: Dataset, graph, keys: list[str], start: Const | None) -> DataFrame:
        q = self.quads(data, graph)
        if isinstance(graph, Var):
            q = q.withColumn("_g", F.col("g"))
        subjects = q.select(*keys, F.col("s").alias("x"), F.lit(IRI).cast("tinyint").alias("k"), F.lit(None).cast("double").alias("n"))
        nodes = subjects.unionByName(q.select(*keys, F.col("o").alias("x"), F.col("o_kind").alias("k"), F.col("o_num").alias("n"))).distinct()
        if start is not None:
            nodes = nodes.where((F.col("x") == start.lex) & (F.col("k") == start.kind))
        return nodes.select(*keys, *(F.col(a).alias(f"{e}{b}") for e in "so" for a, b in (("x", ""), ("k", "_kind"), ("n", "_num"))))

    def closure(self, step: DataFrame, keys: list[str], start: Const | None) -> DataFrame:
        """Transitive closure by rounds: only pairs that are new go on, and meet all known ones, so the
        reached distance doubles with each round. A constant start bounds it to what can be reached from
        there, HOPS steps a round. Each round is a written table; cycles end it, as nothing is new."""
        step = materialize(step, "path-step")
        first = step if start is None else step.where((F.col("s") == start.lex) & (F.col("s_kind") == start.kind))
        known = fresh = materialize(first, "path-0")
        on, turn = [*keys, "s", "s_kind", "o", "o_kind"], 0
        while True:
            turn += 1
            ahead = reached = self.chained(fresh, known if start is None else step, keys)
            for _ in range(0 if start is None else HOPS - 1):
                reached = self.chained(reached.dropDuplicates(on), step, keys)
                ahead = ahead.unionByName(reached)
            ahead = ahead.dropDuplicates(on).join(known.select(*on), on, "left_anti")
            ahead = materialize(ahead.select(*known.columns), f"path-{turn}")
            if not ahead.limit(1).count():
                discard(ahead)
                return known
            known, fresh = known.unionByName(ahead), ahead

    # -- groups
    def group(self, g: Group, data: Dataset | None = None, graph=None) -> Rel:
        data = data or self.dataset
        rel: Rel | None = None
        triples: list[Triple] = []
        filters: list = []

        def close() -> None:
            nonlocal rel, triples
            if triples:
                got = self.bgp(triples, data, graph)
                rel, triples = got if rel is None else self.join(rel, got), []

        def merge(other: Rel) -> None:
            nonlocal rel
            close()
            rel = other if rel is None else self.join(rel, other)

        for part in g.parts:
            if isinstance(part, Triple):
                triples.append(part)
            elif isinstance(part, Filter):
                filters.append(part.expr)
            elif isinstance(part, Optional_):
                close()
                inner_filters = [f.expr for f in part.group.parts if isinstance(f, Filter) and not _has_exists(f.expr)]
                inner = Group([p for p in part.group.parts if not (isinstance(p, Filter) and not _has_exists(p.expr))])
                rel = self.left_join(rel or self.unit(data), self.group(inner, data, graph), inner_filters)
            elif isinstance(part, Minus):
                close()
                rel = self.semi(rel or self.unit(data), self.group(part.group, data, graph), True, minus=True)
            elif isinstance(part, Union_):
                merge(self.union([self.group(x, data, graph) for x in part.groups]))
            elif isinstance(part, Group):
                merge(self.group(part, data, graph))
            elif isinstance(part, Graph):
                merge(self.group(part.group, data, part.name))
            elif isinstance(part, WindowPattern):
                window = self.windows.get(part.window)
                if window is None:
                    raise UnsupportedError(f"the window {part.window} can't be read here")
                merge(self.group(part.group, window, None))
            elif isinstance(part, Bind):
                close()
                base = rel or self.unit(data)
                v = Compiler(base.value, self.now_ms).value(part.expr)
                df = base.df.select(*(F.col(f"`{c}`") for c in base.df.columns), *_value_columns(v, part.var))
                rel = Rel(df, base.vars | {part.var: Info(False, False)}, base.keys)
            elif isinstance(part, Values):
                merge(self.values(part))
            elif isinstance(part, SubSelect):
                merge(self.select(part.query, data, graph))
        close()
        rel = rel or self.unit(data)
        for f in filters:
            rel = self.filter(rel, f, data, graph)
        return rel

    def unit(self, data: Dataset) -> Rel:
        """One empty solution (for each key)."""
        if data.keys:
            return Rel(data.quads.select(*data.keys).distinct(), {}, data.keys)
        return Rel(self.spark.range(1).select(F.lit(1).alias("_unit")), {}, ())

    def values(self, v: Values) -> Rel:
        fields, rows = [], []
        for n in v.names:
            fields += [f"`{n}` string", f"`{n}__k` tinyint", f"`{n}__n` double"]
        for row in v.rows:
            flat: list = []
            for c in row:
                # stored numbers are decimals, so a whole number meets them as one
                flat += [None, None, None] if c is None else [number_lex(c), c.kind if c.num is None else DECIMAL, c.num]
            rows.append(tuple(flat))
        df = self.spark.createDataFrame(rows, ", ".join(fields))
        return Rel(df, {n: Info(all(r[k] is not None for r in v.rows), False) for k, n in enumerate(v.names)}, ())

    def filter(self, rel: Rel, e, data: Dataset, graph) -> Rel:
        if isinstance(e, Call) and e.name == "and" and _has_exists(e):
            for a in e.args:
                rel = self.filter(rel, a, data, graph)
            return rel
        if isinstance(e, Exists):
            own = [p.expr for p in e.group.parts if isinstance(p, Filter) and not _has_exists(p.expr)]
            inner = self.group(Group([p for p in e.group.parts if not (isinstance(p, Filter) and not _has_exists(p.expr))]), data, graph)
            outer = [f for f in own if variables(f) - set(inner.vars)]
            for f in own:
                if f not in outer:
                    inner = self.filter(inner, f, data, graph)
            return self.semi(rel, inner, e.negated, outer)
        return Rel(rel.df.where(Compiler(rel.value, self.now_ms).truth(e)), rel.vars, rel.keys)

    # -- queries
    def select(self, q: Select, data: Dataset | None = None, graph=None) -> Rel:
        data = data or self.dataset
        rel = self.group(q.where, data, graph)
        aggregates: list[Aggregate] = []
        for node in [q.items or [], q.having, [e for e, _ in q.order_by]]:
            _find_aggregates(node, aggregates)
        if q.group_by or aggregates:
            rel, compiler = self.aggregate(rel, q, aggregates)
            for h in q.having:
                rel = Rel(rel.df.where(compiler(rel).truth(h)), rel.vars, rel.keys)
        else:
            compiler = lambda r: Compiler(r.value, self.now_ms)
        items = q.items if q.items is not None else [Item(v) for v in rel.vars if not v.startswith(("_anon", "_b_"))]
        # expressions see the ones before them
        for item in items:
            if item.expr is not None:
                v = compiler(rel).value(item.expr)
                kept = [c for c in rel.df.columns if c not in (item.name, f"{item.name}__k", f"{item.name}__n")]
                rel = Rel(rel.df.select(*(F.col(f"`{c}`") for c in kept), *_value_columns(v, item.name)), rel.vars | {item.name: Info(False, False)}, rel.keys)
        order: list[Column] = []
        for e, up in q.order_by:
            v = compiler(rel).value(e)
            rank = F.when(v.lex.isNull(), 0).when(v.kind_column == IRI, 1).otherwise(2)
            for c in (rank, v.number, v.lex):
                order.append(c.asc_nulls_first() if up else c.desc_nulls_last())
        df, keep = rel.df, [*rel.keys]
        for item in items:
            if item.name in rel.vars:
                keep += rel.columns(item.name)
            else:
                rel.vars[item.name] = Info(False, False)
                df = df.withColumns({item.name: F.lit(None).cast("string"), f"{item.name}__k": F.lit(None).cast("tinyint"), f"{item.name}__n": F.lit(None).cast("double")})
                keep += rel.columns(item.name)
        out = {i.name: rel.vars[i.name] for i in items}
        keep = [F.col(f"`{c}`") for c in keep]
        sliced = q.limit is not None or q.offset
        if q.distinct:
            df = df.select(*keep).distinct()
        if rel.keys and sliced:  # a slice of each window
            w = Window.partitionBy(*rel.keys).orderBy(*(order or [F.lit(1)]))
            df = df.withColumn("_rank", F.row_number().over(w)).where((F.col("_rank") > q.offset) & (F.lit(True) if q.limit is None else F.col("_rank") <= q.offset + q.limit)).drop("_rank")
            df = df.orderBy(*(F.col(k) for k in rel.keys), *order) if order else df
        else:
            if order:
                df = df.orderBy(*order)
            if q.offset:
                df = df.offset(q.offset)
            if q.limit is not None:
                df = df.limit(q.limit)
        return Rel(df.select(*keep), out, rel.keys)

    def aggregate(self, rel: Rel, q: Select, aggregates: list[Aggregate]):
        env = Compiler(rel.value, self.now_ms)
        groups, infos = [F.col(k) for k in rel.keys], {}
        for item in q.group_by:
            v = env.value(item.expr if item.expr is not None else Var(item.name))
            info = rel.vars.get(item.name, Info(False, False)) if item.expr is None else Info(False, False)
            groups += _value_columns(v, item.name, info.iri and item.expr is None and item.name in rel.vars)
            infos[item.name] = info
        built, values = [], {}
        for k, a in enumerate(aggregates):
            cols, value = self.aggregated(a, env, rel, f"_agg{k}")
            built += cols
            values[id(a)] = value
        built = built or [F.count(F.lit(1)).alias("_count")]
        df = rel.df.groupBy(*groups).agg(*built)
        out = Rel(df, infos, rel.keys)
        return out, lambda r: Compiler(r.value, self.now_ms, lambda a: values[id(a)])

    def aggregated(self, a: Aggregate, env: Compiler, rel: Rel, name: str) -> tuple[list[Column], Value]:
        """The columns of an aggregate, and its value over them."""
        c = lambda suffix="": F.col(f"{name}{suffix}")
        if a.expr is None:
            every = F.struct(*(F.col(f"`{x}`") for x in rel.df.columns))
            return [(F.count_distinct(every) if a.distinct else F.count(F.lit(1))).alias(name)], number_value(c(), INTEGER)
        v = env.value(a.expr)
        if a.name == "count":
            one = F.when(v.lex.isNotNull(), F.struct(v.lex, v.kind_column))
            return [(F.count_distinct(one) if a.distinct else F.count(v.lex)).alias(name)], number_value(c(), INTEGER)
        bad = F.count_if(v.lex.isNotNull() & v.number.isNull()).alias(f"{name}_bad")
        if a.name in ("sum", "avg"):
            n = v.number
            if a.distinct:
                total = F.sum_distinct(n) if a.name == "sum" else F.sum_distinct(n) / F.count_distinct(n)
                total = total if a.name == "sum" else F.try_divide(F.sum_distinct(n), F.count_distinct(n))
            else:
                total = F.sum(n) if a.name == "sum" else F.avg(n)
            return [total.alias(name), bad], number_value(F.when(c("_bad") == 0, F.coalesce(c(), F.lit(0.0))))
        if a.name in ("min", "max"):
            by, plain = (F.min_by, F.min) if a.name == "min" else (F.max_by, F.max)
            whole = F.struct(v.lex.alias("lex"), v.kind_column.alias("kind"))
            cols = [by(whole, v.number).alias(f"{name}_s"), plain(v.number).alias(name), bad, F.struct(plain(v.lex).alias("lex"), by(v.kind_column, v.lex).alias("kind")).alias(f"{name}_t")]
            numeric = c("_bad") == 0
            lex = F.when(numeric, F.col(f"{name}_s.lex")).otherwise(F.col(f"{name}_t.lex"))
            kind = F.when(numeric, F.col(f"{name}_s.kind")).otherwise(F.col(f"{name}_t.kind"))
            return cols, Value(lex, kind, F.when(numeric, c()))
        if a.name == "sample":
            whole = F.when(v.lex.isNotNull(), F.struct(v.lex.alias("lex"), v.kind_column.alias("kind"), v.number.alias("num")))
            return [F.min(whole).alias(name)], Value(F.col(f"{name}.lex"), F.col(f"{name}.kind"), F.col(f"{name}.num"))
        gathered = F.collect_set(v.lex) if a.distinct else F.collect_list(v.lex)
        return [F.array_join(F.array_sort(gathered), a.separator).alias(name)], text_value(c())

    def ask(self, q: Ask) -> DataFrame:
        """One row: answer."""
        return self.group(q.where).df.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))

    def construct(self, q: Construct) -> DataFrame:
        """Distinct triples (s, p, o, o_kind, o_num)."""
        rel = self.group(q.where)
        if q.limit is not None:
            rel = Rel(rel.df.limit(q.limit), rel.vars, rel.keys)
        env, frames = Compiler(rel.value, self.now_ms), []
        for t in q.template:
            s, p, o = env.value(t.s), env.value(t.p), env.value(t.o)
            made = rel.df.where(s.lex.isNotNull() & p.lex.isNotNull() & o.lex.isNotNull() & (s.kind_column == IRI) & (p.kind_column == IRI))
            frames.append(made.select(*rel.keys, s.lex.alias("s"), p.lex.alias("p"), o.lex.alias("o"), o.kind_column.alias("o_kind"), o.number.cast("double").alias("o_num")))
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out.dropDuplicates([*rel.keys, "s", "p", "o", "o_kind"])

    def describe(self, q: Describe) -> DataFrame:
        """The triples of which a described term is the subject."""
        quads = self.quads(self.dataset, None)
        fixed = [t.lex for t in q.terms if isinstance(t, Const)]
        about = self.spark.createDataFrame([(x,) for x in fixed], "about string")
        if q.where is not None:
            rel = self.group(q.where)
            names = [t.name for t in q.terms if isinstance(t, Var)] or list(rel.vars)
            for n in names:
                v = rel.value(n)
                if v is not None:
                    about = about.unionByName(rel.df.where(v.kind_column == IRI).select(v.lex.alias("about")))
        return quads.join(about.distinct(), F.col("s") == F.col("about"), "left_semi").select("s", "p", "o", "o_kind", "o_num").distinct()


def number_lex(c: Const) -> str:
    """A constant's text as stored terms have it: whole decimals without a point."""
    if c.num is None or c.num != c.num or abs(c.num) >= 1e15:
        return c.lex
    return str(int(c.num)) if c.num == int(c.num) else c.lex


def _has_exists(e) -> bool:
    if isinstance(e, Exists):
        return True
    return isinstance(e, Call) and any(map(_has_exists, e.args))


def _find_aggregates(node, out: list[Aggregate]) -> None:
    if isinstance(node, Aggregate):
        out.append(node)
    elif isinstance(node, (list, tuple)):
        for x in node:
            _find_aggregates(x, out)
    elif isinstance(node, Item):
        _find_aggregates(node.expr, out)
    elif hasattr(node, "args"):
        _find_aggregates(node.args, out)


def presented(rel: Rel, style: str = "plain") -> DataFrame:
    """A relation as one column for each variable: "plain" lexical forms, "ntriples" terms, "typed"
    (numbers as doubles where the lexical form is text), or "full" with kinds and numbers."""
    if style == "full":
        return rel.df
    cols = [F.col(k) for k in rel.keys]
    for v in rel.vars:
        value = rel.value(v)
        cols.append((value.lex if style == "plain" else ntriples(value.lex, value.kind_column)).alias(v))
    return rel.df.select(*cols)

