"""Query algebra as dataclasses. Terms: Var, or Const with the kinds of quadtide.model."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    lex: str
    kind: int
    num: float | None = None


Term = Var | Const


# property paths
@dataclass(frozen=True)
class Link:
    iri: str


@dataclass(frozen=True)
class Inverse:
    path: object


@dataclass(frozen=True)
class Sequence:
    left: object
    right: object


@dataclass(frozen=True)
class Alternative:
    left: object
    right: object


@dataclass(frozen=True)
class Repeat:
    path: object
    least: int  # 0 or 1
    many: bool  # false for "?"


@dataclass(frozen=True)
class NotIn:
    forward: tuple[str, ...]
    backward: tuple[str, ...]


# patterns
@dataclass(frozen=True)
class Triple:
    s: Term
    p: object  # a term or a path
    o: Term


@dataclass
class Group:
    parts: list = field(default_factory=list)


@dataclass
class Filter:
    expr: object


@dataclass
class Optional_:
    group: Group


@dataclass
class Union_:
    groups: list[Group]


@dataclass
class Minus:
    group: Group


@dataclass
class Graph:
    name: Term
    group: Group


@dataclass
class WindowPattern:
    window: str
    group: Group


@dataclass
class Bind:
    expr: object
    var: str


@dataclass
class Values:
    names: list[str]
    rows: list[list[Const | None]]


@dataclass
class SubSelect:
    query: Select


# expressions
@dataclass
class Call:
    name: str  # lower-case operator or built-in
    args: list


@dataclass
class IriCall:
    iri: str
    args: list


@dataclass
class Exists:
    group: Group
    negated: bool


@dataclass
class Aggregate:
    name: str
    expr: object | None  # None for COUNT(*)
    distinct: bool
    separator: str = " "


@dataclass
class Item:
    """A projected variable, or an expression AS a variable."""

    name: str
    expr: object | None = None


@dataclass
class Select:
    items: list[Item] | None  # None for *
    where: Group
    distinct: bool = False
    group_by: list = field(default_factory=list)  # Item or Var
    having: list = field(default_factory=list)
    order_by: list[tuple[object, bool]] = field(default_factory=list)  # (expression, ascending)
    limit: int | None = None
    offset: int = 0


@dataclass
class Ask:
    where: Group


@dataclass
class Construct:
    template: list[Triple]
    where: Group
    limit: int | None = None


@dataclass
class Describe:
    terms: list[Term]
    where: Group | None


# hybrid queries
@dataclass(frozen=True)
class WindowSpec:
    """kind: "fixed" (start, end), "sliding" (offset, width, slide; over the past), "live" (width, slide)."""

    name: str
    source: str  # "stream" or "log"
    stream: str
    kind: str
    width: int = 0
    slide: int = 0
    offset: int = 0
    start: int = 0
    end: int = 0

    @property
    def historical(self) -> bool:
        return self.kind != "live"

    def time_range(self, now_ms: int) -> tuple[int, int]:
        """The interval of the first evaluation of a window over the past."""
        if self.kind == "fixed":
            return self.start, self.end
        if self.kind == "sliding":
            begin = max(0, now_ms - self.offset)
            return begin, begin + self.width
        raise ValueError(f"{self.name} is a live window: it has no range in the past")


@dataclass
class Baseline:
    window: str
    mode: str  # "last" or "aggregate"


@dataclass
class HybridQuery:
    prefixes: dict[str, str]
    operator: str  # RStream, IStream or DStream
    name: str
    select: Select
    windows: list[WindowSpec]
    baseline: Baseline | None

    @property
    def historical_windows(self) -> list[WindowSpec]:
        return [w for w in self.windows if w.historical]

    @property
    def live_windows(self) -> list[WindowSpec]:
        return [w for w in self.windows if not w.historical]


def variables(node) -> set[str]:
    """All variables that a pattern, expression or term mentions (EXISTS groups included)."""
    if isinstance(node, Var):
        return {node.name}
    if isinstance(node, (list, tuple)):
        return set().union(*map(variables, node)) if node else set()
    if isinstance(node, Bind):
        return variables(node.expr) | {node.var}
    if isinstance(node, Values):
        return set(node.names)
    if isinstance(node, SubSelect):
        q = node.query
        return {i.name for i in q.items} if q.items is not None else variables(q.where)
    if isinstance(node, Item):
        return {node.name} | variables(node.expr)
    if hasattr(node, "__dataclass_fields__"):
        return set().union(set(), *(variables(getattr(node, f)) for f in node.__dataclass_fields__))
    return set()


def _walk(node):
    """Every node of a query's algebra, however deep."""
    yield node
    inner = node if isinstance(node, (list, tuple)) else [getattr(node, f.name) for f in fields(node)] if is_dataclass(node) else []
    for x in inner:
        yield from _walk(x)


def bodies(node, window: str) -> list[Group]:
    """The patterns inside a window, wherever they stand in a query."""
    return [x.group for x in _walk(node) if isinstance(x, WindowPattern) and x.window == window]


def wanted_predicates(group: Group) -> set[str] | None:
    """The constant predicates that a window's patterns can match; None if any predicate can."""
    triples = [x for x in _walk(group) if isinstance(x, Triple)]
    return {t.p.lex for t in triples} if all(isinstance(t.p, Const) for t in triples) else None
