"""Windows over quads. Every function returns quads with key columns, so that all windows of a query
are evaluated in one job; contents are sets: repetitions of a quad inside a window count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ast import WindowSpec
from ..plans.compiler import Dataset, Wide

TERMS = ("s", "p", "o", "g", "o_kind", "o_num")


def time_range(quads: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Quads with start_ms <= ts_ms <= end_ms; the condition reaches the scan."""
    return quads.where(F.col("ts_ms").between(start_ms, end_ms))


def at_time(quads: DataFrame, ts_ms: int) -> DataFrame:
    return quads.where(F.col("ts_ms") == ts_ms)


def as_set(quads: DataFrame, *keys: str) -> DataFrame:
    """Distinct quads of each key, without their times."""
    return quads.select(*keys, *TERMS).dropDuplicates([*keys, "s", "p", "o", "g", "o_kind"])


def _name(quads: DataFrame) -> DataFrame:
    return quads.withColumn("_name", F.xxhash64("s", "p", "o", "g", "o_kind"))


def repeated(quads: DataFrame) -> DataFrame:
    """Hashes of the quads that occur more than once, at whatever times, and maybe a few of others (a
    collision): a quad that isn't among them is once in each of its windows."""
    return _name(quads).groupBy("_name").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_name")


def as_set_but(quads: DataFrame, repeats: DataFrame | None, *keys: str) -> DataFrame:
    """as_set, where only the quads of repeats (few; None: none at all) can repeat."""
    if repeats is None:
        return quads.select(*keys, *TERMS)
    named, few = _name(quads), F.broadcast(repeats)
    rest = named.join(few, "_name", "left_anti").select(*keys, *TERMS)
    return rest.unionByName(as_set(named.join(few, "_name", "left_semi"), *keys))


def fixed(quads: DataFrame, start_ms: int, end_ms: int, unique: bool = False) -> DataFrame:
    """The contents of one closed interval; unique: quads are known not to repeat in it."""
    inside = time_range(quads, start_ms, end_ms)
    return inside.select(*TERMS) if unique else as_set(inside)


def sliding_starts(spec: WindowSpec, now_ms: int) -> tuple[int, int]:
    """The first start and the number of windows of a sliding window over the past."""
    first = max(0, now_ms - spec.offset)
    return first, (now_ms - first) // spec.slide + 1


def assign_sliding(quads: DataFrame, spec: WindowSpec, now_ms: int) -> DataFrame:
    """Adds ws and we: closed windows [ws, min(ws + width, now)] from now - offset on, by slide.

    The windows of an event follow by arithmetic: no range join, and no window that holds nothing.
    """
    first, n = sliding_starts(spec, now_ms)
    inside = time_range(quads, first, now_ms)
    since = F.col("ts_ms") - first
    low = F.greatest(F.lit(0), F.ceil((since - spec.width) / spec.slide)).cast("long")
    high = F.least(F.lit(n - 1), F.floor(since / spec.slide)).cast("long")
    found = inside.withColumn("_low", low).withColumn("_high", high).where("_low <= _high")
    ws = F.explode(F.sequence("_low", "_high"))
    out = found.withColumn("_k", ws).withColumn("ws", (F.col("_k") * spec.slide + first).cast("long"))
    return out.withColumn("we", F.least(F.col("ws") + spec.width, F.lit(now_ms)).cast("long")).drop("_low", "_high", "_k")


def all_sliding(spark, spec: WindowSpec, now_ms: int) -> DataFrame:
    """ws and we of every window, empty ones too."""
    first, n = sliding_starts(spec, now_ms)
    ws = (F.col("id") * spec.slide + first).cast("long")
    return spark.range(n).select(ws.alias("ws"), F.least(ws + spec.width, F.lit(now_ms)).cast("long").alias("we"))


def assign_live(quads: DataFrame, width: int, slide: int) -> DataFrame:
    """Adds ws and we: half-open windows [ws, ws + width) with ws a multiple of slide. slide may be
    larger than width; then some events are in no window."""
    low = (F.floor((F.col("ts_ms") - width) / slide) + 1).cast("long")
    high = F.floor(F.col("ts_ms") / slide).cast("long")
    found = quads.withColumn("_low", low).withColumn("_high", high).where("_low <= _high")
    out = found.withColumn("_k", F.explode(F.sequence("_low", "_high"))).withColumn("ws", (F.col("_k") * slide).cast("long"))
    return out.withColumn("we", (F.col("ws") + width).cast("long")).drop("_low", "_high", "_k")


def _wide_dataset(wide: Wide, df: DataFrame, keys: tuple[str, ...], **options) -> Dataset:
    """Rows of a wide table are subjects of their own, so their quads don't repeat in a window."""
    w = Wide(df, wide.subject, wide.fields, wide.graph)
    return Dataset(w.quads().select(*keys, *TERMS), keys, wide=w, **options)


def fixed_dataset(quads: DataFrame | Wide, spec: WindowSpec, **options) -> Dataset:
    if isinstance(quads, Wide):
        return _wide_dataset(quads, time_range(quads.df, spec.start, spec.end), (), **options)
    return Dataset(fixed(quads, spec.start, spec.end), (), **options)


def sliding_dataset(quads: DataFrame | Wide, spec: WindowSpec, now_ms: int, unique: bool = False, **options) -> Dataset:
    if isinstance(quads, Wide):
        return _wide_dataset(quads, assign_sliding(quads.df, spec, now_ms), ("ws", "we"), **options)
    assigned = assign_sliding(quads, spec, now_ms)
    keyed = assigned.select("ws", "we", *TERMS) if unique else as_set(assigned, "ws", "we")
    return Dataset(keyed, ("ws", "we"), **options)


def live_dataset(quads: DataFrame | Wide, spec: WindowSpec, **options) -> Dataset:
    """One live window by itself: keys ws and we; stamps have the time of each window's last quad."""
    if isinstance(quads, Wide):
        assigned = assign_live(quads.df, spec.width, spec.slide)
        data = _wide_dataset(quads, assigned, ("ws", "we"), **options)
    else:
        assigned = assign_live(quads, spec.width, spec.slide)
        data = Dataset(as_set(assigned, "ws", "we"), ("ws", "we"), **options)
    data.stamps = assigned.groupBy("ws", "we").agg(F.max("ts_ms").alias("last_ms"))
    return data


def ending(assigned: DataFrame, closing: tuple[int | None, int] | None) -> DataFrame:
    """The rows of windows that end in (after, upto]; after None: however early, closing None: all."""
    if closing is None:
        return assigned
    after, upto = closing
    found = assigned.where(F.col("we") <= upto)
    return found if after is None else found.where(F.col("we") > after)


def closing_datasets(streams: list[tuple[WindowSpec, DataFrame, set[str] | None]], closing: tuple[int | None, int], sets=as_set) -> dict[str, Dataset]:
    """The datasets of the live windows that end in (after, upto], as joined_live_datasets takes and has them;
    for one window by itself without the key by, and made a set by `sets`."""
    if len(streams) > 1:
        return joined_live_datasets(streams, closing)
    (w, quads, names), = streams
    assigned = ending(assign_live(quads, w.width, w.slide), closing)
    wanted = assigned if names is None else assigned.where(F.col("p").isin(*names))
    stamps = assigned.groupBy("ws", "we").agg(F.max("ts_ms").alias("last_ms"))
    return {w.name: Dataset(sets(wanted, "ws", "we"), ("ws", "we"), stamps=stamps)}


def open_at(spec: WindowSpec, at):
    """The start of a live window's instance that is open at a time, the one that opened first; with a
    slide over the width it may start later than that time, and then none is open."""
    return (F.floor((at - spec.width) / spec.slide) + 1).cast("long") * spec.slide


def joined_live_datasets(streams: list[tuple[WindowSpec, DataFrame, set[str] | None]], closing: tuple[int | None, int] | None = None, **options) -> dict[str, Dataset]:
    """Several live windows: when an instance of one of them closes at we, its last quad being of t, it
    meets of each other window the instance that is open at t, the one that opened first, with what that
    has before we. The query runs for every instance with content, whether the others hold anything or not.

    streams: for each window its stream and the predicates that its patterns can match (None: any); other
    quads count for the firings alone. Keys: by (which window fired), ws and we; stamps have t of the
    instance that fired. closing: only of instances that end in (after, upto].
    """
    streams = [(w, q.quads() if isinstance(q, Wide) else q, names) for w, q, names in streams]
    wanted = {w.name: q if names is None else q.where(F.col("p").isin(*names)) for w, q, names in streams}
    assigned = {w.name: assign_live(wanted[w.name], w.width, w.slide) for w, *_ in streams}
    firings = None
    for k, (w, q, _) in enumerate(streams):
        f = ending(assign_live(q.select("ts_ms"), w.width, w.slide), closing).groupBy("ws", "we").agg(F.max("ts_ms").alias("last_ms")).select(F.lit(k).alias("by"), "ws", "we", "last_ms")
        firings = f if firings is None else firings.unionByName(f)
    out = {}
    for k, (w, *_) in enumerate(streams):
        own = ending(assigned[w.name], closing).select(F.lit(k).alias("by"), "ws", "we", *TERMS)
        asked = firings.where(F.col("by") != k).withColumn("_ws", open_at(w, F.col("last_ms"))).where("_ws <= last_ms").drop("last_ms")
        content = assigned[w.name].select(F.col("ws").alias("_ws"), "ts_ms", *TERMS)
        met = asked.join(content, "_ws").where("ts_ms < we").select("by", "ws", "we", *TERMS)
        out[w.name] = Dataset(as_set(own.unionByName(met), "by", "ws", "we"), ("by", "ws", "we"), stamps=firings, **options)
    return out


def iterate(quads: DataFrame, spec: WindowSpec, now_ms: int | None = None):
    """(ws, we, quads) of each window over the past in turn, for code that wants one at a time; the
    contents are lazy. One job for all windows is what assign_sliding is for."""
    if spec.kind == "fixed":
        yield spec.start, spec.end, time_range(quads, spec.start, spec.end)
        return
    if spec.kind != "sliding" or now_ms is None:
        raise ValueError("a sliding window over the past needs its offset and the time it ends at")
    first, n = sliding_starts(spec, now_ms)
    for k in range(n):
        ws = first + k * spec.slide
        we = min(ws + spec.width, now_ms)
        yield ws, we, time_range(quads, ws, we)
