"""Collapses the solutions of a window over the past to compact statements for each entity."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import IRI, mean, number_text, parse_number, typed
from ..plans.compiler import Rel

#: Preferred names of the variable that holds the entity.
ANCHORS = ("sensor", "subject", "entity", "s")
NAMESPACE = "https://quadtide.example/baseline#"
_ANY_NAMESPACE = re.compile(r"^https?://[^\s<>]*/baseline#(?=\w+$)")


def own_namespace(iri: str) -> str:
    """Predicates of baselines are known by their local name after any namespace that ends in /baseline#."""
    return _ANY_NAMESPACE.sub(NAMESPACE, iri)


def statements(rel: Rel, mode: str = "aggregate", last_ws: int | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """(s, p, o): for each entity and other variable, the mean if all values are numbers, else the
    last value, by (window start, order columns, value).

    The entity is the first of ANCHORS that is bound to an IRI, else the first variable by name that
    is; rows without one are left out. mode "last": only the window that starts at last_ws, the last
    of all windows, counts, even if it is empty; "aggregate": all count, so a solution in
    overlapping windows counts in each.
    """
    df, names = rel.df, sorted(rel.vars)
    if mode == "last" and "ws" in rel.keys:
        df = df.where(F.col("ws") == last_ws)
    chain = [v for v in ANCHORS if v in rel.vars] + [v for v in names if v not in ANCHORS]
    anchor_var, anchor = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v in reversed(chain):
        value = rel.value(v)
        is_iri = value.lex.isNotNull() & (value.kind_column == IRI)
        anchor_var = F.when(is_iri, F.lit(v)).otherwise(anchor_var)
        anchor = F.when(is_iri, value.lex).otherwise(anchor)
    cells = F.array(*(F.struct(F.lit(v).alias("var"), rel.value(v).lex.alias("lex")) for v in names))
    sort = [c for c in ("ws", *order) if c in df.columns]
    long = df.select(anchor.alias("_anchor"), anchor_var.alias("_anchor_var"), *sort, F.explode(cells).alias("c"))
    long = long.where("_anchor IS NOT NULL AND c.lex IS NOT NULL AND c.var <> _anchor_var").select("_anchor", *sort, F.col("c.var").alias("var"), F.col("c.lex").alias("lex"))
    number = parse_number(F.col("lex"))
    kept = long.withColumn("_n", number).groupBy("_anchor", "var").agg(
        mean(F.col("_n")).alias("mean"), F.count("_n").alias("numbers"), F.count(F.lit(1)).alias("many"), F.max(F.struct(*sort, "lex")).alias("last"))
    value = F.when((F.col("numbers") == F.col("many")), number_text(F.col("mean"))).otherwise(F.col("last.lex"))
    return kept.select(F.col("_anchor").alias("s"), F.concat(F.lit(NAMESPACE), F.col("var")).alias("p"), value.alias("o"))


def as_static(found: DataFrame) -> DataFrame:
    """Statements as quads of the default graph, each once."""
    return typed(found.dropDuplicates(["s", "p", "o"]).select(F.lit(0).cast("long").alias("ts_ms"), "s", "p", "o", F.lit("").alias("g")))
