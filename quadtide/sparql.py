"""SPARQL over a DataFrame of quads."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .plans.ast import Ask, Construct, Describe, Select
from .plans.compiler import Dataset, Plan, presented
from .plans.parser import parse_sparql


def query(quads: DataFrame | Dataset, text: str, style: str = "plain", now_ms: int | None = None, prefixes: dict[str, str] | None = None) -> DataFrame:
    """The result of any query form, lazily: SELECT as a column for each variable, ASK as one row
    (answer), CONSTRUCT and DESCRIBE as triples."""
    data = quads if isinstance(quads, Dataset) else Dataset(quads)
    plan, q = Plan(data, now_ms=now_ms), parse_sparql(text, prefixes)
    if isinstance(q, Select):
        return presented(plan.select(q), style)
    if isinstance(q, Ask):
        return plan.ask(q)
    if isinstance(q, Construct):
        return plan.construct(q)
    assert isinstance(q, Describe)
    return plan.describe(q)


def ask(quads: DataFrame, text: str) -> bool:
    return bool(query(quads, text).first()["answer"])
