"""Relation-to-stream operators over the results of consecutive windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryParseError


def rstream(results: DataFrame) -> DataFrame:
    """Every result of every window."""
    return results


def _against(results: DataFrame, slide: int | Column, key: str, direction: int, stamps: tuple[str, ...]) -> DataFrame:
    """Results of a window that the window `direction` slides away doesn't have."""
    values = [c for c in results.columns if c != key and c not in stamps]
    other = results.select((F.col(key) + direction * slide).alias("_k"), *(F.col(f"`{c}`").alias(f"_o_{c}") for c in values)).distinct()
    cond = F.col(key) == F.col("_k")
    for c in values:
        cond = cond & F.col(f"`{c}`").eqNullSafe(F.col(f"`_o_{c}`"))
    return results.join(other, cond, "left_anti")


def istream(results: DataFrame, slide: int | Column, key: str = "ws", stamps: tuple[str, ...] = ("we", "last_ms", "ts")) -> DataFrame:
    """Results that the window before doesn't have."""
    return _against(results, slide, key, 1, stamps)


def dstream(results: DataFrame, slide: int | Column, key: str = "ws", stamps: tuple[str, ...] = ("we", "last_ms", "ts")) -> DataFrame:
    """Results that the window after no longer has, under the window that had them; a window without
    a successor in the results loses all."""
    return _against(results, slide, key, -1, stamps)


def apply(operator: str, results: DataFrame, slide: int | Column, key: str = "ws") -> DataFrame:
    """slide: a column where it depends on the row, as with several windows."""
    name = operator.lower()
    if name in ("rstream", "stream"):
        return rstream(results)
    if name == "istream":
        return istream(results, slide, key)
    if name == "dstream":
        return dstream(results, slide, key)
    raise QueryParseError(f"unknown operator {operator!r}")
