"""Anomaly functions as Column builders, and the registry that queries look them up in.

All comparisons are strict. A NaN argument makes a boolean rule false (Spark would order NaN above
everything and equal to itself).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16  # of a double


def _finite_or_null(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def _rule(test: Column, *args: Column) -> Column:
    nan = F.lit(False)
    for a in args:
        nan = nan | F.isnan(a)
    return F.when(nan, F.lit(False)).otherwise(test)


def abs_diff(live: Column, hist: Column) -> Column:
    return F.abs(live - hist)


def relative_change(live: Column, hist: Column) -> Column:
    """(live - hist) / hist, unbound where that isn't finite."""
    return _finite_or_null(F.try_divide(live - hist, hist))


def zscore(value: Column, mean: Column, sigma: Column) -> Column:
    """0 where sigma is about 0."""
    return F.when(F.abs(sigma) < EPSILON, F.lit(0.0)).otherwise(F.try_divide(value - mean, sigma))


def absolute_threshold_exceeded(live: Column, hist: Column, threshold: Column) -> Column:
    return _rule(F.abs(live - hist) > threshold, live, hist, threshold)


def relative_threshold_exceeded(live: Column, hist: Column, threshold: Column) -> Column:
    """By IEEE rules: at hist = 0 the change is infinite with live's sign, and 0 / 0 exceeds nothing."""
    at_zero = F.when(live > 0, threshold < float("inf")).otherwise(F.lit(False))
    at_zero = F.when((live < 0) & (threshold == float("-inf")), F.lit(False)).otherwise(at_zero)
    return _rule(F.when(hist == 0, at_zero).otherwise(F.try_divide(live - hist, hist) > threshold), live, hist, threshold)


def catch_up(hist: Column, live: Column, threshold: Column) -> Column:
    """Whether live is behind hist by more than the threshold; hist comes first."""
    return _rule((hist - live) > threshold, hist, live, threshold)


def volatility_increase(live_sigma: Column, hist_sigma: Column, buffer: Column) -> Column:
    return _rule(live_sigma > hist_sigma + buffer, live_sigma, hist_sigma, buffer)


def is_outlier(value: Column, mean: Column, sigma: Column, limit: Column) -> Column:
    """A sigma of about 0 gives a z-score of 0, so nothing is an outlier then."""
    return _rule(F.abs(zscore(value, mean, sigma)) > limit, value, mean, sigma, limit)


def trend_divergent(live_slope: Column, hist_slope: Column, epsilon: Column) -> Column:
    """Whether the slopes differ by more than epsilon, whatever their signs."""
    return _rule(F.abs(live_slope - hist_slope) > epsilon, live_slope, hist_slope, epsilon)


@dataclass(frozen=True)
class Function:
    name: str
    build: Callable[..., Column]
    arity: int
    boolean: bool


_BUILTIN = [
    Function("abs_diff", abs_diff, 2, False),
    Function("relative_change", relative_change, 2, False),
    Function("zscore", zscore, 3, False),
    Function("absolute_threshold_exceeded", absolute_threshold_exceeded, 3, True),
    Function("relative_threshold_exceeded", relative_threshold_exceeded, 3, True),
    Function("catch_up", catch_up, 3, True),
    Function("volatility_increase", volatility_increase, 3, True),
    Function("is_outlier", is_outlier, 4, True),
    Function("trend_divergent", trend_divergent, 3, True),
]

#: The anomaly functions are found by local name in any namespace that ends so.
NAMESPACE_END = "/fn#"
NAMESPACE = "https://quadtide.example/fn#"
_OWN: dict[str, Function] = {f.name: f for f in _BUILTIN}
_USER: dict[str, Function] = {}


def register_function(iri: str, build: Callable[..., Column], arity: int, boolean: bool = False) -> None:
    """Makes a Column builder (of double Columns) callable from queries by its IRI. A builder may wrap
    a pandas UDF; built-in functions stay inside code generation."""
    _USER[iri] = Function(iri, build, arity, boolean)


def lookup(iri: str) -> Function | None:
    if iri in _USER:
        return _USER[iri]
    head, mark, local = iri.rpartition(NAMESPACE_END)
    return _OWN.get(local) if mark else None


def all_functions() -> list[Function]:
    return [*_OWN.values(), *_USER.values()]


def evaluate_rule(name: str, args: list[float]) -> bool:
    """One scalar call of a boolean rule, outside Spark; ValueError on a wrong number of arguments."""
    f = _OWN.get(name)
    if f is None or not f.boolean:
        raise KeyError(name)
    if len(args) != f.arity:
        raise ValueError(f"{name} takes {f.arity} arguments, not {len(args)}")
    import math

    if any(math.isnan(a) for a in args):
        return False
    if name == "absolute_threshold_exceeded":
        return abs(args[0] - args[1]) > args[2]
    if name == "relative_threshold_exceeded":
        live, hist, t = args
        change = (live - hist) / hist if hist else math.copysign(math.inf, live) if live else math.nan
        return change > t
    if name == "catch_up":
        return args[0] - args[1] > args[2]
    if name == "volatility_increase":
        return args[0] > args[1] + args[2]
    if name == "is_outlier":
        v, m, s, z = args
        return abs(0.0 if abs(s) < EPSILON else (v - m) / s) > z
    return abs(args[0] - args[1]) > args[2]
