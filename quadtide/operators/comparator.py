"""Comparison of a live and a historical series over their last N points."""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ExecutionError
from ..functions.anomaly import EPSILON


@dataclass(frozen=True)
class Config:
    """Thresholds of the six comparisons; window_size is the number of points N."""

    abs_threshold: float = 1.0
    rel_threshold: float = 0.1
    catchup_trigger: float = 2.0
    slope_epsilon: float = 0.01
    volatility_buffer: float = 0.5
    window_size: int = 10
    outlier_z_threshold: float = 3.0


#: The kinds of events, in the order in which they are reported.
EVENTS = ("absolute_threshold_exceeded", "relative_change_exceeded", "catch_up", "trend_divergence", "volatility_increase", "live_outlier")


def trailing_stats(df: DataFrame, value: str, ts: str = "ts", by: tuple[str, ...] = (), n: int = 10, prefix: str = "") -> DataFrame:
    """Adds mean, std_dev (of the population), slope (least squares, 0 where it isn't defined) and
    count of the last n rows by time, for each row."""
    if not by:  # all rows would be one task's
        raise ExecutionError("a series needs a key")
    w = Window.partitionBy(*by).orderBy(ts).rowsBetween(-(n - 1), 0)
    x, y = F.col(ts).cast("double"), F.col(value)
    return df.select("*", F.avg(y).over(w).alias(f"{prefix}mean"), F.stddev_pop(y).over(w).alias(f"{prefix}std_dev"), F.coalesce(F.regr_slope(y, x).over(w), F.lit(0.0)).alias(f"{prefix}slope"), F.count(y).over(w).alias(f"{prefix}count"))


def compare(df: DataFrame, live: str = "live", hist: str = "hist", ts: str = "ts", by: tuple[str, ...] = (), config: Config = Config()) -> DataFrame:
    """A row for each event: the keys, the time, position, event, the two compared numbers and a text.

    Both series are given row by row; statistics are over the last window_size rows of a key."""
    c = config
    s = trailing_stats(trailing_stats(df, live, ts, by, c.window_size, "l_"), hist, ts, by, c.window_size, "h_")
    lm, hm, ls, hs, lb, hb = (F.col(x) for x in ("l_mean", "h_mean", "l_std_dev", "h_std_dev", "l_slope", "h_slope"))
    z = F.when(hs > EPSILON, F.try_divide(F.col(live) - hm, hs))
    change = F.when(F.abs(hm) > EPSILON, F.try_divide(lm - hm, hm))

    def event(k: int, test, a, b, *text):
        return F.when(test, F.struct(F.lit(k + 1).alias("position"), F.lit(EVENTS[k]).alias("event"), a.alias("live_value"), b.alias("hist_value"), F.concat(*text).alias("message")))

    show = lambda x: F.format_string("%.6f", x)
    events = F.array(
        event(0, F.abs(lm - hm) > c.abs_threshold, lm, hm, F.lit("means differ by "), show(F.abs(lm - hm))),
        event(1, change > c.rel_threshold, lm, hm, F.lit("mean changed by the share "), show(change)),
        event(2, hm - lm > c.catchup_trigger, lm, hm, F.lit("live mean is behind by "), show(hm - lm)),
        event(3, (lb * hb < 0) & (F.abs(lb) > c.slope_epsilon) & (F.abs(hb) > c.slope_epsilon), lb, hb, F.lit("slopes have opposite signs: "), show(lb), F.lit(" and "), show(hb)),
        event(4, ls > hs + c.volatility_buffer, ls, hs, F.lit("live deviation is larger: "), show(ls), F.lit(" and "), show(hs)),
        event(5, F.abs(z) > c.outlier_z_threshold, F.col(live), z, F.lit("z-score "), show(z)),
    )
    fired = s.select(*by, ts, F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e"))
    return fired.select(*by, ts, "e.*")


class Comparator:
    """The same comparison, point by point, for streaming state and for single series."""

    def __init__(self, config: Config = Config()):
        self.config = config
        self.live: deque[tuple[float, float]] = deque(maxlen=config.window_size)
        self.hist: deque[tuple[float, float]] = deque(maxlen=config.window_size)

    @staticmethod
    def stats(points) -> dict | None:
        """mean, std_dev, slope and count; None without points."""
        points = list(points)
        n = len(points)
        if not n:
            return None
        mean = math.fsum(v for _, v in points) / n
        std = math.sqrt(math.fsum((v - mean) ** 2 for _, v in points) / n)
        mid = math.fsum(t for t, _ in points) / n
        spread = math.fsum((t - mid) ** 2 for t, _ in points)
        slope = math.fsum((t - mid) * (v - mean) for t, v in points) / spread if n * spread >= EPSILON else 0.0
        return {"mean": mean, "std_dev": std, "slope": slope, "count": n}

    def update(self, ts: float, live: float, hist: float) -> list[tuple[str, float, float]]:
        """The events (name, live number, historical number) that this point triggers, in order."""
        self.live.append((ts, live))
        self.hist.append((ts, hist))
        c, a, b = self.config, self.stats(self.live), self.stats(self.hist)
        out = []
        if abs(a["mean"] - b["mean"]) > c.abs_threshold:
            out.append((EVENTS[0], a["mean"], b["mean"]))
        if abs(b["mean"]) > EPSILON and (a["mean"] - b["mean"]) / b["mean"] > c.rel_threshold:
            out.append((EVENTS[1], a["mean"], b["mean"]))
        if b["mean"] - a["mean"] > c.catchup_trigger:
            out.append((EVENTS[2], a["mean"], b["mean"]))
        if a["slope"] * b["slope"] < 0 and min(abs(a["slope"]), abs(b["slope"])) > c.slope_epsilon:
            out.append((EVENTS[3], a["slope"], b["slope"]))
        if a["std_dev"] > b["std_dev"] + c.volatility_buffer:
            out.append((EVENTS[4], a["std_dev"], b["std_dev"]))
        if b["std_dev"] > EPSILON:
            z = (live - b["mean"]) / b["std_dev"]
            if abs(z) > c.outlier_z_threshold:
                out.append((EVENTS[5], live, z))
        return out
