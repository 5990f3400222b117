"""The comparator over a stream: the last N points of each key are state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.comparator import EVENTS, Comparator, Config

_OUT = "ts double, position int, event string, live_value double, hist_value double"
_STATE = "ts array<double>, live array<double>, hist array<double>"


def compare_stream(stream: DataFrame, key: str, config: Config = Config()) -> DataFrame:
    """Events of a streaming DataFrame (key, ts, live, hist). Rows of a micro-batch are taken by time;
    a row older than the last of its key still enters where it arrives."""

    def step(keys, frames, state: GroupState):
        c = Comparator(config)
        if state.exists:
            for t, a, b in zip(*state.get):
                c.live.append((t, a))
                c.hist.append((t, b))
        out = []
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        for ts, a, b in zip(rows["ts"].astype(float), rows["live"].astype(float), rows["hist"].astype(float)):
            out += [(keys[0], ts, EVENTS.index(e) + 1, e, x, y) for e, x, y in c.update(ts, a, b)]
        state.update(([t for t, _ in c.live], [v for _, v in c.live], [v for _, v in c.hist]))
        if out:
            yield pd.DataFrame(out, columns=[key, "ts", "position", "event", "live_value", "hist_value"])

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {_OUT}", _STATE, "append", GroupStateTimeout.NoTimeout)
