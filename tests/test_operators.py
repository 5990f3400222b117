import math

import pytest

from quadtide.model import quads_of
from quadtide.operators import baseline, comparator
from quadtide.operators.comparator import Comparator, Config
from quadtide.plans.hybrid import HybridEvaluation

E = "http://e/"


def test_stats():
    s = Comparator.stats([(0, 1), (1, 3), (2, 5)])
    assert s == {"mean": 3.0, "std_dev": pytest.approx(math.sqrt(8 / 3)), "slope": 2.0, "count": 3}
    assert Comparator.stats([]) is None and Comparator.stats([(4, 2)])["slope"] == 0.0 and Comparator.stats([(4, 2), (4, 9)])["slope"] == 0.0


def test_triggers():
    c = Comparator(Config(abs_threshold=10, catchup_trigger=5, slope_epsilon=0.1, window_size=5, rel_threshold=9, volatility_buffer=99, outlier_z_threshold=99))
    assert [e for e, *_ in c.update(0, 90, 100)] == ["catch_up"]
    assert "trend_divergence" in [e for e, *_ in c.update(1, 89, 101)]


def test_outlier():
    c = Comparator(Config(abs_threshold=999, rel_threshold=999, catchup_trigger=999, slope_epsilon=999, volatility_buffer=999, outlier_z_threshold=2))
    for t in range(10):
        assert c.update(t, 100, 100 + (t % 2)) == []
    assert c.update(10, 100.5, 100.5) == []
    assert [e for e, *_ in c.update(11, 150, 100.6)] == ["live_outlier"]


def test_dataframe_equals_loop(spark):
    import random

    rng = random.Random(5)
    points = [(float(t), rng.gauss(10, 3), rng.gauss(10, 1)) for t in range(60)]
    df = spark.createDataFrame([("k", *p) for p in points], "k string, ts double, live double, hist double")
    got = [(r["ts"], r["position"], round(r["live_value"], 9), round(r["hist_value"], 9)) for r in comparator.compare(df, by=("k",)).orderBy("ts", "position").collect()]
    c, want = Comparator(), []
    for p in points:
        want += [(p[0], comparator.EVENTS.index(e) + 1, round(a, 9), round(b, 9)) for e, a, b in c.update(*p)]
    assert got == want and len(want) > 20


def _base(spark, rows, past, mode="AGGREGATE", now=1000, body="?sensor e:v ?mean"):
    text = f"PREFIX e: <{E}> SELECT * FROM NAMED WINDOW e:h ON STREAM e:g {past} FROM NAMED WINDOW e:l ON STREAM e:s [RANGE 10 STEP 10] USING BASELINE e:h {mode} WHERE {{ WINDOW e:h {{ {body} }} WINDOW e:l {{ ?sensor e:w ?x }} }}"
    q = quads_of(spark, rows)
    return sorted((r["s"], r["p"], r["o"]) for r in HybridEvaluation(text, log=q, streams=q, now_ms=now).baseline().collect())


def test_baseline_mean(spark):
    rows = [(1, E + "s1", E + "v", "10", E + "g"), (2, E + "s1", E + "v", "20", E + "g")]
    assert _base(spark, rows, "[START 0 END 9]") == [(E + "s1", baseline.NAMESPACE + "mean", "15")]


def test_baseline_last_window(spark):
    rows = [(100, E + "s1", E + "v", "10", E + "g"), (900, E + "s1", E + "v", "30", E + "g"), (1000, E + "s1", E + "v", "30", E + "g")]
    assert _base(spark, rows, "[OFFSET 1000 RANGE 200 STEP 500]", "LAST") == [(E + "s1", baseline.NAMESPACE + "mean", "30")]
    assert _base(spark, rows[:1], "[OFFSET 1000 RANGE 200 STEP 500]", "LAST") == []  # the last window is empty
    # overlapping windows weigh rows again
    assert _base(spark, [(100, E + "s1", E + "v", "10", E + "g"), (160, E + "s1", E + "v", "40", E + "g")], "[OFFSET 1000 RANGE 100 STEP 100]") == [(E + "s1", baseline.NAMESPACE + "mean", "20")]


def test_baseline_texts_and_anchor(spark):
    rows = [(1, E + "s1", E + "v", "10", E + "g"), (2, E + "s1", E + "v", "warm", E + "g"), (3, E + "s1", E + "room", E + "r1", E + "g")]
    got = _base(spark, rows, "[START 0 END 9]", body="?sensor e:v ?mean ; e:room ?room")
    assert got == [(E + "s1", baseline.NAMESPACE + "mean", "warm"), (E + "s1", baseline.NAMESPACE + "room", E + "r1")]
    # without a preferred name the first variable by name that holds an IRI is the entity
    assert _base(spark, rows[:1], "[START 0 END 9]", body="?zz e:v ?aa") == [(E + "s1", baseline.NAMESPACE + "aa", "10")]


def test_baseline_join_in_any_namespace(spark):
    q = quads_of(spark, [(1, E + "s1", E + "v", "23", E + "g"), (2, E + "s1", E + "v", "27", E + "g")])
    live = quads_of(spark, [(5, E + "s1", E + "w", "40", ""), (6, E + "s2", E + "w", "40", "")])
    text = f"""PREFIX e: <{E}> PREFIX b: <https://some.example/baseline#> PREFIX f: <https://some.example/fn#>
      SELECT ?sensor ?mean ?x FROM NAMED WINDOW e:h ON LOG e:g [START 0 END 9] FROM NAMED WINDOW e:l ON STREAM e:s [RANGE 10 STEP 10]
      WHERE {{ WINDOW e:h {{ ?sensor e:v ?mean }} WINDOW e:l {{ ?sensor e:w ?x }} ?sensor b:mean ?m . FILTER(f:is_outlier(?x, ?m, 2, 3)) }}"""
    got = HybridEvaluation(text, log=q, streams=live).live().collect()
    assert [(r["sensor"], r["x"]) for r in got] == [(E + "s1", "40")]


def test_baseline_at_a_threshold(spark, tmp_path):
    """Readings that are exactly three times their user's mean don't exceed it, in whatever order the
    baseline's values are added; of these, each sum of doubles is too small."""
    from quadtide import workload

    users = [([63.87, 70.91, 0.35], 135.13), ([36.33, 71.75, 81.24], 189.32), ([83.19, 31.11, 49.71], 164.01)]
    rows = [(0, u, v) for u, (past, _) in enumerate(users) for v in past] + [(20, u, x + d) for u, (_, x) in enumerate(users) for d in (0, 1)]
    events = spark.createDataFrame(rows, "day int, user_id long, value double").selectExpr("monotonically_increasing_id() AS event_id", "make_timestamp_ntz(2024, 1, 1 + day, 1, 0, 0) AS ts", "user_id", "'view' AS event_type", "value")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = workload.QUERIES["hybrid_baseline_join"](spark, str(tmp_path)).collect()
    assert sorted((r["u"], r["x"]) for r in got) == [(f"http://ex.org/user/{u}", x + 1) for u, (_, x) in enumerate(users)]
