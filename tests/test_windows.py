import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quadtide.model import quads_of
from quadtide.operators import r2s, windows
from quadtide.plans.ast import WindowSpec
from quadtide.plans.hybrid import HybridEvaluation

E = "http://e/"


def sensors(spark, times, per=1):
    return quads_of(spark, [(t, f"{E}s{t}_{k}", E + "v", str(k), E + "g") for t in times for k in range(per)])


def test_fixed_closed_interval(spark):
    q = sensors(spark, range(100, 700, 100), 3)
    got = windows.time_range(q, 200, 500)
    assert got.count() == 12
    times = sorted(r["ts_ms"] for r in got.collect())
    assert (times[0], times[-1]) == (200, 500)
    assert windows.fixed(sensors(spark, range(100, 700, 100), 3), 150, 450).count() == 9


def test_sliding_counts(spark):
    now = 10_000
    q = sensors(spark, range(now - 500, now + 1, 100), 2)
    got = windows.assign_sliding(q, WindowSpec("w", "log", "x", "sliding", 200, 100, 500), now).groupBy("ws").count().collect()
    counts = {r["ws"]: r["count"] for r in got}
    assert [counts[now - 500 + 100 * k] for k in range(3)] == [6, 6, 6]
    assert counts[now] == 2  # the last window is cut off at now


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 300), min_size=1, max_size=30), st.integers(1, 120), st.integers(1, 120), st.integers(0, 250))
def test_sliding_equals_naive(spark, times, width, slide, offset):
    now = 260
    q = quads_of(spark, [(t, f"{E}{k}", E + "p", "1", "") for k, t in enumerate(times)])
    spec = WindowSpec("w", "log", "x", "sliding", width, slide, offset)
    got = sorted((r["ws"], r["we"], r["s"]) for r in windows.assign_sliding(q, spec, now).collect())
    want, ws = [], max(0, now - offset)
    while ws <= now:
        we = min(ws + width, now)
        want += [(ws, we, f"{E}{k}") for k, t in enumerate(times) if ws <= t <= we]
        ws += slide
    assert got == sorted(want)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 300), min_size=1, max_size=30), st.integers(1, 120), st.integers(1, 120))
def test_live_equals_naive(spark, times, width, slide):
    q = quads_of(spark, [(t, f"{E}{k}", E + "p", "1", "") for k, t in enumerate(times)])
    got = sorted((r["ws"], r["s"]) for r in windows.assign_live(q, width, slide).collect())
    want = [(k * slide, f"{E}{i}") for i, t in enumerate(times) for k in range(-130, 310) if k * slide <= t < k * slide + width]
    assert got == sorted(want)


def test_set_semantics(spark):
    q = quads_of(spark, [(1, E + "a", E + "p", "1", ""), (2, E + "a", E + "p", "1", ""), (3, E + "a", E + "p", "2", "")])
    text = f"PREFIX e: <{E}> SELECT (COUNT(?o) AS ?n) FROM NAMED WINDOW e:w ON STREAM e:s [RANGE 10 STEP 10] WHERE {{ WINDOW e:w {{ ?s e:p ?o }} }}"
    (r,) = HybridEvaluation(text, streams=q).live().collect()
    assert r["n"] == "2" and r["ts"] == 13


def test_log_needs_one_named_graph(spark):
    q = quads_of(spark, [(1, E + "a", E + "p", "1", E + "g1"), (1, E + "a", E + "q", "2", E + "g2"), (1, E + "b", E + "p", "1", E + "g1"), (1, E + "b", E + "q", "2", E + "g1"), (1, E + "c", E + "p", "1", ""), (1, E + "c", E + "q", "1", "")])
    text = f"PREFIX e: <{E}> SELECT ?s FROM NAMED WINDOW e:w ON {{}} [START 0 END 9] WHERE {{{{ WINDOW e:w {{{{ ?s e:p ?x ; e:q ?y }}}} }}}}"
    assert [r["s"] for r in HybridEvaluation(text.format("LOG e:any"), log=q).historical().collect()] == [E + "b"]
    assert [r["s"] for r in HybridEvaluation(text.format("STREAM e:g1"), log=q).historical().collect()] == [E + "b"]
    assert HybridEvaluation(text.format("STREAM e:g2"), log=q).historical().count() == 0


def test_modifiers_and_distinct_are_kept(spark):
    q = quads_of(spark, [(t, f"{E}s{t % 2}", E + "p", str(t % 3), E + "g") for t in range(12)])
    text = f"PREFIX e: <{E}> SELECT DISTINCT ?s ?o FROM NAMED WINDOW e:w ON STREAM e:g [START 0 END 99] WHERE {{ WINDOW e:w {{ ?s e:p ?o }} }} ORDER BY DESC(?o) ?s LIMIT 3"
    got = [(r["s"], r["o"]) for r in HybridEvaluation(text, log=q).historical().collect()]
    assert got == [(E + "s0", "2"), (E + "s1", "2"), (E + "s0", "1")]


def test_istream_dstream(spark):
    df = spark.createDataFrame([(0, 10, "a"), (0, 10, "b"), (10, 20, "b"), (10, 20, "c")], "ws long, we long, x string")
    assert sorted(tuple(r) for r in r2s.apply("IStream", df, 10).collect()) == [(0, 10, "a"), (0, 10, "b"), (10, 20, "c")]
    assert sorted(tuple(r) for r in r2s.apply("DStream", df, 10).collect()) == [(0, 10, "a"), (10, 20, "b"), (10, 20, "c")]
    assert r2s.apply("RStream", df, 10).count() == 4


def test_time_range_helper():
    assert WindowSpec("w", "log", "x", "fixed", start=5, end=9).time_range(0) == (5, 9)
    assert WindowSpec("w", "log", "x", "sliding", 20, 10, 100).time_range(50) == (0, 20)
    with pytest.raises(ValueError):
        WindowSpec("w", "stream", "x", "live", 20, 10).time_range(50)


def test_multi_window_join_naive(spark):
    rng = random.Random(3)
    a = [(rng.randrange(0, 60), f"{E}u{rng.randrange(3)}", E + "a", f"a{k}", "") for k in range(20)]
    b = [(rng.randrange(0, 60), f"{E}u{rng.randrange(3)}", E + "b", f"b{k}", "") for k in range(20)]
    text = f"""PREFIX e: <{E}> SELECT ?u ?x ?y FROM NAMED WINDOW e:A ON STREAM e:sa [RANGE 10 STEP 5] FROM NAMED WINDOW e:B ON STREAM e:sb [RANGE 20 STEP 10]
      WHERE {{ WINDOW e:A {{ ?u e:a ?x }} WINDOW e:B {{ ?u e:b ?y }} }}"""
    got = sorted((r["ws"], r["we"], r["u"], r["x"], r["y"]) for r in HybridEvaluation(text, streams={E + "sa": quads_of(spark, a), E + "sb": quads_of(spark, b)}).live().collect())
    want = []
    for k, (own, w, other, v) in enumerate(((a, (10, 5), b, (20, 10)), (b, (20, 10), a, (10, 5)))):
        for ws in range(-30, 70):
            if ws % w[1] or not any(ws <= t < ws + w[0] for t, *_ in own):
                continue
            t, we = max(r[0] for r in own if ws <= r[0] < ws + w[0]), ws + w[0]
            vs = (((t - v[0]) // v[1]) + 1) * v[1]
            if vs > t:
                continue
            mine = [r for r in own if ws <= r[0] < we]
            held = [r for r in other if vs <= r[0] < min(vs + v[0], we)]
            for m in mine:
                for h in held:
                    if m[1] == h[1]:
                        x, y = (m, h) if k == 0 else (h, m)
                        want.append((ws, we, m[1], x[3], y[3]))
    assert got == sorted(want)


def test_strict_logs(spark):
    """A quad with an invalid IRI fails the window that it is in, and no other."""
    q = quads_of(spark, [(1, E + "a", E + "p", "1", E + "g"), (50, "not an iri", E + "p", "1", E + "g"), (90, E + "a", E + "p", "http://x y", E + "g")])
    text = f"PREFIX e: <{E}> SELECT ?s ?o FROM NAMED WINDOW e:w ON LOG e:l [START {{}} END {{}}] WHERE {{{{ WINDOW e:w {{{{ ?s e:p ?o }}}} }}}}"
    assert HybridEvaluation(text.format(0, 9), log=q, strict=True).historical().count() == 1
    for a, b in ((0, 60), (80, 99)):
        assert HybridEvaluation(text.format(a, b), log=q).historical().count() == (2 if a == 0 else 1)
        with pytest.raises(Exception, match="invalid IRI"):
            HybridEvaluation(text.format(a, b), log=q, strict=True).historical().collect()


def test_static_quads_inside_of_windows(spark):
    """Patterns of a window that static quads match too, against plain loops; known predicates make no product."""
    rng = random.Random(8)
    live = [(rng.randrange(0, 40), f"{E}s{rng.randrange(4)}", E + rng.choice("pq"), f"{E}o{rng.randrange(4)}", "") for _ in range(40)]
    static = [(0, f"{E}s{k}", E + p, f"{E}o{rng.randrange(4, 8)}", "") for k in range(5) for p in "qr"]
    text = f"PREFIX e: <{E}> SELECT ?s ?x ?y ?z FROM NAMED WINDOW e:w ON STREAM e:st [RANGE 10 STEP 5] WHERE {{ WINDOW e:w {{ ?s e:p ?x ; e:q ?y ; e:r ?z }} }}"
    want = []
    for ws in range(-5, 45, 5):
        inside = {r[1:4] for r in live if ws <= r[0] < ws + 10}
        if inside:
            every = inside | {r[1:4] for r in static}
            want += [(ws, a[0], a[2], b[2], c[2]) for a in every for b in every for c in every if a[0] == b[0] == c[0] and (a[1], b[1], c[1]) == (E + "p", E + "q", E + "r")]
    for known in (None, frozenset({E + "q", E + "r"})):
        out = HybridEvaluation(text, streams=quads_of(spark, live), static=quads_of(spark, static), static_predicates=known).live()
        assert sorted((r["ws"], r["s"], r["x"], r["y"], r["z"]) for r in out.collect()) == sorted(want) and want
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert known is None or not any("Join Cross" in line or line.strip(" +-:").rstrip() == "Join Inner" for line in plan.split("\n"))


def test_windows_one_at_a_time(spark):
    q = sensors(spark, range(9400, 10_000, 100))
    spec = WindowSpec("w", "log", "x", "sliding", 250, 100, 600)
    got = [(ws, we, df.count()) for ws, we, df in windows.iterate(q, spec, 10_000)]
    assert got[:2] == [(9400, 9650, 3), (9500, 9750, 3)] and got[-1] == (10_000, 10_000, 0) and len(got) == 7
    assert [x[:2] for x in windows.iterate(q, WindowSpec("w", "log", "x", "fixed", start=1, end=2))] == [(1, 2)]
    with pytest.raises(ValueError):
        next(windows.iterate(q, WindowSpec("w", "stream", "x", "live", 20, 10), 5))
