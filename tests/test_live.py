import random
import time

import pytest

from quadtide.errors import LiveError
from quadtide.model import IRI, STRING, quads_of, typed
from quadtide.plans.hybrid import HybridEvaluation
from quadtide.streaming.live import LiveProcessor, LiveQuery, StreamInput, closed_windows

E = "http://e/"
TEXT = "PREFIX e: <http://e/> PREFIX f: <http://x/fn#> REGISTER RStream e:o AS SELECT {items} FROM NAMED WINDOW e:w ON STREAM e:st [RANGE {r} STEP {s}] WHERE {{ WINDOW e:w {{ {body} }} {rest} }}"


def run(spark, text, rows, final, **options):
    p = LiveProcessor(spark, text, **options)
    p.register_stream(E + "st")
    for r in rows:
        p.add_event(E + "st", *r)
    p.close_stream(E + "st", final)
    live = p.start()
    live.await_end()
    return live.collect_results()


@pytest.mark.parametrize("n, gap, width, step, final", [(11, 100, 1000, 300, 3000), (15, 200, 2000, 500, 5000), (50, 20, 500, 100, 2000), (20, 50, 100, 250, 3000)])
def test_streaming_equals_batch(spark, n, gap, width, step, final):
    rows = [(gap * i, f"{E}s{i % 3}", E + "reading", str(20 + i % 10), "") for i in range(n)]
    text = TEXT.format(items="?s ?v", r=width, s=step, body="?s e:reading ?v", rest="")
    got = sorted((r["ws"], r["we"], r["ts"], r["s"], r["v"]) for r in run(spark, text, rows, final))
    want = sorted((r["ws"], r["we"], r["ts"], r["s"], r["v"]) for r in HybridEvaluation(text, streams=quads_of(spark, rows)).live().collect() if r["we"] <= final)
    assert got == want and len(got) >= 3
    last = {}
    for t, *_ in rows:
        for r in got:
            if r[0] <= t < r[1]:
                last[r[0]] = max(last.get(r[0], t), t)
    assert all(r[2] == last[r[0]] + width for r in got)


SEVERAL = """PREFIX e: <http://e/> REGISTER {op} e:o AS SELECT {items} FROM NAMED WINDOW e:a ON STREAM e:sa [RANGE {a[0]} STEP {a[1]}]
  FROM NAMED WINDOW e:b ON STREAM e:sb [RANGE {b[0]} STEP {b[1]}] WHERE {{ {body} }}"""
BOTH = "WINDOW e:a { ?u e:a ?x } WINDOW e:b { ?u e:b ?y }"
EITHER = "{ WINDOW e:a { ?u e:a ?x } } UNION { WINDOW e:b { ?u e:b ?y } }"


def run_several(spark, text, streams, final, files=3, **options):
    """The streams cut into so many files, in order, and read one file a micro-batch."""
    inputs = {}
    for uri, rows in streams.items():
        inputs[uri] = StreamInput(spark, uri)
        rows = sorted(rows)
        for k in range(files):
            inputs[uri].add_all(rows[len(rows) * k // files: len(rows) * (k + 1) // files])
            time.sleep(0.01)
        inputs[uri].close(final)
    live = LiveQuery(text, {u: i.read(max_files=1) for u, i in inputs.items()}, **options).start()
    live.await_end()
    return live.collect_results()


def naive_several(streams, specs, final):
    """(by, ws, we, contents of each window) of every firing, by plain loops."""
    out = []
    for by, ((width, step), own) in enumerate(zip(specs, streams)):
        for ws in range(-(max(s[0] for s in specs) // step + 1) * step, final + 1, step):
            we, inside = ws + width, [r for r in own if ws <= r[0] < ws + width]
            if not inside or we > final:
                continue
            t, held = max(r[0] for r in inside), []
            for k, ((w, s), rows) in enumerate(zip(specs, streams)):
                if k == by:
                    held.append({r[1:4] for r in inside})
                    continue
                starts = [x for x in range(-(w // s + 1) * s, final + 1, s) if x <= t < x + w]
                held.append({r[1:4] for r in rows if starts and starts[0] <= r[0] < min(starts[0] + w, we)})
            out.append((by, ws, we, t, held))
    return out


@pytest.mark.parametrize("a, b", [((1000, 1000), (1000, 1000)), ((1000, 1000), (2000, 1000)), ((400, 300), (1000, 700)), ((200, 500), (900, 300))])
def test_several_windows_on_a_stream_and_replayed(spark, a, b):
    """Aligned windows meet, and a stream gives what its replay and plain loops give."""
    rng = random.Random(a[0] + b[0])
    streams = {E + "sa": [(rng.randrange(0, 4000), f"{E}u{rng.randrange(3)}", E + "a", f"a{k % 9}", "") for k in range(24)],
               E + "sb": [(rng.randrange(0, 4000), f"{E}u{rng.randrange(3)}", E + "b", f"b{k % 9}", "") for k in range(24)]}
    final = 6000
    firings = naive_several(list(streams.values()), (a, b), final)
    for body, each in ((BOTH, lambda x, y: [(m[0], m[2], n[2]) for m in x for n in y if m[0] == n[0]]), (EITHER, lambda x, y: [(m[0], m[2], None) for m in x] + [(n[0], None, n[2]) for n in y])):
        text = SEVERAL.format(op="RStream", items="?u ?x ?y", a=a, b=b, body=body)
        want = sorted(((ws, we, t + (a, b)[by][0], *r) for by, ws, we, t, (x, y) in firings for r in each(x, y)), key=str)
        replay = sorted(((r["ws"], r["we"], r["ts"], r["u"], r["x"], r["y"]) for r in HybridEvaluation(text, streams={u: quads_of(spark, r) for u, r in streams.items()}).live().collect()), key=str)
        assert replay == want and want
        got = sorted(((r["ws"], r["we"], r["ts"], r["u"], r["x"], r["y"]) for r in run_several(spark, text, streams, final)), key=str)
        assert got == want


@pytest.mark.parametrize("operator", ["IStream", "DStream"])
def test_changes_on_a_stream(spark, operator):
    rng = random.Random(5)
    rows = [(rng.randrange(0, 5000), f"{E}s{rng.randrange(4)}", E + "reading", str(rng.randrange(3)), "") for _ in range(40)] + [(9000, E + "s9", E + "reading", "1", "")]
    text = TEXT.replace("RStream", operator).format(items="DISTINCT ?s ?v", r=1000, s=500, body="?s e:reading ?v", rest="")
    final = 12000
    got = sorted((r["ws"], r["we"], r["s"], r["v"]) for r in run_several(spark, text, {E + "st": rows}, final, files=6))
    want = [(r["ws"], r["we"], r["s"], r["v"]) for r in HybridEvaluation(text, streams=quads_of(spark, rows)).live().collect()]
    if operator == "DStream":  # of the last window nothing is known to be lost
        want = [r for r in want if r[0] < 9000]
    assert got == sorted(want) and len(got) > 5


def test_state_is_a_row_for_each_quad(spark):
    """No aggregate gathers a window's quads in one value."""
    live = LiveProcessor(spark, TEXT.format(items="?s ?v", r=1000, s=500, body="?s e:reading ?v", rest=""))
    stream = live.register_stream(E + "st").read()
    plan = closed_windows([(live.query.live_windows[0], stream, None)])._jdf.queryExecution().analyzed().toString()
    assert "collect_" not in plan and plan.count("Aggregate") == 1


@pytest.mark.parametrize("operator", ["RStream", "IStream"])
def test_content_is_written_once(spark, operator):
    """Without a state store, and a quad of 20 windows is one row of the kept content, not 20."""
    text = TEXT.replace("RStream", operator).format(items="DISTINCT ?s ?v", r=1000, s=50, body="?s e:reading ?v", rest="")
    rows = [(10 * k, f"{E}s{k % 5}", E + "reading", str(k % 7), "") for k in range(100)]
    stream = StreamInput(spark, E + "st")
    stream.add_all(rows)
    stream.close(990)
    live = LiveQuery(text, {E + "st": stream.read()}).start()
    live.await_end()
    want = [(r["ws"], r["s"], r["v"]) for r in HybridEvaluation(text, streams=quads_of(spark, rows)).live().collect() if r["we"] <= 990]
    assert sorted((r["ws"], r["s"], r["v"]) for r in live.collect_results()) == sorted(want) and want
    assert all(not p.stateOperators for p in live.running[0].recentProgress)
    assert sum(p["rows"] for p in live.mark["parts"]) == len(rows) + 1


@pytest.mark.parametrize("operator", ["RStream", "IStream"])
def test_goes_on_from_its_checkpoint(spark, tmp_path, operator, monkeypatch):
    """A query that fails at a window and is started again, its parts merged and dropped on the way; of quads
    that come late those of closed windows count no more."""
    from quadtide.streaming import live as module

    monkeypatch.setattr(module, "MOST_PARTS", 2)
    text = TEXT.replace("RStream", operator).format(items="DISTINCT ?s ?v", r=1000, s=500, body="?s e:reading ?v", rest="")
    rows = [(100 * k, f"{E}s{k % 3}", E + "reading", str(k % 4), "") for k in range(60)]
    late = (10, E + "late", E + "reading", "9", ""), (5700, E + "late", E + "reading", "8", "")
    stream, got, left = StreamInput(spark, E + "st"), [], [3]

    def take(out):
        found = [(r["ws"], r["s"], r["v"]) for r in out.collect()]
        left[0] -= 1
        if not left[0]:
            raise ValueError("lost")
        got.extend(found)

    for k in range(0, 60, 5):
        stream.add_all(rows[k:k + 5])
        time.sleep(0.01)
    run = lambda: LiveQuery(text, {E + "st": stream.read(max_files=1)}, on_result=take, checkpoint=str(tmp_path)).start()
    with pytest.raises(Exception, match="lost"):
        run().await_end()
    run().await_end()
    stream.add_all(late)
    time.sleep(0.01)
    stream.close(9000)
    q = run()
    q.await_end()
    want = HybridEvaluation(text, streams=quads_of(spark, [*rows, late[1]])).live().collect()
    assert sorted(got) == sorted((r["ws"], r["s"], r["v"]) for r in want) and len(got) > 20
    assert len(q.mark["parts"]) <= 2


@pytest.mark.parametrize("most, again, made_sets", [(100, 0, 0), (100, 7, 7), (3, 7, 107)])
def test_only_repeated_quads_are_made_a_set(spark, monkeypatch, most, again, made_sets):
    from quadtide.operators import windows
    from quadtide.streaming import live

    seen, as_set = [], windows.as_set
    monkeypatch.setattr(live, "LOOK_ROWS", 0)
    monkeypatch.setattr(live, "MOST_REPEATS", most)
    monkeypatch.setattr(windows, "as_set", lambda quads, *keys: seen.append(quads.select("s").distinct().count()) or as_set(quads, *keys))
    rows = [(100 * k, f"{E}s{k}", p, str(k % 7), "") for k in range(100) for p in (E + "a", E + "b")]
    rows += [(100 * k + d, f"{E}s{k}", E + "a", str(k % 7), "") for k in range(again) for d in (0, 450, 1900)]
    rows.sort()
    text = TEXT.format(items="?x (COUNT(?s) AS ?n)", r=2000, s=500, body="?s e:a ?x ; e:b ?y", rest="") + " GROUP BY ?x"
    got = sorted((r["we"], r["x"], r["n"]) for r in run(spark, text, rows, 12000))
    monkeypatch.setattr(windows, "as_set", as_set)
    want = sorted((r["we"], r["x"], r["n"]) for r in HybridEvaluation(text, streams=quads_of(spark, rows)).live().collect() if r["we"] <= 12000)
    assert got == want and len(got) > 100
    assert sum(seen) == min(made_sets, 100)


def test_lateness(spark):
    """Windows close so much later, and what comes in between still counts."""
    stream, e = StreamInput(spark, E + "st"), lambda t, v: [(t, E + "s", E + "reading", v, "")]
    for rows in (e(500, "1"), e(1900, "2"), e(600, "3"), e(2100, "4"), e(700, "5"), e(2999, "6")):
        stream.add_all(rows)
        time.sleep(0.01)
    live = LiveQuery(TEXT.format(items="?v", r=1000, s=1000, body="?s e:reading ?v", rest=""), {E + "st": stream.read(max_files=1)}, lateness="1 second").start()
    live.await_end()
    assert sorted((r["ws"], r["v"]) for r in live.collect_results()) == [(0, "1"), (0, "3")]


def test_closed_windows(spark):
    """The state store's stream of closed windows has the windows' quads."""
    live = LiveProcessor(spark, TEXT.format(items="?s ?v", r=1000, s=500, body="?s e:reading ?v", rest=""))
    stream = live.register_stream(E + "st")
    rows = [(100 * k, f"{E}s{k % 3}", E + "reading", str(k % 4), "") for k in range(30)]
    stream.add_all(rows)
    stream.close(2900)
    found = closed_windows([(live.query.live_windows[0], stream.read(), None)])
    found.writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {(r["ws"], r["we"], r["s"], r["o"]) for r in spark.table("closed").select("ws", "we", "quad.*").collect()}
    assert got == {(ws, ws + 1000, s, o) for t, s, _, o, _ in rows for ws in range(-500, 1901, 500) if ws <= t < ws + 1000}


def test_function_and_static(spark):
    text = TEXT.format(items="?s ?m", r=1000, s=500, body="?s e:reading ?v", rest="?s e:mean ?m . FILTER(f:absolute_threshold_exceeded(?v, ?m, 2))")
    p = LiveProcessor(spark, text)
    p.register_stream(E + "st")
    p.add_static(E + "s1", E + "mean", "25")
    p.add_static(E + "s2", E + "mean", "29")
    p.add_events(E + "st", [(0, E + "s1", E + "reading", "30", ""), (7, E + "s2", E + "reading", "30", "")])
    p.close_stream(E + "st", 3000)
    live = p.start()
    live.await_end()
    got = live.collect_results()
    assert got and {(r["s"], r["m"]) for r in got} == {(E + "s1", "25")}
    assert {r["ts"] for r in got} == {1000}  # the batch has the first event's time


def test_join_inside_a_window(spark):
    rows = [(100, E + "a", E + "reading", "1", ""), (200, E + "a", E + "room", E + "r1", ""), (300, E + "b", E + "reading", "2", ""), (300, E + "b", E + "noise", "9", "")]
    text = TEXT.format(items="?s ?r (COUNT(?v) AS ?n)", r=1000, s=1000, body="?s e:reading ?v ; e:room ?r", rest="") + " GROUP BY ?s ?r"
    got = run(spark, text, rows, 5000)
    assert [(r["s"], r["r"], r["n"]) for r in got] == [(E + "a", E + "r1", "1")]


def test_errors(spark):
    p = LiveProcessor(spark, TEXT.format(items="?s", r=10, s=10, body="?s ?p ?o", rest=""))
    with pytest.raises(LiveError):
        p.register_stream("http://e/other")
    with pytest.raises(LiveError):
        p.add_event(E + "st", 1, "http://s", "http://p", "x")
    p.register_stream(E + "st")
    with pytest.raises(LiveError):
        p.add_event(E + "st", 2**63, "http://s", "http://p", "x")
    for bad in ((1, "no iri", "http://p", "x"), (1, "http://s", "p", "x"), (1, "http://s", "http://p", "x", "http://a b")):
        with pytest.raises(LiveError):
            p.add_event(E + "st", *bad)
    p.add_event(E + "st", 1, "urn:s", "http://p", "http://not an iri")
    (r,) = spark.read.schema("ts_ms long, s string, p string, o string, g string").json(p.inputs[E + "st"].folder).where("o != ''").collect()
    assert typed(spark.createDataFrame([r]), live=True).first()["o_kind"] == STRING and typed(spark.createDataFrame([r])).first()["o_kind"] == IRI
    p.close_stream(E + "st", 5)
    with pytest.raises(LiveError):
        p.add_event(E + "st", 6, "http://s", "http://p", "x")
    with pytest.raises(LiveError):
        LiveProcessor(spark, "PREFIX e: <http://e/> SELECT ?s FROM NAMED WINDOW e:h ON LOG e:g [START 0 END 9] WHERE { WINDOW e:h { ?s ?p ?o } }")


def test_comparator_stream_equals_batch(spark, tmp_path):
    import json
    import os

    from quadtide.operators.comparator import EVENTS, Comparator
    from quadtide.streaming.comparator import compare_stream

    rng = random.Random(2)
    points = [(k, float(t), rng.gauss(10, 3), rng.gauss(10, 1)) for t in range(30) for k in ("x", "y")]
    for part in range(3):
        (tmp_path / f"{part}.json").write_text("\n".join(json.dumps(dict(zip(("k", "ts", "live", "hist"), p))) for p in points[part * 20:part * 20 + 20]))
        os.utime(tmp_path / f"{part}.json", (1000 + part, 1000 + part))  # files are read oldest first
    stream = spark.readStream.schema("k string, ts double, live double, hist double").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    q = compare_stream(stream, "k").writeStream.format("memory").queryName("compared").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["k"], r["ts"], r["position"]) for r in spark.table("compared").collect())
    cs, want = {"x": Comparator(), "y": Comparator()}, []
    for k, t, a, b in points:
        want += [(k, t, EVENTS.index(e) + 1) for e, *_ in cs[k].update(t, a, b)]
    assert got == sorted(want) and want
