import base64
import json
import os
import socket
import threading
import time
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from quadtide import api
from quadtide.api import Engine, QueryRegistry, QueryResult, Status, envelope
from quadtide.errors import ExecutionError, InvalidState, QueryExists, QueryNotFound, QueryParseError, TooManyQueries
from quadtide.model import quads_of
from quadtide.plans.hybrid import HybridEvaluation
from quadtide.server import SUBSCRIBER_CAPACITY, Subscriber, serve, text_frame
from quadtide.sources.broker import FileBroker, QueueSource, file_connector, mqtt_connector
from quadtide.sources.log import QuadLog
from quadtide.streaming.live import StreamInput

E = "http://e/"
PAST = "PREFIX e: <http://e/> SELECT ?s ?v FROM NAMED WINDOW e:h ON LOG e:store [START 0 END 2000] WHERE { WINDOW e:h { ?s e:temp ?v } }"
LIVE = "PREFIX e: <http://e/> REGISTER RStream e:o AS SELECT ?s ?x FROM NAMED WINDOW e:l ON STREAM e:st [RANGE 1000 STEP 500] WHERE { WINDOW e:l { ?s e:temp ?x } }"
HYBRID = """PREFIX e: <http://e/> PREFIX b: <https://q.example/baseline#> PREFIX f: <https://q.example/fn#>
REGISTER RStream e:o AS SELECT ?s ?v ?x FROM NAMED WINDOW e:h ON LOG e:store [START 0 END 2000] FROM NAMED WINDOW e:l ON STREAM e:st [RANGE 1000 STEP 1000] USING BASELINE e:h AGGREGATE
WHERE { WINDOW e:h { ?s e:temp ?v } WINDOW e:l { ?s e:temp ?x } ?s b:v ?m . FILTER(f:absolute_threshold_exceeded(?x, ?m, 5)) }"""
ROWS = [(1000, E + "sensor1", E + "temp", "21", E + "g"), (1500, E + "sensor2", E + "temp", "22", E + "g"), (1600, E + "sensor2", E + "temp", "24", E + "g")]


def stream(spark, rows, final):
    s = StreamInput(spark, E + "st")
    s.add_all(rows)
    s.close(final)
    return s.read


def test_registry():
    r = QueryRegistry(max_queries=2)
    m = r.register("a", PAST)
    assert m.status is Status.REGISTERED and m.execution_count == 0 and r.list_all() == ["a"]
    for error, call in ((QueryExists, lambda: r.register("a", PAST)), (QueryParseError, lambda: r.register("b", "garbage")), (QueryNotFound, lambda: r.get("b")), (InvalidState, lambda: r.register("b", PAST, "sometimes"))):
        with pytest.raises(error):
            call()
    r.register("b", LIVE, "last")
    with pytest.raises(TooManyQueries):
        r.register("c", PAST)
    r.add_subscriber("a", "me")
    assert r.increment("a") == 1 and r.get("a").subscribers == ["me"]
    assert r.set_status("a", Status.RUNNING) and not r.set_status("a", Status.FAILED, only_from=(Status.STOPPED,))
    assert r.statistics()["Running"] == 1 and r.statistics()["total_executions"] == 1
    r.unregister("a")
    r.clear()
    assert r.list_all() == []


def test_history_doesnt_hold_up_the_live_part(spark, tmp_path, monkeypatch):
    log, gate = QuadLog(spark, str(tmp_path / "log")), threading.Event()
    log.write_all(ROWS)
    engine = Engine(spark, log, {E + "st": stream(spark, [(2500, E + "sensor2", E + "temp", "40", "")], 9000)})
    past = engine._historical
    monkeypatch.setattr(engine, "_historical", lambda *a: gate.wait(120) and past(*a))
    engine.register_query("q", HYBRID)
    handle = engine.start_query("q")
    first = handle.receive(120)
    assert first.source == "Live" and first.bindings[0]["x"] == "40" and engine.is_running("q")
    gate.set()
    assert {r.source for r in handle} == {"Historical"} and engine.get_query_status("q") is Status.COMPLETED


def test_brokers_feed_queries(spark, tmp_path):
    """A stream that the engine doesn't know comes from its connector: a file topic, or a source of lines."""
    broker = FileBroker(str(tmp_path / "topics"))
    broker.publish("st", [f'{t} <{E}a> <{E}temp> "{t}" .' for t in (100, 700, 9000)])
    engine = Engine(spark, connect=file_connector(spark, broker, arrival_time=False))
    engine.register_query("q", LIVE)
    assert {b["x"] for r in engine.start_query("q") for b in r.bindings} == {"100", "700"}

    class Fake(QueueSource):
        made = []

        def __init__(self, *at):
            super().__init__()
            Fake.made.append((at, self))

    connect = mqtt_connector(spark, Fake)
    engine = Engine(spark, connect=connect, live_options={"trigger": {"processingTime": "100 milliseconds"}})
    engine.register_query("m", LIVE.replace("e:st ", "<mqtt://broker:99/room> ").replace("RANGE 1000 STEP 500", "RANGE 200 STEP 200"))
    handle = engine.start_query("m")
    while not Fake.made:
        time.sleep(0.05)
    (at, source) = Fake.made[0]
    got = None
    for k in range(200):  # arrival times close windows as lines go on coming
        source.put(f'5 <{E}a> <{E}temp> "{k}" <{E}elsewhere> .')
        got = handle.receive(0.3)
        if got is not None:
            break
    engine.stop_query("m")
    for s in connect.open.values():
        s.stop()
    assert at == ("broker", 99, "room") and len(Fake.made) == 1 and got is not None and got.bindings[0]["s"] == E + "a"


def test_unread_results_hold_the_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(api, "RESULTS_WAITING", 3)
    monkeypatch.setattr(api, "RESULT_ROWS", 1)
    log = QuadLog(spark, str(tmp_path / "log"))
    log.write_all((k, f"{E}s{k}", E + "temp", str(k), E + "g") for k in range(30))
    engine = Engine(spark, log)
    engine.register_query("q", PAST)
    handle = engine.start_query("q")
    while handle._results.qsize() < 3:
        time.sleep(0.05)
    assert engine.is_running("q") and len(list(handle)) == 30
    engine.register_query("again", PAST)
    engine.start_query("again")
    engine.stop_query("again")  # a query that waits for its reader can be stopped
    assert engine.get_query_status("again") is Status.STOPPED


def test_historical_query(spark, tmp_path):
    log = QuadLog(spark, str(tmp_path / "log"))
    log.write_all(ROWS)
    engine = Engine(spark, log)
    engine.register_query("q", PAST)
    handle = engine.start_query("q")
    results = list(handle)
    assert len(results) == 1 and results[0].source == "Historical" and results[0].timestamp == 2000
    assert sorted(b["s"] + b["v"] for b in results[0].bindings)[0] == f'<{E}sensor1>"21"^^<http://www.w3.org/2001/XMLSchema#decimal>'
    assert engine.get_query_status("q") is Status.COMPLETED and not engine.is_running("q")
    assert engine.registry.get("q").execution_count == 1
    with pytest.raises(QueryNotFound):
        engine.start_query("none")
    with pytest.raises(InvalidState):
        engine.stop_query("q")
    engine.register_query("empty", PAST.replace("e:temp", "e:none"))
    assert [(r.timestamp, r.bindings) for r in engine.start_query("empty")] == [(2000, [])]
    engine.register_query("sliding", PAST.replace("[START 0 END 2000]", "[OFFSET 1000 RANGE 300 STEP 500]"))
    got = {r.timestamp: len(r.bindings) for r in engine.start_query("sliding", now_ms=2000)}
    assert got == {1300: 1, 1800: 2, 2000: 0}
    engine.delete_query("q")
    assert engine.registry.list_all() == ["empty", "sliding"]


def test_live_and_hybrid(spark):
    log = quads_of(spark, ROWS)
    live = [(100, E + "sensor1", E + "temp", "22", ""), (200, E + "sensor2", E + "temp", "40", ""), (300, E + "other", E + "temp", "90", "")]
    engine = Engine(spark, log, {E + "st": stream(spark, live, 5000)})
    engine.register_query("l", LIVE)
    got = list(engine.start_query("l"))
    assert {r.source for r in got} == {"Live"} and len(got) == 6 and all(set(r.bindings[0]) == {"s", "x"} for r in got)
    assert engine.get_query_status("l") is Status.COMPLETED
    engine.register_query("h", HYBRID)
    got = list(engine.start_query("h"))
    assert sorted({r.source for r in got}) == ["Historical", "Live"]
    assert [r.bindings[0] for r in got if r.source == "Live"] == [{"s": E + "sensor2", "x": "40"}]
    engine.register_query("no stream", LIVE.replace("e:st", "e:elsewhere"))
    with pytest.raises(ExecutionError):
        engine.start_query("no stream")


def test_stop_while_running(spark):
    s = StreamInput(spark, E + "st")
    engine = Engine(spark, None, {E + "st": s.read}, live_options={"trigger": {"processingTime": "200 milliseconds"}})
    engine.register_query("l", LIVE)
    handle = engine.start_query("l")
    s.add_all([(100, E + "a", E + "temp", "1", "")])
    s.add_all([(9000, E + "b", E + "temp", "2", "")])
    first = handle.receive(timeout=60)
    assert isinstance(first, QueryResult) and first.bindings[0]["s"] == E + "a"
    assert engine.is_running("l")
    for call in (lambda: engine.start_query("l"), lambda: engine.delete_query("l")):
        with pytest.raises(InvalidState):
            call()
    engine.stop_query("l")
    assert engine.get_query_status("l") is Status.STOPPED and not engine.is_running("l")
    assert handle.receive(timeout=5) is None or True
    engine.close()


def test_failure_is_reported(spark, monkeypatch):
    engine = Engine(spark, quads_of(spark, ROWS))
    engine.register_query("q", PAST)
    monkeypatch.setattr(HybridEvaluation, "historical", lambda *a: (_ for _ in ()).throw(RuntimeError("broken")))
    assert list(engine.start_query("q")) == []
    assert engine.get_query_status("q") is Status.FAILED and "broken" in engine.registry.get("q").error


def test_envelope(spark):
    out = HybridEvaluation(PAST, log=quads_of(spark, ROWS)).historical()
    (r,) = envelope(out, "q", "Historical").collect()
    assert (r["query_id"], r["timestamp"], r["source"], len(r["bindings"])) == ("q", 2000, "Historical", 3)
    assert r["bindings"][0].keys() == {"s", "v"} and F is not None


def test_slow_subscriber_is_told():
    s = Subscriber()
    for k in range(SUBSCRIBER_CAPACITY + 5):
        s.put(QueryResult("q", k, "Live", []))
    s.end()
    messages = [json.loads(m) for m in s.messages()]
    assert messages[0] == {"type": "lagged", "missed_messages": 6} and messages[1]["timestamp"] == 6


def test_frames():
    assert text_frame("hi") == b"\x81\x02hi" and text_frame("x" * 200)[:4] == b"\x81\x7e\x00\xc8" and text_frame("x" * 70000)[1] == 127


@pytest.fixture(scope="module")
def server(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("server")
    log = QuadLog(spark, str(root / "log"))
    log.write_all(ROWS)
    s = StreamInput(spark, E + "st")
    engine = Engine(spark, log, {E + "st": s.read}, live_options={"trigger": {"processingTime": "200 milliseconds"}})
    server = serve(engine, port=0, broker_root=str(root / "broker"))
    server.stream, server.engine, server.root = s, engine, root
    yield server
    engine.close()
    server.shutdown()


def call(server, method, path, body=None):
    request = urllib.request.Request(f"http://127.0.0.1:{server.server_address[1]}{path}", method=method, data=None if body is None else json.dumps(body).encode())
    try:
        with urllib.request.urlopen(request, timeout=60) as r:
            return r.status, json.loads(r.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def websocket(server, query_id):
    s = socket.create_connection(("127.0.0.1", server.server_address[1]), timeout=60)
    key = base64.b64encode(os.urandom(16)).decode()
    s.sendall(f"GET /api/queries/{query_id}/results HTTP/1.1\r\nHost: x\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: {key}\r\nSec-WebSocket-Version: 13\r\n\r\n".encode())
    f = s.makefile("rb")
    status = f.readline()
    while f.readline() not in (b"\r\n", b""):
        pass
    return status, f


def message(f):
    head = f.read(2)
    n = head[1] & 127
    if n == 126:
        n = int.from_bytes(f.read(2), "big")
    return json.loads(f.read(n))


def test_http_life_cycle(server):
    assert call(server, "GET", "/health")[0] == 200
    status, body = call(server, "POST", "/api/queries", {"query_id": "l", "text_of_it": LIVE, "baseline_mode": "Last"})
    assert status == 200 and body["query_id"] == "l" and body["query_text"] == LIVE
    assert call(server, "POST", "/api/queries", {"query_id": "l", "query": LIVE})[0] == 400
    assert call(server, "POST", "/api/queries", {"query_id": "x", "query": "garbage"})[0] == 400
    assert call(server, "POST", "/api/queries", {"query_id": "x", "query": LIVE, "baseline_mode": "odd"})[0] == 400
    assert call(server, "POST", "/api/queries", {"query": LIVE})[0] == 400
    assert call(server, "GET", "/api/queries")[1] == {"queries": ["l"], "total": 1}
    assert call(server, "GET", "/api/queries/none")[0] == 404 and call(server, "GET", "/nowhere")[0] == 404
    details = call(server, "GET", "/api/queries/l")[1]
    assert details["status"] == "Registered" and details["baseline_mode"] == "last" and not details["is_running"]
    assert b"400" in websocket(server, "l")[0] and b"404" in websocket(server, "none")[0]
    assert call(server, "POST", "/api/queries/l/start")[0] == 200
    assert call(server, "POST", "/api/queries/l/start")[0] == 400
    assert call(server, "DELETE", "/api/queries/l")[0] == 400
    (s1, one), (s2, two) = websocket(server, "l"), websocket(server, "l")
    assert b"101" in s1 and b"101" in s2
    server.stream.add_all([(100, E + "a", E + "temp", "1", "")])
    server.stream.add_all([(9000, E + "b", E + "temp", "2", "")])
    for f in (one, two):
        m = message(f)
        assert m["source"] == "Live" and m["bindings"][0]["s"] == E + "a"
    ops = call(server, "GET", "/ops/status")[1]
    assert ops["queries"]["running_queries"] == 1 and ops["queries"]["active_runtime_queries"] == 1 and ops["memory"]["peak"] > 0
    assert call(server, "POST", "/api/queries/l/stop")[0] == 200
    assert call(server, "GET", "/api/queries/l")[1]["status"] == "Stopped"
    assert call(server, "DELETE", "/api/queries/l")[0] == 200 and call(server, "GET", "/api/queries")[1]["total"] == 0


def test_http_replay(server):
    path = server.root / "in.nq"
    path.write_text("\n".join(f'{k} <http://e/s{k}> <http://e/p> "{k}" .' for k in range(50)) + "\n")
    assert call(server, "POST", "/api/replay/stop")[0] == 400
    assert call(server, "POST", "/api/replay/start", {})[0] == 400
    assert call(server, "POST", "/api/replay/start", {"input_file": str(path), "broker_type": "pigeon"})[0] == 400
    assert call(server, "POST", "/api/replay/start", {"input_file": str(path), "broker_type": "file", "topics": ["t"], "loop_file": False})[0] == 200
    for _ in range(100):
        status = call(server, "GET", "/api/replay/status")[1]
        if not status["is_running"]:
            break
        time.sleep(0.1)
    assert status["events_read"] == status["events_published"] == status["events_stored"] == 50
    server.engine.log._failure = OSError("disk full")
    assert call(server, "GET", "/health")[0] == 503
    server.engine.log._failure = None


def test_command_line(spark, tmp_path, capsys):
    from quadtide import cli

    path = tmp_path / "in.nq"
    path.write_text("\n".join(f'{1000 + k} <http://e/s{k}> <http://e/temp> "{k}" <http://e/g> .' for k in range(20)) + "\nbad\n")
    assert cli.main(["replay", "--input", str(path), "--storage-path", str(tmp_path / "log")]) == 0
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1])["events_stored"] == 20
    assert cli.main(["info", "--storage-path", str(tmp_path / "log")]) == 0
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1])["quads"] == 20
    (tmp_path / "q").write_text(PAST)
    assert cli.main(["query", "--file", str(tmp_path / "q"), "--storage-path", str(tmp_path / "log")]) == 0
    assert len(capsys.readouterr().out.strip().split("\n")) == 20
    with pytest.raises(SystemExit):
        cli.main(["replay"])
