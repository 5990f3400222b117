"""A thin HTTP and WebSocket front end over the engine, on the standard library."""

from __future__ import annotations

import base64
import hashlib
import json
import queue
import struct
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .api import Engine, QueryHandle, QueryResult, Status
from .errors import QuadtideError, QueryNotFound, StorageError
from .metrics import MemoryTracker
from .sources.broker import FileBroker, MqttPublisher
from .sources.log import QuadLog
from .sources.replay import Replay, ReplayConfig

#: Results that a slow subscriber may be behind; older ones are dropped and reported.
SUBSCRIBER_CAPACITY = 1024


class Fanout:
    """Sends each result of a query to every subscriber."""

    def __init__(self, handle: QueryHandle):
        self.handle, self.subscribers = handle, []
        self._lock = threading.Lock()
        threading.Thread(target=self._run, daemon=True).start()

    def _run(self) -> None:
        for r in self.handle:
            with self._lock:
                for s in self.subscribers:
                    s.put(r)
        with self._lock:
            for s in self.subscribers:
                s.end()

    def subscribe(self) -> Subscriber:
        s = Subscriber()
        with self._lock:
            self.subscribers.append(s)
            if self.handle.done.is_set():
                s.end()
        return s

    def unsubscribe(self, s: Subscriber) -> None:
        with self._lock:
            if s in self.subscribers:
                self.subscribers.remove(s)


class Subscriber:
    def __init__(self):
        self._queue: queue.Queue = queue.Queue(SUBSCRIBER_CAPACITY)
        self._missed = 0
        self._lock = threading.Lock()

    def put(self, r: QueryResult | None) -> None:
        with self._lock:
            while True:
                try:
                    self._queue.put_nowait(r)
                    return
                except queue.Full:
                    try:
                        self._queue.get_nowait()
                        self._missed += 1
                    except queue.Empty:
                        pass

    def end(self) -> None:
        self.put(None)

    def messages(self):
        """JSON texts; a "lagged" message tells how many results were dropped."""
        while True:
            r = self._queue.get()
            with self._lock:
                missed, self._missed = self._missed, 0
            if missed:
                yield json.dumps({"type": "lagged", "missed_messages": missed})
            if r is None:
                return
            yield json.dumps({"query_id": r.query_id, "timestamp": r.timestamp, "source": r.source, "bindings": r.bindings})


def websocket_accept(key: str) -> str:
    return base64.b64encode(hashlib.sha1((key + "258EAFA5-E914-47DA-95CA-C5AB0DC85B11").encode()).digest()).decode()


def text_frame(text: str) -> bytes:
    raw = text.encode()
    n = len(raw)
    if n < 126:
        head = struct.pack("!BB", 0x81, n)
    elif n < 1 << 16:
        head = struct.pack("!BBH", 0x81, 126, n)
    else:
        head = struct.pack("!BBQ", 0x81, 127, n)
    return head + raw


class HttpError(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


class Application:
    """The routes; handle() is independent of the socket server."""

    def __init__(self, engine: Engine, broker_root: str | None = None):
        self.engine, self.broker_root = engine, broker_root
        self.fanouts: dict[str, Fanout] = {}
        self.replay: Replay | None = None
        self.memory = MemoryTracker()

    def handle(self, method: str, path: str, body: dict) -> tuple[int, dict]:
        parts = [p for p in path.split("?")[0].split("/") if p]
        try:
            return self._route(method, parts, body)
        except HttpError as e:
            return e.status, {"error": str(e)}
        except QueryNotFound as e:
            return 404, {"error": str(e)}
        except QuadtideError as e:
            return 400, {"error": str(e)}
        except Exception as e:
            return 500, {"error": str(e)}

    def _route(self, method: str, parts: list[str], body: dict) -> tuple[int, dict]:
        if parts == ["health"]:
            return self.health()
        if parts == ["ops", "status"]:
            return 200, self.ops_status()
        if parts[:2] == ["api", "queries"]:
            if len(parts) == 2:
                if method == "POST":
                    return 200, self.register(body)
                if method == "GET":
                    names = self.engine.registry.list_all()
                    return 200, {"queries": names, "total": len(names)}
            if len(parts) == 3 and method == "GET":
                return 200, self.details(parts[2])
            if len(parts) == 3 and method == "DELETE":
                self.engine.delete_query(parts[2])
                self.fanouts.pop(parts[2], None)
                return 200, {"message": f"the query {parts[2]} is deleted"}
            if len(parts) == 4 and method == "POST" and parts[3] == "start":
                self.fanouts[parts[2]] = Fanout(self.engine.start_query(parts[2]))
                return 200, {"message": f"the query {parts[2]} is started"}
            if len(parts) == 4 and method == "POST" and parts[3] == "stop":
                self.engine.stop_query(parts[2])
                return 200, {"message": f"the query {parts[2]} is stopped"}
        if parts[:2] == ["api", "replay"] and len(parts) == 3:
            if method == "POST" and parts[2] == "start":
                return 200, self.start_replay(body)
            if method == "POST" and parts[2] == "stop":
                if self.replay is None or not self.replay.running:
                    raise HttpError(400, "no replay is running")
                self.replay.stop()
                return 200, {"message": "the replay is stopped"}
            if method == "GET" and parts[2] == "status":
                return 200, self.replay_status()
        raise HttpError(404, "no such route")

    def register(self, body: dict) -> dict:
        query_id = body.get("query_id")
        if not isinstance(query_id, str) or not query_id:
            raise HttpError(400, "query_id is missing")
        # the query's text may come under any name
        text = body.get("query") or next((v for k, v in body.items() if isinstance(v, str) and k not in ("query_id", "baseline_mode")), None)
        if not text:
            raise HttpError(400, "the query's text is missing")
        m = self.engine.register_query(query_id, text, str(body.get("baseline_mode") or "aggregate").lower())
        return {"query_id": m.query_id, "query_text": m.query_text, "registered_at": m.registered_at, "message": "the query is registered"}

    def details(self, query_id: str) -> dict:
        m = self.engine.registry.get(query_id)
        return {"query_id": m.query_id, "query_text": m.query_text, "baseline_mode": m.baseline_mode, "registered_at": m.registered_at, "execution_count": m.execution_count, "is_running": self.engine.is_running(query_id), "status": m.status.value}

    def results(self, query_id: str) -> tuple[Fanout, Subscriber]:
        self.engine.registry.get(query_id)
        fanout = self.fanouts.get(query_id)
        if fanout is None or not self.engine.is_running(query_id):
            raise HttpError(400, f"the query {query_id} isn't running")
        return fanout, fanout.subscribe()

    def start_replay(self, body: dict) -> dict:
        if self.replay is not None and self.replay.running:
            raise HttpError(400, "a replay is running")
        if not body.get("input_file"):
            raise HttpError(400, "input_file is missing")
        kind, broker = body.get("broker_type", "none"), None
        topics = tuple(body.get("topics") or ("default",))
        if kind == "file":
            broker = FileBroker(self.broker_root or "broker")
        elif kind == "mqtt":
            c = body.get("mqtt_config") or {}
            broker = MqttPublisher(c.get("host", "localhost"), int(c.get("port", 1883)))
        elif kind != "none":
            raise HttpError(400, f"unknown broker_type {kind!r}: none, file or mqtt")
        log = self.engine.log if isinstance(self.engine.log, QuadLog) else None
        config = ReplayConfig(body["input_file"], topics, int(body.get("rate_of_publishing", 0)), bool(body.get("loop_file", False)), bool(body.get("add_timestamps", True)))
        self.replay = Replay(config, log, broker).start()
        return {"message": "the replay is started"}

    def replay_status(self) -> dict:
        r = self.replay
        m = r.metrics if r else None
        names = ("events_read", "events_published", "events_stored", "publish_errors", "storage_errors", "events_per_second", "elapsed_seconds")
        return {"is_running": bool(r and r.running), **{n: getattr(m, n) if m else 0 for n in names}}

    def storage_status(self) -> dict:
        try:
            if isinstance(self.engine.log, QuadLog):
                self.engine.log.healthy()
        except StorageError as e:
            return {"status": "error", "background_flush_error": str(e)}
        return {"status": "ok", "background_flush_error": None}

    def health(self) -> tuple[int, dict]:
        s = self.storage_status()
        good = s["status"] == "ok"
        return (200 if good else 503), {"status": "ok" if good else "degraded", "message": "the server is running" if good else "the server is running with storage errors", "storage_status": s["status"], "storage_error": s["background_flush_error"]}

    def ops_status(self) -> dict:
        names = self.engine.registry.list_all()
        stats = self.engine.registry.statistics()
        self.memory.sample()
        return {
            "status": self.health()[1]["status"], "message": "operations", "storage": self.storage_status(), "replay": self.replay_status(), "memory": self.memory.summary(),
            "queries": {
                "total_registered_queries": len(names), "active_runtime_queries": sum(map(self.engine.is_running, names)),
                **{f"{key}_queries": stats[s.value] for key, s in (("registered", Status.REGISTERED), ("warming_baseline", Status.WARMING_BASELINE), ("running", Status.RUNNING), ("stopped", Status.STOPPED), ("failed", Status.FAILED), ("completed", Status.COMPLETED))},
            },
        }


class _Handler(BaseHTTPRequestHandler):
    app: Application
    protocol_version = "HTTP/1.1"

    def log_message(self, *args) -> None:
        pass

    def _send(self, status: int, body: dict) -> None:
        raw = json.dumps(body).encode()
        self.send_response(status)
        for k, v in (("Content-Type", "application/json"), ("Content-Length", str(len(raw))), ("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Methods", "*"), ("Access-Control-Allow-Headers", "*")):
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(raw)

    def _any(self) -> None:
        n = int(self.headers.get("Content-Length") or 0)
        raw = self.rfile.read(n) if n else b""
        try:
            body = json.loads(raw) if raw else {}
            if not isinstance(body, dict):
                raise ValueError
        except ValueError:
            self._send(400, {"error": "the body isn't a JSON object"})
            return
        parts = [p for p in self.path.split("?")[0].split("/") if p]
        if self.command == "GET" and len(parts) == 4 and parts[:2] == ["api", "queries"] and parts[3] == "results":
            self._stream(parts[2])
            return
        self._send(*self.app.handle(self.command, self.path, body))

    do_GET = do_POST = do_DELETE = _any

    def do_OPTIONS(self) -> None:
        self._send(200, {})

    def _stream(self, query_id: str) -> None:
        key = self.headers.get("Sec-WebSocket-Key")
        if not key:
            self._send(400, {"error": "results are read by WebSocket"})
            return
        try:
            fanout, mine = self.app.results(query_id)
        except HttpError as e:
            self._send(e.status, {"error": str(e)})
            return
        except QuadtideError as e:
            self._send(404, {"error": str(e)})
            return
        self.send_response(101)
        for k, v in (("Upgrade", "websocket"), ("Connection", "Upgrade"), ("Sec-WebSocket-Accept", websocket_accept(key))):
            self.send_header(k, v)
        self.end_headers()
        try:
            for message in mine.messages():
                self.wfile.write(text_frame(message))
            self.wfile.write(b"\x88\x00")
        except OSError:
            pass
        finally:
            fanout.unsubscribe(mine)
            self.close_connection = True


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8080, broker_root: str | None = None) -> ThreadingHTTPServer:
    """A server that runs in a thread of its own; shutdown() ends it."""
    app = Application(engine, broker_root)
    server = ThreadingHTTPServer((host, port), type("Handler", (_Handler,), {"app": app}))
    server.daemon_threads = True
    server.app = app
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


__all__ = ["Application", "Fanout", "Subscriber", "serve"]
