import time

import pytest
from pyspark.sql import functions as F

from quadtide.errors import QueryParseError, ReplayError, StorageError
from quadtide.model import typed
from quadtide.sources import dictionary
from quadtide.sources.broker import FileBroker, LineSource, LineStream, QueueSource, parse_broker_uri
from quadtide.sources.index import TimeIndex
from quadtide.sources.log import LogConfig, QuadLog
from quadtide.sources.nquads import bad_lines, parse_line, parse_lines, read_nquads, to_line
from quadtide.sources.replay import Replay, ReplayConfig, ReplayMetrics, bulk_load

X = "http://www.w3.org/2001/XMLSchema#"
LINES = [
    (f'<http://e/s> <http://e/p> "23.5"^^<{X}decimal> <http://e/g> .', (7, "http://e/s", "http://e/p", "23.5", "http://e/g")),
    ('<http://e/s> <http://e/p> "Temperature Sensor" .', (7, "http://e/s", "http://e/p", "Temperature Sensor", "")),
    ("<http://e/s> <http://e/p> <http://e/o> .", (7, "http://e/s", "http://e/p", "http://e/o", "")),
    ("1234567890 <http://e/s> <http://e/p> <http://e/o> <http://e/g> .", (1234567890, "http://e/s", "http://e/p", "http://e/o", "http://e/g")),
    ('<http://e/s> <http://e/p> "grüße \\"du\\" 日本"@de <http://e/g> .', (7, "http://e/s", "http://e/p", 'grüße \\"du\\" 日本', "http://e/g")),
    ('<http://e/s> <http://e/p> "" .', (7, "http://e/s", "http://e/p", "", "")),
]


@pytest.mark.parametrize("line, want", LINES)
def test_parse_line(line, want):
    assert parse_line(line, 7) == want


@pytest.mark.parametrize("line", ["<http://e/s> <http://e/p> .", "nothing", '_:b <http://e/p> "x" .', '<http://e/s> <http://e/p> "open .'])
def test_bad_line(line):
    with pytest.raises(QueryParseError):
        parse_line(line)
    assert "Invalid object format" in str(pytest.raises(QueryParseError, parse_line, "<http://e/s> <http://e/p> .").value)


def test_dataframe_parser_agrees(spark):
    good = [line for line, _ in LINES]
    df = parse_lines(spark.createDataFrame([(x,) for x in good + ["broken", "", "# note"]], "value string"), now_ms=7)
    got = {r["value"]: (r["ts_ms"], r["s"], r["p"], r["o"], r["g"]) for r in df.where("error IS NULL").collect()}
    assert got == dict(LINES) and df.where("error IS NOT NULL").count() == 1


def test_typing(spark):
    q = typed(spark.createDataFrame([(0, "http://s", "http://p", o, g) for o, g in (("5", ""), ("1e5", "default"), ("NaN", ""), ("urn:x", ""), ("https://x", ""), ("5d", ""), ("2024-01-01", None), ("true", "http://g"))], "ts_ms long, s string, p string, o string, g string"))
    got = {r["o"]: (r["o_kind"], r["g"]) for r in q.collect()}
    assert got == {"5": (1, ""), "1e5": (1, ""), "NaN": (1, ""), "urn:x": (2, ""), "https://x": (0, ""), "5d": (2, ""), "2024-01-01": (2, ""), "true": (2, "http://g")}


def test_log(spark, tmp_path):
    log = QuadLog(spark, str(tmp_path / "log"), LogConfig(bucket_ms=300))
    rows = [(i, f"http://e/s{i}", f"http://e/p{i % 2}", str(i), "http://e/g") for i in range(1000)]
    log.write_all(reversed(rows[:500]))  # out of order
    assert log.flush() == 500
    log.write_all(rows[500:])
    assert [r["ts_ms"] for r in log.scan(100, 199, ordered=True).collect()] == list(range(100, 200))
    assert log.scan(450, 550).count() == 101 and log.at(7).count() == 1 and log.scan(9, 3).count() == 0
    log.close()
    again = QuadLog(spark, str(tmp_path / "log"), LogConfig(bucket_ms=300))
    assert again.quads().count() == 1000 and again.scan(998, 2000).count() == 2
    plan = again.scan(100, 199)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1][:80]


def test_log_failure_is_sticky(spark, tmp_path, monkeypatch):
    log = QuadLog(spark, str(tmp_path / "log"), LogConfig(max_age_s=0, poll_s=0.02))
    log.write(1, "http://s", "http://p", "x")
    monkeypatch.setattr(log, "append", lambda q: (_ for _ in ()).throw(OSError("disk full")))
    with pytest.raises(StorageError):
        log.flush()
    assert len(log._buffer) == 1
    log.start_background()
    log._thread.join(timeout=10)
    for call in (lambda: log.write(2, "http://s", "http://p", "x"), log.quads, lambda: log.scan(0, 9)):
        with pytest.raises(StorageError):
            call()


def test_dictionary(spark):
    d = dictionary.Dictionary()
    assert [d.encode(t) for t in ("a", "b", "a", "c")] == [0, 1, 0, 2] and d.decode(2) == "c" and d.decode(9) is None and len(d) == 3
    rows = [(i, f"http://e/s{i}", f"http://e/p{i % 4}", f"{i}", "http://e/g") for i in range(100)]
    q = typed(spark.createDataFrame(rows, "ts_ms long, s string, p string, o string, g string"))
    terms = dictionary.build(q).cache()
    assert dictionary.size(terms) == 205
    assert sorted(r["id"] for r in terms.collect()) == list(range(205))
    assert sorted(tuple(r) for r in dictionary.decode(dictionary.encode(q, terms), terms).collect()) == sorted(rows)
    more = dictionary.build(typed(spark.createDataFrame([(0, "http://e/s1", "http://new", "z", "")], "ts_ms long, s string, p string, o string, g string")), terms)
    old = {r["term"]: r["id"] for r in terms.collect()}
    new = {r["term"]: r["id"] for r in more.collect()}
    assert all(new[t] == k for t, k in old.items()) and sorted(new.values()) == list(range(len(new)))
    lost = spark.createDataFrame([(1, 0, 999, 1, 2)], "ts_ms long, s long, p long, o long, g long")
    assert dictionary.decode(lost, terms).first()["p"] == "UNKNOWN"
    raw = dictionary.encode_record(5, 1, 2, 3, 4)
    assert len(raw) == 24 and dictionary.decode_record(raw) == (5, 1, 2, 3, 4)
    with pytest.raises(StorageError):
        dictionary.decode_record(b"x")


@pytest.mark.parametrize("uri, want", [
    ("mqtt://broker:1884/sensors/a", ("broker", 1884, "sensors/a")), ("mqtts://broker/x", ("broker", 1883, "x")), ("mqtt://broker", ("broker", 1883, "default")),
    ("http://example.org/sensorStream", ("localhost", 1883, "sensorStream")), ("http://example.org/a#b", ("localhost", 1883, "b")),
])
def test_broker_uri(uri, want):
    assert parse_broker_uri(uri) == want


def _file(tmp_path, lines):
    p = tmp_path / "in.nq"
    p.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(p)


def test_replay_stores_and_publishes(spark, tmp_path):
    lines = [f'{i} <http://e/sensor{i}> <http://e/t> "{20 + 0.1 * i:.1f}"^^<{X}decimal> <http://e/g> .' for i in range(500)]
    path = _file(tmp_path, ["# head", "", "broken line", *lines])
    log, broker = QuadLog(spark, str(tmp_path / "log")), FileBroker(str(tmp_path / "broker"))
    m = Replay(ReplayConfig(path, ("first", "second")), log, broker).run()
    assert (m.events_read, m.events_stored, m.events_published, m.storage_errors, m.publish_errors) == (500, 500, 500, 0, 0)
    assert log.quads().count() == 500 and not broker.folder("second").exists()
    assert read_nquads(spark, path).count() == 500 and bad_lines(spark, path).count() == 1
    stream = broker.subscribe(spark, "first")
    got = stream.writeStream.format("memory").queryName("replayed").trigger(availableNow=True).start()
    got.awaitTermination()
    assert spark.table("replayed").count() == 500
    other = QuadLog(spark, str(tmp_path / "log2"))
    assert bulk_load(spark, path, other).events_stored == 500 and other.quads().count() == 500
    assert to_line(other.quads()).where(F.col("value").rlike(r"^0 <http://e/sensor0> <http://e/t> \"20.0\" <http://e/g> \.$")).count() == 1


def test_replay_rate_loop_and_stop(tmp_path):
    path = _file(tmp_path, ['<http://e/s> <http://e/p> "x" .'] * 3)
    r = Replay(ReplayConfig(path, rate=50, loop=True)).start()
    assert r.running
    with pytest.raises(ReplayError):
        r.start()
    while r.metrics.events_read < 5:
        pass
    m = r.stop()
    assert not r.running and m.events_read >= 5
    with pytest.raises(ReplayError):
        Replay(ReplayConfig(str(tmp_path / "missing.nq"))).run()
    assert ReplayMetrics().events_per_second == 0 and ReplayMetrics().storage_success_percent == 0
    assert ReplayMetrics(events_stored=3, storage_errors=1).storage_success_percent == 75


def test_line_source_and_line_stream(spark, tmp_path):
    class Two(LineSource):
        def poll(self):
            self.stop()
            return ["a", ("t2", "b")]

    got = []
    Two().subscribe(["t1"], lambda t, x: got.append((t, x)), 0)
    assert got == [("t1", "a"), ("t2", "b")]
    source = QueueSource(3)
    lines = LineStream(spark, source, ["t"], arrival_time=False).start()
    for k in range(50):  # more than wait at once: put() waits for the reader
        source.put(f'{k} <http://e/s{k}> <http://e/p> "x" <http://e/g> .', "t")
    source.put("broken")
    while lines.lines < 51:
        time.sleep(0.01)
    lines.stop()
    assert lines.failure is None
    q = lines.quads().writeStream.format("memory").queryName("line_stream").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("line_stream").collect()
    assert sorted(r["ts_ms"] for r in got) == list(range(50)) and {r["g"] for r in got} == {"http://e/g"}


def test_a_late_file_of_a_topic_is_read(spark, tmp_path):
    """A publisher with a slower clock finishes after another one: nothing is skipped."""
    broker, at = FileBroker(str(tmp_path / "b")), str(tmp_path / "checkpoint")
    seen = []
    for round_, name in enumerate(("2-late.nq", "1-early-name.nq")):
        folder = broker.folder("t")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(f'{round_} <http://e/s> <http://e/p> "x" .\n')
        q = broker.subscribe(spark, "t").writeStream.option("checkpointLocation", at).foreachBatch(lambda b, _: seen.extend(r["ts_ms"] for r in b.collect())).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(seen) == [0, 1]


def test_marks_inside_of_lines(spark):
    lines = ['1 <http://e/s> <http://e/p> "a\x01b" <http://e/g> .', '2 <http://e/s> <http://e/p> "$1 \\\\ x" .', '3 <http://e/s> <http://e/p> <> .', '\x01']
    df = parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"), now_ms=7)
    got = {r["ts_ms"]: (r["o"], r["g"]) for r in df.where("error IS NULL").collect()}
    assert got == {k: (parse_line(x)[3], parse_line(x)[4]) for k, x in enumerate(lines[:3], 1)} and df.where("error IS NOT NULL").count() == 1


def test_log_compaction(spark, tmp_path):
    log = QuadLog(spark, str(tmp_path / "log"), LogConfig(bucket_ms=100))
    for part in range(5):
        log.write_all((i, "http://e/s", "http://e/p", str(part), "http://e/g") for i in range(part, 1000, 7))
        log.flush()
    before = sorted(tuple(r) for r in log.quads().collect())
    files = lambda: sum(1 for _ in (tmp_path / "log").rglob("part-*.parquet"))
    assert files() > 10 and log.compact(start_ms=0, end_ms=299) == 3 and log.compact() == 7 and files() == 10 and log.compact() == 0
    assert sorted(tuple(r) for r in log.quads().collect()) == before and log.scan(250, 349).count() == sum(250 <= r[0] <= 349 for r in before)
    # a merge that broke off before its list of old files was there, and one after
    bucket = tmp_path / "log" / "bucket=3"
    whole = next(bucket.glob("part-*.parquet")).read_bytes()
    for name, listed in (("bucket=3", False), ("bucket=3", True)):
        staged = tmp_path / "log" / "_merged" / name
        staged.mkdir(parents=True)
        (staged / "part-new.parquet").write_bytes(whole)
        if listed:
            (staged / "_old").write_text("\n".join(p.name for p in bucket.glob("part-*.parquet")))
        assert sorted(tuple(r) for r in QuadLog(spark, str(tmp_path / "log"), LogConfig(bucket_ms=100)).quads().collect()) == before
        assert not (tmp_path / "log" / "_merged").exists()


def test_scans_list_only_their_buckets(spark, tmp_path):
    log = QuadLog(spark, str(tmp_path / "log"), LogConfig(bucket_ms=10))
    log.write_all((i, "http://e/s", "http://e/p", str(i), "http://e/g") for i in range(0, 1000, 5))
    log.flush()
    assert len(log.scan(100, 119).inputFiles()) == 2 and len(log.at(505).inputFiles()) == 1 and len(log.quads().inputFiles()) == 100
    assert log.scan(100, 119).count() == 4 and log.scan(0, 999).count() == 200 and log.scan(2000, 3000).count() == 0


@pytest.mark.parametrize("every", [1, 10, 1000])
def test_time_index(spark, tmp_path, every):
    """Ranges by an index equal ranges by a plain filter; files without the range aren't opened."""
    k = F.col("id")
    rows = spark.range(5000).select(((k * 7) % 900).alias("ts_ms"), *(F.concat(F.lit(f"http://e/{c}"), (k % n).cast("string")).alias(c) for c, n in (("s", 50), ("p", 3), ("o", 40), ("g", 2))))
    typed(rows).repartitionByRange(6, "ts_ms").sortWithinPartitions("ts_ms").write.parquet(str(tmp_path / "q"))
    quads = spark.read.parquet(str(tmp_path / "q"))
    index = TimeIndex.build(quads, str(tmp_path / "i"), every)
    assert index.entries().count() <= 5000 // every + 2 * 6 and (every > 1 or index.entries().count() == 5000)
    for a, b in ((100, 120), (0, 899), (5, 5), (-9, -1), (2000, 3000), (9, 3), (890, 5000)):
        got = index.query(a, b)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, quads.where(F.col("ts_ms").between(a, b)).collect()))
        assert len(got.inputFiles()) <= (0 if b < a or a > 899 or b < 0 else 6 if b - a > 100 else 2)
    spans = {r["file"]: (r["low"], r["high"]) for r in index.spans(100, 120).collect()}
    inside = quads.where(F.col("ts_ms").between(100, 120)).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r")).collect()
    assert all(spans[r["f"]][0] <= r["r"] <= spans[r["f"]][1] for r in inside)
    with pytest.raises(StorageError):
        TimeIndex.build(quads, str(tmp_path / "z"), 0)


def test_dictionary_from_one_term(spark, tmp_path):
    """Id 0 is an id: an extended dictionary has no id twice, on disk either."""
    quad = lambda *rows: typed(spark.createDataFrame(list(rows), "ts_ms long, s string, p string, o string, g string"))
    one = quad((0, "a", "a", "a", "a"))
    dictionary.save(dictionary.build(one), str(tmp_path / "d"))
    for part in (quad((0, "a", "b", "c", "a")), quad((0, "d", "b", "c", "a")), quad((0, "d", "b", "c", "a"))):
        got = {r["term"]: r["id"] for r in dictionary.extend(spark, str(tmp_path / "d"), part).collect()}
        assert sorted(got.values()) == list(range(len(got))) and got["a"] == 0
    assert set(got) == set("abcd") and dictionary.load(spark, str(tmp_path / "d")).count() == 4
    d = dictionary.Dictionary()
    for t in ("x", "line\nbreak", "ü"):
        d.encode(t)
    d.save(str(tmp_path / "small"))
    assert dictionary.Dictionary.load(str(tmp_path / "small")).terms == d.terms


def test_windows_prune_the_log(spark, tmp_path):
    from quadtide.plans.hybrid import HybridEvaluation

    log = QuadLog(spark, str(tmp_path / "log"), LogConfig(bucket_ms=100))
    log.write_all((i, "http://e/s", "http://e/p", str(i), "http://e/g") for i in range(1000))
    log.flush()
    out = HybridEvaluation("PREFIX e: <http://e/> SELECT ?v FROM NAMED WINDOW e:w ON LOG e:l [START 250 END 349] WHERE { WINDOW e:w { ?s e:p ?v } }", log=log).historical()
    assert out.count() == 100
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1][:80]
