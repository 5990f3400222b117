"""The registered queries of the engine: (spark, sf_dir) -> DataFrame, and DuckDB SQL for each.

Tables of the test data are seen as quads: every event is a subject with a user, a type and a value
in the graph .../events; the reading form says that a user had a reading, in .../readings; nations,
regions and customers are background quads of the default graph.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import anomaly
from .model import DECIMAL, IRI, STRING, mean, number_text
from .operators import baseline as baselines
from .operators import comparator, windows
from .plans.compiler import Dataset, Plan, Rel, Wide
from .plans.hybrid import HybridEvaluation
from .plans.parser import parse_sparql

EX = "http://ex.org/"
T0, HOUR, DAY = 1704067200000, 3_600_000, 86_400_000
NOW = T0 + 20 * DAY
PREFIX = f"PREFIX ex: <{EX}>\nPREFIX fn: <{anomaly.NAMESPACE}>\nPREFIX base: <{baselines.NAMESPACE}>\n"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql.replace(", 6)", " + 1e-9, 6)")  # a half rounds alike in both engines
        return f

    return keep


# --- the tables as quads ---------------------------------------------------------------------------

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ms(table(spark, sf_dir, "events"))


def with_ms(e: DataFrame) -> DataFrame:
    # times without a zone are UTC, whatever the session's zone
    ms = F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col("ts").cast("timestamp_ntz"))
    return e.select(ms.cast("long").alias("ts_ms"), "event_id", "user_id", "event_type", "value")


def _iri(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{EX}{kind}/"), F.col(key).cast("string"))


def event_table(spark: SparkSession, sf_dir: str) -> Wide:
    return as_wide(events(spark, sf_dir))


def as_wide(e: DataFrame) -> Wide:
    wide = e.select("ts_ms", _iri("event", "event_id").alias("event"), _iri("user", "user_id").alias("user"), F.col("event_type").alias("type"), F.col("value").alias("number"))
    return Wide(wide, "event", {f"{EX}user": ("user", IRI, None), f"{EX}type": ("type", STRING, None), f"{EX}value": ("number", DECIMAL, "number")}, f"{EX}events")


def as_quads(raw: DataFrame) -> DataFrame:
    """Rows of events, also streaming ones, as quads."""
    return as_wide(with_ms(raw)).quads()


def event_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_table(spark, sf_dir).quads()


def reading_table(spark: SparkSession, sf_dir: str, where: str | None = None) -> DataFrame:
    """(ts_ms, s, p, o, g, o_kind, o_num): a user's readings, plain quads that may repeat."""
    e = events(spark, sf_dir)
    if where:
        e = e.where(where)
    return e.select("ts_ms", _iri("user", "user_id").alias("s"), F.lit(f"{EX}reading").alias("p"), F.col("value").cast("string").alias("o"), F.lit(f"{EX}readings").alias("g"), F.lit(DECIMAL).cast("tinyint").alias("o_kind"), F.col("value").alias("o_num"))


def background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, regions, customers and who referred whom (customer k was referred by k div 2)."""
    def facts(df: DataFrame, subject: Column, *pairs: tuple[str, Column, int, Column | None]) -> DataFrame:
        cells = [F.struct(F.lit(EX + p).alias("p"), o.cast("string").alias("o"), F.lit(k).cast("tinyint").alias("o_kind"), (n if n is not None else F.lit(None)).cast("double").alias("o_num")) for p, o, k, n in pairs]
        return df.select(subject.alias("s"), F.explode(F.array(*cells)).alias("c")).select(F.lit(0).cast("long").alias("ts_ms"), "s", "c.p", "c.o", F.lit("").alias("g"), "c.o_kind", "c.o_num").where("o IS NOT NULL")

    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    out = facts(r, _iri("region", "r_regionkey"), ("name", F.col("r_name"), STRING, None))
    out = out.unionByName(facts(n, _iri("nation", "n_nationkey"), ("name", F.col("n_name"), STRING, None), ("partOf", _iri("region", "n_regionkey"), IRI, None)))
    up = F.when(F.col("c_custkey") >= 2, F.concat(F.lit(f"{EX}customer/"), F.floor(F.col("c_custkey") / 2).cast("string")))
    balance = F.col("c_acctbal")
    return out.unionByName(facts(c, _iri("customer", "c_custkey"), ("inNation", _iri("nation", "c_nationkey"), IRI, None), ("segment", F.col("c_mktsegment"), STRING, None), ("balance", number_text(balance), DECIMAL, balance), ("referredBy", up, IRI, None)))


FUNCTIONAL = frozenset(EX + p for p in ("name", "partOf", "inNation", "segment", "balance", "referredBy"))


# --- evaluation helpers ------------------------------------------------------------------------------

def rounded(n: Column) -> Column:
    """To 6 places; the nudge makes halves that sums leave inexact go the same way everywhere."""
    return F.round(n + 1e-9, 6)


def shaped(rel: Rel, **out: str) -> DataFrame:
    """Chosen variables: "lex" texts, "num" numbers rounded to 6 places, "int" whole numbers; keys stay."""
    cols = [F.col(k) for k in rel.keys if k in ("ws", "we")]
    for name, how in out.items():
        v = rel.value(name)
        cols.append({"lex": v.lex, "num": rounded(v.number), "int": v.number.cast("long")}[how].alias(name))
    return rel.df.select(*cols)


def sparql(quads: DataFrame | Dataset, text: str, **out: str) -> DataFrame:
    data = quads if isinstance(quads, Dataset) else Dataset(quads, functional=FUNCTIONAL)
    return shaped(Plan(data, now_ms=NOW).select(parse_sparql(PREFIX + text)), **out)


def historical(log, text: str, **out: str) -> DataFrame:
    h = HybridEvaluation(PREFIX + text, log=log, now_ms=NOW)
    window, select = h.split.historical[0]
    return shaped(h.historical_rel(window, select), **out)


def live(streams, text: str, log=None, static: DataFrame | None = None, **out: str) -> DataFrame:
    h = HybridEvaluation(PREFIX + text, log=log, streams=streams, static=static, now_ms=NOW)
    rel = h.live_rel()
    return shaped(rel, **out)


#: Common table expressions of the oracles.
EV = f"ev AS (SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, user_id, event_type, value, '{EX}event/' || event_id AS e, '{EX}user/' || user_id AS u FROM events)"
LIVE = lambda width, step: f"w AS (SELECT ev.*, k * {step} AS ws, k * {step} + {width} AS we FROM ev, unnest(range(CAST(floor((ts_ms - {width}) / {step}) AS BIGINT) + 1, ts_ms // {step} + 1)) AS t(k))"


def past(width: int, step: int, offset: int) -> str:
    first = NOW - offset
    return (f"k AS (SELECT {first} + i * {step} AS ws, least({first} + i * {step} + {width}, {NOW}) AS we FROM range(0, {offset // step + 1}) AS t(i)), "
            f"w AS (SELECT ev.*, ws, we FROM ev JOIN k ON ts_ms BETWEEN ws AND we)")


# --- scans -------------------------------------------------------------------------------------------

@register("scan_range", f"WITH {EV} SELECT ts_ms, e AS s, u AS o FROM ev WHERE ts_ms BETWEEN {T0 + 5 * DAY} AND {T0 + 6 * DAY}")
def scan_range(spark, sf_dir):
    q = windows.time_range(event_quads(spark, sf_dir), T0 + 5 * DAY, T0 + 6 * DAY)
    return q.where(F.col("p") == f"{EX}user").select("ts_ms", "s", "o")


@register("scan_point", f"WITH {EV} SELECT ts_ms, e AS s, event_type AS o FROM ev WHERE ts_ms = (SELECT min(ts_ms) FROM ev)")
def scan_point(spark, sf_dir):
    q = event_quads(spark, sf_dir)
    first = events(spark, sf_dir).agg(F.min("ts_ms")).first()[0]
    return windows.at_time(q, first).where(F.col("p") == f"{EX}type").select("ts_ms", "s", "o")


# --- windows over the past ------------------------------------------------------------------------------

_BODY = "?e ex:user ?u ; ex:type ?t ; ex:value ?v ."


@register("win_fixed_bgp", f"WITH {EV} SELECT e, u, event_type AS t, round(value, 6) AS v FROM ev WHERE ts_ms BETWEEN {T0 + 2 * DAY} AND {T0 + 4 * DAY}")
def win_fixed_bgp(spark, sf_dir):
    return historical(event_table(spark, sf_dir), f"SELECT ?e ?u ?t ?v FROM NAMED WINDOW ex:w ON LOG ex:store [START {T0 + 2 * DAY} END {T0 + 4 * DAY}] WHERE {{ WINDOW ex:w {{ {_BODY} }} }}", e="lex", u="lex", t="lex", v="num")


def _counts(spark, sf_dir, width, step, offset):
    return historical(event_table(spark, sf_dir), f"SELECT (COUNT(?e) AS ?n) (AVG(?v) AS ?m) FROM NAMED WINDOW ex:w ON STREAM ex:events [OFFSET {offset} RANGE {width} STEP {step}] WHERE {{ WINDOW ex:w {{ ?e ex:value ?v }} }}", n="int", m="num")


def _counts_sql(width, step, offset):
    return f"WITH {EV}, {past(width, step, offset)} SELECT ws, we, count(*) AS n, round(avg(value), 6) AS m FROM w GROUP BY ws, we"


@register("win_hist_sliding_counts", _counts_sql(2 * DAY, 12 * HOUR, 10 * DAY))
def win_hist_sliding_counts(spark, sf_dir):
    return _counts(spark, sf_dir, 2 * DAY, 12 * HOUR, 10 * DAY)


@register("win_hist_sliding_step_gt_range", _counts_sql(6 * HOUR, DAY, 10 * DAY))
def win_hist_sliding_step_gt_range(spark, sf_dir):
    return _counts(spark, sf_dir, 6 * HOUR, DAY, 10 * DAY)


# --- live windows ----------------------------------------------------------------------------------------

def _live_avg(spark, sf_dir, width, step):
    return live(event_table(spark, sf_dir), f"REGISTER RStream ex:o AS SELECT ?u (AVG(?v) AS ?m) (COUNT(?e) AS ?n) FROM NAMED WINDOW ex:w ON STREAM ex:events [RANGE {width} STEP {step}] WHERE {{ WINDOW ex:w {{ ?e ex:user ?u ; ex:value ?v }} }} GROUP BY ?u", u="lex", m="num", n="int")


def _live_avg_sql(width, step):
    return f"WITH {EV}, {LIVE(width, step)} SELECT ws, we, u, round(avg(value), 6) AS m, count(*) AS n FROM w GROUP BY ws, we, u"


@register("win_tumbling_avg", _live_avg_sql(DAY, DAY))
def win_tumbling_avg(spark, sf_dir):
    return _live_avg(spark, sf_dir, DAY, DAY)


@register("win_live_sliding_avg", _live_avg_sql(DAY, 6 * HOUR))
def win_live_sliding_avg(spark, sf_dir):
    return _live_avg(spark, sf_dir, DAY, 6 * HOUR)


@register("win_set_semantics_count", f"WITH {EV}, {LIVE(DAY, 12 * HOUR)} SELECT ws, we, u, count(DISTINCT event_type) AS n FROM w GROUP BY ws, we, u")
def win_set_semantics_count(spark, sf_dir):
    did = events(spark, sf_dir).select("ts_ms", _iri("user", "user_id").alias("s"), F.lit(f"{EX}did").alias("p"), F.col("event_type").alias("o"), F.lit("").alias("g"), F.lit(STRING).cast("tinyint").alias("o_kind"), F.lit(None).cast("double").alias("o_num"))
    return live(did, f"REGISTER RStream ex:o AS SELECT ?u (COUNT(?t) AS ?n) FROM NAMED WINDOW ex:w ON STREAM ex:did [RANGE {DAY} STEP {12 * HOUR}] WHERE {{ WINDOW ex:w {{ ?u ex:did ?t }} }} GROUP BY ?u", u="lex", n="int")


@register("win_result_stamp", f"WITH {EV}, {LIVE(DAY, 12 * HOUR)} SELECT ws, we, max(ts_ms) + {DAY} AS ts, count(*) FILTER (event_type = 'purchase') AS n FROM w GROUP BY ws, we HAVING count(*) FILTER (event_type = 'purchase') > 0")
def win_result_stamp(spark, sf_dir):
    h = HybridEvaluation(PREFIX + f"REGISTER RStream ex:o AS SELECT (COUNT(?e) AS ?n) FROM NAMED WINDOW ex:w ON STREAM ex:events [RANGE {DAY} STEP {12 * HOUR}] WHERE {{ WINDOW ex:w {{ ?e ex:type \"purchase\" }} }}", streams=event_table(spark, sf_dir), now_ms=NOW)
    return h.live().select("ws", "we", "ts", F.col("n").cast("long").alias("n"))


def _two_windows() -> str:
    a, b = (DAY, DAY), (2 * DAY, DAY)
    # an instance with content fires at its end; t is the time of its last event
    def firing(k, w):
        return f"SELECT {k} AS byw, k * {w[1]} AS ws, k * {w[1]} + {w[0]} AS we, max(ts_ms) AS t FROM ev, unnest(range(CAST(floor((ts_ms - {w[0]}) / {w[1]}) AS BIGINT) + 1, ts_ms // {w[1]} + 1)) AS x(k) WHERE event_type = '{('purchase', 'click')[k]}' GROUP BY ALL"
    # the other window's instance that is open at t, the first one, as far as it comes before the end
    def held(k, w, kind):
        first = f"(CAST(floor((f.t - {w[0]}) / {w[1]}) AS BIGINT) + 1) * {w[1]}"
        return f"SELECT f.byw, f.ws, f.we, ev.e, ev.user_id, ev.u, ev.value FROM f JOIN ev ON event_type = '{kind}' AND CASE WHEN byw = {k} THEN ts_ms >= f.ws AND ts_ms < f.we ELSE {first} <= f.t AND ts_ms >= {first} AND ts_ms < least(f.we, {first} + {w[0]}) END"
    return f"WITH {EV}, f AS ({firing(0, a)} UNION ALL {firing(1, b)}), a AS ({held(0, a, 'purchase')}), b AS ({held(1, b, 'click')}) SELECT a.byw AS fired, a.ws, a.we, a.u, count(*) AS n FROM a JOIN b ON a.byw = b.byw AND a.ws = b.ws AND a.user_id = b.user_id GROUP BY a.byw, a.ws, a.we, a.u"


_TWO = f"""REGISTER RStream ex:o AS SELECT ?u (COUNT(*) AS ?n)
    FROM NAMED WINDOW ex:a ON STREAM ex:purchase [RANGE {DAY} STEP {DAY}]
    FROM NAMED WINDOW ex:b ON STREAM ex:click [RANGE {2 * DAY} STEP {DAY}]
    WHERE {{ WINDOW ex:a {{ ?x ex:user ?u }} WINDOW ex:b {{ ?y ex:user ?u }} }} GROUP BY ?u"""


@register("multi_window_join", _two_windows())
def multi_window_join(spark, sf_dir):
    w = event_table(spark, sf_dir)
    streams = {EX + k: replace(w, df=w.df.where(F.col("type") == k), graph="") for k in ("purchase", "click")}
    rel = HybridEvaluation(PREFIX + _TWO, streams=streams, now_ms=NOW).live_rel()
    return rel.df.select(F.col("by").cast("int").alias("fired"), "ws", "we", "u", F.col("n__n").cast("long").alias("n"))


# --- graphs ----------------------------------------------------------------------------------------------

@register("graph_log_same_graph", f"WITH {EV} SELECT user_id % 3 AS gk, u, count(DISTINCT event_type) AS n FROM ev WHERE ts_ms BETWEEN {T0} AND {T0 + 5 * DAY} GROUP BY 1, 2")
def graph_log_same_graph(spark, sf_dir):
    e = events(spark, sf_dir)
    g = F.concat(F.lit(EX + "g"), (F.col("user_id") % 3).cast("string"))
    cell = lambda p, o, k: F.struct(F.lit(EX + p).alias("p"), o.alias("o"), F.lit(k).cast("tinyint").alias("o_kind"), g.alias("g"))
    # the type also lies in a graph of its own, and in the default graph: neither may count
    cells = F.array(cell("did", F.col("event_type"), STRING), cell("is", F.lit(EX + "User"), IRI), cell("is", F.lit(EX + "User"), IRI).withField("g", F.lit("")), cell("did", F.lit("stray"), STRING).withField("g", F.lit(EX + "other")))
    q = e.select("ts_ms", _iri("user", "user_id").alias("s"), F.explode(cells).alias("c")).select("ts_ms", "s", "c.*", F.lit(None).cast("double").alias("o_num"))
    out = historical(q, f"SELECT ?_log_graph ?u (COUNT(?t) AS ?n) FROM NAMED WINDOW ex:w ON LOG ex:store [START {T0} END {T0 + 5 * DAY}] WHERE {{ WINDOW ex:w {{ ?u ex:did ?t ; ex:is ex:User }} }} GROUP BY ?_log_graph ?u", _log_graph="lex", u="lex", n="int")
    return out.select(F.substr("_log_graph", F.lit(len(EX) + 2)).cast("long").alias("gk"), "u", "n")


@register("graph_stream_filter", f"WITH {EV} SELECT e, round(value, 6) AS v FROM ev WHERE ts_ms BETWEEN {T0} AND {T0 + DAY}")
def graph_stream_filter(spark, sf_dir):
    both = event_quads(spark, sf_dir)
    both = both.unionByName(both.withColumn("g", F.lit(f"{EX}elsewhere")))
    return historical(both, f"SELECT ?e ?v FROM NAMED WINDOW ex:w ON STREAM ex:events [START {T0} END {T0 + DAY}] WHERE {{ WINDOW ex:w {{ ?e ex:value ?v }} }}", e="lex", v="num")


# --- patterns ----------------------------------------------------------------------------------------------

_C, _N, _R = f"'{EX}customer/' || c_custkey", f"'{EX}nation/' || n_nationkey", f"'{EX}region/' || r_regionkey"

_SPARQL: list[tuple[str, str, dict[str, str], str]] = [
    ("bgp_star", "SELECT ?c ?n ?s ?b { ?c ex:inNation ?n ; ex:segment ?s ; ex:balance ?b }", {"c": "lex", "n": "lex", "s": "lex", "b": "num"},
     f"SELECT {_C} AS c, '{EX}nation/' || c_nationkey AS n, c_mktsegment AS s, round(c_acctbal, 6) AS b FROM customer"),
    ("bgp_chain", "SELECT ?c ?nn ?rn { ?c ex:inNation ?n . ?n ex:partOf ?r ; ex:name ?nn . ?r ex:name ?rn }", {"c": "lex", "nn": "lex", "rn": "lex"},
     f"SELECT {_C} AS c, n_name AS nn, r_name AS rn FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    ("bgp_cross", "SELECT ?a ?b { ?n ex:name ?a ; ex:partOf ?x . ?r ex:name ?b FILTER NOT EXISTS { ?r ex:partOf ?y } }", {"a": "lex", "b": "lex"},
     "SELECT n_name AS a, r_name AS b FROM nation, region"),
    ("filter_numeric", "SELECT ?c ?b { ?c ex:balance ?b FILTER(?b > 5000 && ?b <= 9000.5) }", {"c": "lex", "b": "num"},
     f"SELECT {_C} AS c, round(c_acctbal, 6) AS b FROM customer WHERE c_acctbal > 5000 AND c_acctbal <= 9000.5"),
    ("filter_lexical_string", 'SELECT ?c ?s { ?c ex:segment ?s FILTER(?s > "FURNITURE") }', {"c": "lex", "s": "lex"},
     f"SELECT {_C} AS c, c_mktsegment AS s FROM customer WHERE c_mktsegment > 'FURNITURE'"),
    ("filter_exists", "SELECT ?n { ?n ex:partOf ?r FILTER EXISTS { ?c ex:inNation ?n ; ex:balance ?b FILTER(?b > 9000) } }", {"n": "lex"},
     f"SELECT {_N} AS n FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000)"),
    ("filter_not_exists", "SELECT ?c { ?c ex:inNation ?n FILTER NOT EXISTS { ?d ex:referredBy ?c } }", {"c": "lex"},
     f"SELECT {_C} AS c FROM customer a WHERE NOT EXISTS (SELECT 1 FROM customer b WHERE b.c_custkey >= 2 AND b.c_custkey // 2 = a.c_custkey)"),
    ("optional_left", "SELECT ?c ?b ?d { ?c ex:balance ?b OPTIONAL { ?d ex:referredBy ?c . ?d ex:balance ?x FILTER(?x > ?b) } }", {"c": "lex", "b": "num", "d": "lex"},
     f"SELECT '{EX}customer/' || a.c_custkey AS c, round(a.c_acctbal, 6) AS b, '{EX}customer/' || d.c_custkey AS d FROM customer a LEFT JOIN customer d ON d.c_custkey >= 2 AND d.c_custkey // 2 = a.c_custkey AND d.c_acctbal > a.c_acctbal"),
    ("union_patterns", 'SELECT ?x ?y { { ?x ex:segment "BUILDING" ; ex:balance ?y } UNION { ?x ex:partOf ?r ; ex:name ?y } }', {"x": "lex", "y": "num"},
     f"SELECT {_C} AS x, round(c_acctbal, 6) AS y FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT {_N}, NULL FROM nation"),
    ("minus_patterns", 'SELECT ?c { ?c ex:inNation ?n MINUS { ?c ex:segment "BUILDING" } }', {"c": "lex"},
     f"SELECT {_C} AS c FROM customer WHERE c_mktsegment <> 'BUILDING'"),
    ("bind_expr", "SELECT ?c ?z { ?c ex:balance ?b BIND(?b * 2 + 1 AS ?y) BIND(IF(?y > 0, ?y, 0 - ?y) AS ?z) }", {"c": "lex", "z": "num"},
     f"SELECT {_C} AS c, round(abs(c_acctbal * 2 + 1), 6) AS z FROM customer"),
    ("values_inline", 'SELECT ?c ?s ?k { VALUES (?s ?k) { ("BUILDING" 1) ("MACHINERY" 2) } ?c ex:segment ?s }', {"c": "lex", "s": "lex", "k": "int"},
     f"SELECT {_C} AS c, s, CAST(k AS BIGINT) AS k FROM customer JOIN (VALUES ('BUILDING', 1), ('MACHINERY', 2)) t(s, k) ON c_mktsegment = s"),
    ("select_distinct", "SELECT DISTINCT ?s ?n { ?c ex:segment ?s ; ex:inNation ?n }", {"s": "lex", "n": "lex"},
     f"SELECT DISTINCT c_mktsegment AS s, '{EX}nation/' || c_nationkey AS n FROM customer"),
    ("agg_count_sum_avg_min_max", "SELECT ?s (COUNT(*) AS ?k) (SUM(?b) AS ?t) (AVG(?b) AS ?m) (MIN(?b) AS ?lo) (MAX(?b) AS ?hi) { ?c ex:segment ?s ; ex:balance ?b } GROUP BY ?s", {"s": "lex", "k": "int", "t": "num", "m": "num", "lo": "num", "hi": "num"},
     "SELECT c_mktsegment AS s, count(*) AS k, round(sum(c_acctbal), 6) AS t, round(avg(c_acctbal), 6) AS m, round(min(c_acctbal), 6) AS lo, round(max(c_acctbal), 6) AS hi FROM customer GROUP BY 1"),
    ("agg_count_distinct", "SELECT ?s (COUNT(DISTINCT ?n) AS ?k) { ?c ex:segment ?s ; ex:inNation ?n } GROUP BY ?s", {"s": "lex", "k": "int"},
     "SELECT c_mktsegment AS s, count(DISTINCT c_nationkey) AS k FROM customer GROUP BY 1"),
    ("agg_group_having", "SELECT ?n (COUNT(?c) AS ?k) { ?c ex:inNation ?n } GROUP BY ?n HAVING(COUNT(?c) > 60)", {"n": "lex", "k": "int"},
     f"SELECT '{EX}nation/' || c_nationkey AS n, count(*) AS k FROM customer GROUP BY 1 HAVING count(*) > 60"),
    ("agg_group_concat", 'SELECT ?rn (GROUP_CONCAT(?nn; separator=",") AS ?all) { ?n ex:partOf ?r ; ex:name ?nn . ?r ex:name ?rn } GROUP BY ?rn', {"rn": "lex", "all": "lex"},
     "SELECT r_name AS rn, string_agg(n_name, ',' ORDER BY n_name) AS \"all\" FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    ("order_limit_topk", "SELECT ?c ?b { ?c ex:balance ?b } ORDER BY DESC(?b) ?c LIMIT 20 OFFSET 5", {"c": "lex", "b": "num"},
     f"SELECT {_C} AS c, round(c_acctbal, 6) AS b FROM customer ORDER BY c_acctbal DESC, c LIMIT 20 OFFSET 5"),
    ("subselect", "SELECT ?c ?b ?m { ?c ex:inNation ?n ; ex:balance ?b { SELECT ?n (AVG(?x) AS ?m) { ?d ex:inNation ?n ; ex:balance ?x } GROUP BY ?n } FILTER(?b > ?m) }", {"c": "lex", "b": "num", "m": "num"},
     f"SELECT {_C} AS c, round(c_acctbal, 6) AS b, round(m, 6) AS m FROM customer JOIN (SELECT c_nationkey AS k, avg(c_acctbal) AS m FROM customer GROUP BY 1) ON c_nationkey = k WHERE c_acctbal > m"),
    ("path_seq_alt_inv", "SELECT ?r ?x { ?r ^ex:partOf/(ex:name|^ex:inNation/ex:segment) ?x }", {"r": "lex", "x": "lex"},
     f"SELECT '{EX}region/' || n_regionkey AS r, n_name AS x FROM nation UNION ALL SELECT '{EX}region/' || n_regionkey, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    ("path_plus", "SELECT ?c ?a { ?c ex:referredBy+ ?a }", {"c": "lex", "a": "lex"},
     f"WITH RECURSIVE up AS (SELECT c_custkey AS c, c_custkey // 2 AS a FROM customer WHERE c_custkey >= 2 UNION SELECT c, a // 2 FROM up WHERE a >= 2) SELECT '{EX}customer/' || c AS c, '{EX}customer/' || a AS a FROM up"),
    ("path_star_zero", "SELECT ?a { <http://ex.org/customer/77> ex:referredBy* ?a }", {"a": "lex"},
     f"WITH RECURSIVE up AS (SELECT 77 AS a UNION SELECT c_custkey // 2 FROM up JOIN customer ON c_custkey = a WHERE c_custkey >= 2) SELECT '{EX}customer/' || a AS a FROM up"),
    ("path_negated", "SELECT ?s ?x { ?s !(ex:name|ex:balance|ex:segment|ex:inNation|ex:referredBy) ?x }", {"s": "lex", "x": "lex"},
     f"SELECT {_N} AS s, '{EX}region/' || n_regionkey AS x FROM nation"),
    ("sparql_string_fns", """SELECT ?n (STRLEN(?n) AS ?a) (UCASE(SUBSTR(?n, 2, 3)) AS ?b) (LCASE(?n) AS ?c) (STRBEFORE(?n, "_") AS ?d) (STRAFTER(?n, "_") AS ?e) (CONCAT(?n, "-", STR(?s)) AS ?f)
        (REPLACE(?n, "[0-9]", "#") AS ?g) (ENCODE_FOR_URI(CONCAT(?n, " /")) AS ?h) (IF(CONTAINS(?n, "1") && REGEX(?n, "^n.*[0-4]$", "i"), "y", "n") AS ?i) { ?s ex:partOf ?r ; ex:name ?n }""",
     {"n": "lex", "a": "int", "b": "lex", "c": "lex", "d": "lex", "e": "lex", "f": "lex", "g": "lex", "h": "lex", "i": "lex"},
     f"""SELECT n_name AS n, length(n_name) AS a, upper(substr(n_name, 2, 3)) AS b, lower(n_name) AS c, CASE WHEN instr(n_name, '_') > 0 THEN substr(n_name, 1, instr(n_name, '_') - 1) ELSE '' END AS d,
        CASE WHEN instr(n_name, '_') > 0 THEN substr(n_name, instr(n_name, '_') + 1) ELSE '' END AS e, n_name || '-' || {_N} AS f, regexp_replace(n_name, '[0-9]', '#', 'g') AS g,
        url_encode(n_name || ' /') AS h, CASE WHEN contains(n_name, '1') AND regexp_matches(n_name, '^n.*[0-4]$', 'i') THEN 'y' ELSE 'n' END AS i FROM nation"""),
    ("sparql_numeric_fns", "SELECT ?c (ABS(?b) AS ?a) (CEIL(?b) AS ?ce) (FLOOR(?b) AS ?fl) (ROUND(?b) AS ?ro) (?b / 3 AS ?di) (xsd:integer(?b) AS ?xi) { ?c ex:balance ?b }", {"c": "lex", "a": "num", "ce": "int", "fl": "int", "ro": "int", "di": "num", "xi": "int"},
     f"SELECT {_C} AS c, round(abs(c_acctbal), 6) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS ce, CAST(floor(c_acctbal) AS BIGINT) AS fl, CAST(floor(c_acctbal + 0.5) AS BIGINT) AS ro, round(c_acctbal / 3, 6) AS di, CAST(trunc(c_acctbal) AS BIGINT) AS xi FROM customer"),
    ("sparql_hash_fns", "SELECT ?n (MD5(?n) AS ?a) (SHA1(?n) AS ?b) (SHA256(?n) AS ?c) { ?s ex:partOf ?r ; ex:name ?n }", {"n": "lex", "a": "lex", "b": "lex", "c": "lex"},
     "SELECT n_name AS n, md5(n_name) AS a, sha1(n_name) AS b, sha256(n_name) AS c FROM nation"),
    ("sparql_datetime_fns", """SELECT ?o (YEAR(?t) AS ?y) (MONTH(?t) AS ?m) (DAY(?t) AS ?d) (HOURS(?t) AS ?h) (MINUTES(?t) AS ?mi) (SECONDS(?t) AS ?s) (TZ(?t) AS ?z) (TIMEZONE(?t) AS ?tz)
        { ?o ex:ordered ?x BIND(xsd:dateTime(?x) AS ?t) FILTER(?t >= xsd:dateTime("1994-06-01T00:00:00Z")) }""", {"o": "lex", "y": "int", "m": "int", "d": "int", "h": "int", "mi": "int", "s": "num", "z": "lex", "tz": "lex"},
     f"""SELECT '{EX}order/' || o_orderkey AS o, year(t) AS y, month(t) AS m, day(t) AS d, hour(t) AS h, minute(t) AS mi, round(CAST(second(t) AS DOUBLE), 6) AS s, 'Z' AS z, 'PT0S' AS tz
        FROM (SELECT o_orderkey, o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) + to_seconds(CAST(o_orderkey % 60 AS INTEGER)) AS t FROM orders) WHERE t >= TIMESTAMP '1994-06-01 00:00:00'"""),
    ("sparql_casts", """SELECT ?c (xsd:string(?b) AS ?s) (xsd:double(CONCAT(STR(?k), "e1")) AS ?d) (xsd:decimal(?k) AS ?de) (xsd:boolean(?k) AS ?bo) (xsd:integer("x") AS ?bad) (xsd:boolean("maybe") AS ?no)
        { ?c ex:segment ?b ; ex:balance ?x BIND(IF(?x > 0, 1, 0) AS ?k) }""", {"c": "lex", "s": "lex", "d": "num", "de": "num", "bo": "lex", "bad": "int", "no": "lex"},
     f"""SELECT {_C} AS c, c_mktsegment AS s, CAST(CASE WHEN c_acctbal > 0 THEN 10 ELSE 0 END AS DOUBLE) AS d, CAST(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS DOUBLE) AS de, CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END AS bo,
        CAST(NULL AS BIGINT) AS bad, CAST(NULL AS VARCHAR) AS no FROM customer"""),
    ("agg_sample", "SELECT ?n (SAMPLE(?nn) AS ?x) (COUNT(?c) AS ?k) { ?c ex:inNation ?n . ?n ex:name ?nn } GROUP BY ?n", {"n": "lex", "x": "lex", "k": "int"},
     f"SELECT {_N} AS n, n_name AS x, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"),
    ("sparql_term_fns", "SELECT ?s ?p (isIRI(?o) AS ?i) (isNumeric(?o) AS ?n) (DATATYPE(?o) AS ?d) (COALESCE(?zzz, \"none\") AS ?z) { ?s ?p ?o FILTER(?p IN (ex:name, ex:partOf)) }", {"s": "lex", "p": "lex", "i": "lex", "n": "lex", "d": "lex", "z": "lex"},
     f"""SELECT {_R} AS s, '{EX}name' AS p, 'false' AS i, 'false' AS n, 'http://www.w3.org/2001/XMLSchema#string' AS d, 'none' AS z FROM region
        UNION ALL SELECT {_N}, '{EX}name', 'false', 'false', 'http://www.w3.org/2001/XMLSchema#string', 'none' FROM nation UNION ALL SELECT {_N}, '{EX}partOf', 'true', 'false', NULL, 'none' FROM nation"""),
]


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When orders were made, as texts; the tables' dates have no time, so one is made of the key."""
    key = F.col("o_orderkey")
    at = F.expr("CAST(o_orderdate AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, CAST(o_orderkey % 1440 AS INT), o_orderkey % 60)")
    text = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return table(spark, sf_dir, "orders").select(F.lit(0).cast("long").alias("ts_ms"), F.concat(F.lit(f"{EX}order/"), key.cast("string")).alias("s"), F.lit(f"{EX}ordered").alias("p"), text.alias("o"), F.lit("").alias("g"), F.lit(STRING).cast("tinyint").alias("o_kind"), F.lit(None).cast("double").alias("o_num"))


def _sparql_query(text: str, out: dict[str, str]) -> Query:
    facts = orders if "ex:ordered" in text else background
    return lambda spark, sf_dir: sparql(facts(spark, sf_dir), text, **out)


for _name, _text, _out, _sql in _SPARQL:
    register(_name, _sql)(_sparql_query(_text, _out))


@register("ask_query", "SELECT EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 9000) AS answer")
def ask_query(spark, sf_dir):
    return Plan(Dataset(background(spark, sf_dir))).ask(parse_sparql(PREFIX + "ASK { ?c ex:balance ?b FILTER(?b > 9000) }"))


@register("construct_query", f"SELECT DISTINCT '{EX}region/' || n_regionkey AS s, '{EX}servesSegment' AS p, c_mktsegment AS o FROM customer JOIN nation ON c_nationkey = n_nationkey")
def construct_query(spark, sf_dir):
    q = parse_sparql(PREFIX + "CONSTRUCT { ?r ex:servesSegment ?s } WHERE { ?c ex:inNation ?n ; ex:segment ?s . ?n ex:partOf ?r }")
    return Plan(Dataset(background(spark, sf_dir), functional=FUNCTIONAL)).construct(q).select("s", "p", "o")


@register("describe_query", f"SELECT '{EX}nation/3' AS s, '{EX}name' AS p, n_name AS o FROM nation WHERE n_nationkey = 3 UNION ALL SELECT '{EX}nation/3', '{EX}partOf', '{EX}region/' || n_regionkey FROM nation WHERE n_nationkey = 3")
def describe_query(spark, sf_dir):
    return Plan(Dataset(background(spark, sf_dir))).describe(parse_sparql(PREFIX + "DESCRIBE <http://ex.org/nation/3>")).select("s", "p", "o")


# --- anomaly functions: a value against the mean and deviation of its user ------------------------------

_STATS = "s AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS sd FROM ev GROUP BY 1), j AS (SELECT e, ev.user_id, value AS v, m, sd FROM ev JOIN s ON ev.user_id = s.user_id)"


def _against_user(spark: SparkSession, sf_dir: str, call: str, boolean: bool) -> DataFrame:
    """Applies a function of the registry in a SPARQL BIND; the user's statistics are quads."""
    w = event_table(spark, sf_dir)
    by_user = w.df.groupBy("user").agg(mean(F.col("number")).alias("m"), F.stddev_pop("number").alias("sd"))
    # one row an event with its user's statistics: a wide table again
    df = w.df.join(by_user, "user").select("ts_ms", "event", F.col("number").alias("v"), "m", "sd")
    data = Dataset(df.select(F.lit("").alias("g"), F.lit("").alias("s"), F.lit("").alias("p"), F.lit("").alias("o"), F.lit(0).cast("tinyint").alias("o_kind"), F.lit(None).cast("double").alias("o_num")).where(F.lit(False)),
                   wide=Wide(df, "event", {f"{EX}v": ("v", DECIMAL, "v"), f"{EX}m": ("m", DECIMAL, "m"), f"{EX}sd": ("sd", DECIMAL, "sd")}))
    if boolean:
        return sparql(data, f"SELECT ?e {{ ?e ex:v ?v ; ex:m ?m ; ex:sd ?sd FILTER({call}) }}", e="lex")
    return sparql(data, f"SELECT ?e ?r {{ ?e ex:v ?v ; ex:m ?m ; ex:sd ?sd BIND({call} AS ?r) }}", e="lex", r="num")


_FUNCTIONS = [
    ("fn_abs_diff", "fn:abs_diff(?v, ?m)", False, "round(abs(v - m), 6)"),
    ("fn_relative_change", "fn:relative_change(?v, ?m)", False, "round((v - m) / m, 6)"),
    ("fn_zscore", "fn:zscore(?v, ?m, ?sd)", False, "round(CASE WHEN abs(sd) < 2.220446049250313e-16 THEN 0 ELSE (v - m) / sd END, 6)"),
    ("rule_absolute", "fn:absolute_threshold_exceeded(?v, ?m, 40)", True, "abs(v - m) > 40"),
    ("rule_relative", "fn:relative_threshold_exceeded(?v, ?m, 0.8)", True, "(v - m) / m > 0.8"),
    ("rule_catch_up", "fn:catch_up(?m, ?v, 30)", True, "m - v > 30"),
    ("rule_volatility", "fn:volatility_increase(?v, ?sd, 10)", True, "v > sd + 10"),
    ("rule_outlier", "fn:is_outlier(?v, ?m, ?sd, 2)", True, "abs((v - m) / sd) > 2"),
    ("rule_trend", "fn:trend_divergent(?v, ?sd, 50)", True, "abs(v - sd) > 50"),
]


def _function_query(call: str, boolean: bool) -> Query:
    return lambda spark, sf_dir: _against_user(spark, sf_dir, call, boolean)


for _name, _text, _bool, _sql in _FUNCTIONS:
    register(_name, f"WITH {EV}, {_STATS} SELECT e{'' if _bool else f', {_sql} AS r'} FROM j{f' WHERE {_sql}' if _bool else ''}")(_function_query(_text, _bool))


# --- comparator ----------------------------------------------------------------------------------------

_CMP = (f"{EV}, h AS (SELECT ts_ms // {HOUR} AS ts, avg(value) FILTER (event_id % 2 = 0) AS live, avg(value) FILTER (event_id % 2 = 1) AS hist FROM ev GROUP BY 1), "
        "p AS (SELECT * FROM h WHERE live IS NOT NULL AND hist IS NOT NULL), "
        "st AS (SELECT ts, live, hist, avg(live) OVER x AS lm, avg(hist) OVER x AS hm, stddev_pop(live) OVER x AS ls, stddev_pop(hist) OVER x AS hs, coalesce(nullif(regr_slope(live, CAST(ts AS DOUBLE)) OVER x, 'NaN'::DOUBLE), 0) AS lb, coalesce(nullif(regr_slope(hist, CAST(ts AS DOUBLE)) OVER x, 'NaN'::DOUBLE), 0) AS hb, count(*) OVER x AS n FROM p WINDOW x AS (ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))")


def _series(spark, sf_dir) -> DataFrame:
    """Two hourly series: means of events with even and with odd ids."""
    e = events(spark, sf_dir)
    half = lambda k: F.avg(F.when(F.col("event_id") % 2 == k, F.col("value")))
    hour = F.floor(F.col("ts_ms") / HOUR).cast("long")
    return e.groupBy(hour.alias("ts")).agg(half(0).alias("live"), half(1).alias("hist")).where("live IS NOT NULL AND hist IS NOT NULL").withColumn("series", F.lit("all"))


@register("cmp_stats", f"WITH {_CMP} SELECT ts, round(lm, 6) AS mean, round(ls, 6) AS std_dev, round(lb, 6) AS slope, n AS \"count\" FROM st")
def cmp_stats(spark, sf_dir):
    s = comparator.trailing_stats(_series(spark, sf_dir), "live", "ts", ("series",), 10)
    return s.select("ts", *(rounded(F.col(c)).alias(c) for c in ("mean", "std_dev", "slope")), "count")


@register("cmp_events", f"""WITH {_CMP} SELECT ts, position, event FROM (
  SELECT ts, 1 AS position, 'absolute_threshold_exceeded' AS event FROM st WHERE abs(lm - hm) > 1
  UNION ALL SELECT ts, 2, 'relative_change_exceeded' FROM st WHERE abs(hm) > 2.220446049250313e-16 AND (lm - hm) / hm > 0.1
  UNION ALL SELECT ts, 3, 'catch_up' FROM st WHERE hm - lm > 2
  UNION ALL SELECT ts, 4, 'trend_divergence' FROM st WHERE lb * hb < 0 AND abs(lb) > 0.01 AND abs(hb) > 0.01
  UNION ALL SELECT ts, 5, 'volatility_increase' FROM st WHERE ls > hs + 0.5
  UNION ALL SELECT ts, 6, 'live_outlier' FROM st WHERE hs > 2.220446049250313e-16 AND abs((live - hm) / hs) > 3)""")
def cmp_events(spark, sf_dir):
    return comparator.compare(_series(spark, sf_dir), by=("series",)).select("ts", "position", "event")


# --- baselines and hybrid queries -------------------------------------------------------------------------

_HYBRID = "SELECT ?u ?v FROM NAMED WINDOW ex:h {past} FROM NAMED WINDOW ex:l ON STREAM ex:readings [RANGE {day} STEP {step}] USING BASELINE ex:h {mode} WHERE {{ WINDOW ex:h {{ {body} }} WINDOW ex:l {{ ?u ex:reading ?v }} }}"


def _baseline(spark, sf_dir, past_text: str, mode: str) -> DataFrame:
    text = PREFIX + _HYBRID.format(past=past_text, mode=mode, body="?u ex:reading ?v", day=DAY, step=6 * HOUR)
    q = reading_table(spark, sf_dir)
    found = HybridEvaluation(text, log=q, streams=q, now_ms=NOW).baseline()
    return found.select("s", "p", rounded(F.col("o_num")).alias("o"))


def _baseline_sql(source: str, keep: str = "TRUE") -> str:
    return f"WITH {EV}{source}, d AS (SELECT DISTINCT ws, u, value FROM w WHERE {keep}) SELECT u AS s, '{baselines.NAMESPACE}v' AS p, round(avg(value), 6) AS o FROM d GROUP BY u"


@register("baseline_fixed", _baseline_sql(f", w AS (SELECT 0 AS ws, ev.* FROM ev WHERE ts_ms BETWEEN {T0} AND {T0 + 10 * DAY})"))
def baseline_fixed(spark, sf_dir):
    return _baseline(spark, sf_dir, f"ON STREAM ex:readings [START {T0} END {T0 + 10 * DAY}]", "AGGREGATE")


_PAST = f"ON LOG ex:store [OFFSET {6 * DAY + HOUR} RANGE {2 * DAY} STEP {DAY}]"


@register("baseline_sliding_last", _baseline_sql(", " + past(2 * DAY, DAY, 6 * DAY + HOUR), "ws = (SELECT max(ws) FROM k)"))
def baseline_sliding_last(spark, sf_dir):
    return _baseline(spark, sf_dir, _PAST, "LAST")


@register("baseline_sliding_aggregate", _baseline_sql(", " + past(2 * DAY, DAY, 6 * DAY + HOUR)))
def baseline_sliding_aggregate(spark, sf_dir):
    return _baseline(spark, sf_dir, _PAST, "AGGREGATE")


@register("hybrid_outlier", f"""WITH {EV}, b AS (SELECT u, avg(value) AS m, stddev_pop(value) AS sd FROM (SELECT DISTINCT u, value FROM ev WHERE ts_ms BETWEEN {T0} AND {T0 + 15 * DAY}) GROUP BY u),
  {LIVE(DAY, 6 * HOUR)}, l AS (SELECT DISTINCT ws, we, u, value FROM w WHERE ts_ms > {T0 + 15 * DAY})
  SELECT ws, we, l.u, round(value, 6) AS v, round(m, 6) AS mean FROM l JOIN b ON l.u = b.u WHERE sd >= 2.220446049250313e-16 AND abs((value - m) / sd) > 3""")
def hybrid_outlier(spark, sf_dir):
    """The flagship: live readings that are outliers against each user's past, three deviations from the
    mean. The baseline of the past window keeps the means of readings and of their squares."""
    past_quads = reading_table(spark, sf_dir)
    now = past_quads.where(F.col("ts_ms") > T0 + 15 * DAY)
    text = f"""REGISTER RStream ex:out AS SELECT ?u ?v ?mean ?past ?square
        FROM NAMED WINDOW ex:h ON LOG ex:store [START {T0} END {T0 + 15 * DAY}]
        FROM NAMED WINDOW ex:l ON STREAM ex:readings [RANGE {DAY} STEP {6 * HOUR}] USING BASELINE ex:h AGGREGATE
        WHERE {{ WINDOW ex:h {{ ?u ex:reading ?past BIND(?past * ?past AS ?square) }} WINDOW ex:l {{ ?u ex:reading ?v }}
            ?u base:past ?mean ; base:square ?m2 . BIND(?m2 - ?mean * ?mean AS ?variance) FILTER(?variance > 1e-9 && (?v - ?mean) * (?v - ?mean) > 9 * ?variance) }}"""
    return live(now, text, log=past_quads, u="lex", v="num", mean="num")


@register("hybrid_baseline_join", f"""WITH {EV}, b AS (SELECT u, avg(value) AS m FROM (SELECT DISTINCT u, value FROM ev WHERE ts_ms BETWEEN {T0} AND {T0 + 15 * DAY}) GROUP BY u),
  {LIVE(DAY, DAY)}, l AS (SELECT DISTINCT ws, we, u, value FROM w) SELECT ws, we, l.u, round(value, 6) AS x FROM l JOIN b ON l.u = b.u WHERE (value - m) / m > 2""")
def hybrid_baseline_join(spark, sf_dir):
    q = reading_table(spark, sf_dir)
    return live(q, f"""REGISTER RStream ex:out AS SELECT ?u ?v ?x FROM NAMED WINDOW ex:h ON STREAM ex:readings [START {T0} END {T0 + 15 * DAY}]
        FROM NAMED WINDOW ex:l ON STREAM ex:readings [RANGE {DAY} STEP {DAY}] USING BASELINE ex:h AGGREGATE
        WHERE {{ WINDOW ex:h {{ ?u ex:reading ?v }} WINDOW ex:l {{ ?u ex:reading ?x }} ?u base:v ?m . FILTER(fn:relative_threshold_exceeded(?x, ?m, 2)) }}""", log=q, u="lex", x="num")


@register("r2s_istream", f"WITH {EV}, {LIVE(2 * DAY, DAY)}, d AS (SELECT DISTINCT ws, we, u FROM w WHERE value > 150) SELECT ws, we, u FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.ws = a.ws - {DAY} AND b.u = a.u)")
def r2s_istream(spark, sf_dir):
    text = PREFIX + f"REGISTER IStream ex:o AS SELECT DISTINCT ?u FROM NAMED WINDOW ex:w ON STREAM ex:events [RANGE {2 * DAY} STEP {DAY}] WHERE {{ WINDOW ex:w {{ ?e ex:user ?u ; ex:value ?v FILTER(?v > 150) }} }}"
    return HybridEvaluation(text, streams=event_table(spark, sf_dir), now_ms=NOW).live().select("ws", "we", "u")


@register("r2s_dstream", f"WITH {EV}, {LIVE(2 * DAY, DAY)}, d AS (SELECT DISTINCT ws, we, u FROM w WHERE value > 150) SELECT ws, we, u FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.ws = a.ws + {DAY} AND b.u = a.u)")
def r2s_dstream(spark, sf_dir):
    text = PREFIX + f"REGISTER DStream ex:o AS SELECT DISTINCT ?u FROM NAMED WINDOW ex:w ON STREAM ex:events [RANGE {2 * DAY} STEP {DAY}] WHERE {{ WINDOW ex:w {{ ?e ex:user ?u ; ex:value ?v FILTER(?v > 150) }} }}"
    return HybridEvaluation(text, streams=event_table(spark, sf_dir), now_ms=NOW).live().select("ws", "we", "u")


def _every_quad(df: DataFrame) -> DataFrame:
    """Quads with the numbers among their objects as v: engines write them differently."""
    value = F.col("p") == f"{EX}value"
    return df.select("ts_ms", "s", "p", F.when(~value, F.col("o")).alias("o"), rounded(F.when(value, F.col("o")).cast("double")).alias("v"), "g")


_EVERY_QUAD = f"WITH {EV} " + " UNION ALL ".join(
    f"SELECT ts_ms, e AS s, '{EX}{p}' AS p, {o} AS o, {v} AS v, '{EX}events' AS g FROM ev WHERE {c} IS NOT NULL"
    for p, o, v, c in (("user", "u", "NULL", "user_id"), ("type", "event_type", "NULL", "event_type"), ("value", "NULL", "round(value, 6)", "value")))


@register("nquads_parse", _EVERY_QUAD)
def nquads_parse(spark, sf_dir):
    """Renders every quad as a text line and parses the lines again."""
    from .model import typed
    from .sources import nquads

    lines = nquads.to_line(event_quads(spark, sf_dir))
    return _every_quad(typed(nquads.parse_lines(lines).where("error IS NULL").drop("value", "error")))


@register("dictionary_roundtrip", _EVERY_QUAD)
def dictionary_roundtrip(spark, sf_dir):
    """Every quad as ids and back."""
    from .sources import dictionary

    q = event_quads(spark, sf_dir)
    terms = dictionary.build(q)
    return _every_quad(dictionary.decode(dictionary.encode(q, terms), terms))


@register("dictionary_extend", _EVERY_QUAD)
def dictionary_extend(spark, sf_dir):
    """A dictionary of one term, extended by the first ten days, written, read and extended by all the
    rest; an id that two terms had would multiply rows."""
    from .sources import dictionary
    from .workspace import scratch

    q, at = event_quads(spark, sf_dir), scratch(spark, "dictionary")
    dictionary.save(dictionary.build(q.limit(1).select(*(F.lit(f"{EX}events").alias(c) for c in dictionary.POSITIONS))), at)
    for part in (q.where(F.col("ts_ms") < T0 + 10 * DAY), q):
        dictionary.extend(spark, at, part)
    terms = dictionary.load(spark, at)
    return _every_quad(dictionary.decode(dictionary.encode(q, terms), terms, strict=True))


# --- the quad log ---------------------------------------------------------------------------------------

def _log(spark: SparkSession):
    from .sources.log import LogConfig, QuadLog
    from .workspace import scratch

    return QuadLog(spark, scratch(spark, "log"), LogConfig(bucket_ms=DAY))


def _users(quads: DataFrame) -> DataFrame:
    return quads.where(F.col("p") == f"{EX}user").select("ts_ms", "s", "o")


@register("log_scan_range", ORACLES["scan_range"])
def log_scan_range(spark, sf_dir):
    log = _log(spark)
    log.append(event_quads(spark, sf_dir))
    return _users(log.scan(T0 + 5 * DAY, T0 + 6 * DAY))


@register("log_point", ORACLES["scan_point"])
def log_point(spark, sf_dir):
    log = _log(spark)
    log.append(event_quads(spark, sf_dir))
    first = log.quads().agg(F.min("ts_ms")).first()[0]
    return log.at(first).where(F.col("p") == f"{EX}type").select("ts_ms", "s", "o")


@register("log_out_of_order", ORACLES["scan_range"])
def log_out_of_order(spark, sf_dir):
    """Later days come first, then odd and even events of the earlier ones; files are then merged."""
    log, q = _log(spark), event_quads(spark, sf_dir)
    late, odd = F.col("ts_ms") >= T0 + 5 * DAY + 12 * HOUR, F.col("ts_ms") % 2 == 1
    for part in (q.where(late), q.where(~late & odd), q.where(~late & ~odd)):
        log.append(part)
    log.compact()
    return _users(log.scan(T0 + 5 * DAY, T0 + 6 * DAY))


@register("log_after_flush", f"WITH {EV}, f AS (SELECT min(ts_ms) AS t FROM ev) SELECT stage, ts_ms, e AS s, u AS o FROM ev, (VALUES ('buffered'), ('flushed')) x(stage) WHERE ts_ms BETWEEN (SELECT t FROM f) AND (SELECT t FROM f) + {DAY}")
def log_after_flush(spark, sf_dir):
    """The quads of the first moment are written one by one: they are there before and after a flush."""
    log, q = _log(spark), event_quads(spark, sf_dir)
    first = q.agg(F.min("ts_ms")).first()[0]
    log.append(q.where(F.col("ts_ms") > first))
    log.write_all(tuple(r) for r in windows.at_time(q, first).select("ts_ms", "s", "p", "o", "g").toLocalIterator())
    held = _users(log.scan(first, first + DAY)).select(F.lit("buffered").alias("stage"), "ts_ms", "s", "o")
    log.flush()
    return held.unionByName(_users(log.scan(first, first + DAY)).select(F.lit("flushed").alias("stage"), "ts_ms", "s", "o"))


@register("index_scan_range", ORACLES["scan_range"])
def index_scan_range(spark, sf_dir):
    """A range by a sparse index over files in time order, not partitioned; their quads are ids of a dictionary."""
    from .sources import dictionary
    from .sources.index import TimeIndex
    from .workspace import materialize, scratch

    q = event_quads(spark, sf_dir).where(F.col("p") == f"{EX}user")
    terms = materialize(dictionary.build(q), "dictionary")
    ids = materialize(dictionary.encode(q, terms).repartitionByRange(8, "ts_ms").sortWithinPartitions("ts_ms"), "ids")
    found = TimeIndex.build(ids, scratch(spark, "index"), 100).query(T0 + 5 * DAY, T0 + 6 * DAY, terms)
    return found.select("ts_ms", "s", "o")


@register("static_inside_window", f"""WITH {EV}, {LIVE(DAY, 12 * HOUR)} SELECT ws, we, u, 'tier' || user_id % 3 AS k, count(*) AS n, round(max(value), 6) AS m FROM (SELECT DISTINCT ws, we, e, u, user_id, value FROM w) WHERE user_id % 2 = 0 GROUP BY ws, we, u, user_id""")
def static_inside_window(spark, sf_dir):
    """A pattern inside of a window that static quads match."""
    users = events(spark, sf_dir).where("user_id % 2 = 0").select("user_id").distinct()
    static = users.select(F.lit(0).cast("long").alias("ts_ms"), _iri("user", "user_id").alias("s"), F.lit(f"{EX}tier").alias("p"), F.concat(F.lit("tier"), (F.col("user_id") % 3).cast("string")).alias("o"), F.lit("").alias("g"), F.lit(STRING).cast("tinyint").alias("o_kind"), F.lit(None).cast("double").alias("o_num"))
    return live(event_table(spark, sf_dir), f"REGISTER RStream ex:o AS SELECT ?u ?k (COUNT(?e) AS ?n) (MAX(?v) AS ?m) FROM NAMED WINDOW ex:w ON STREAM ex:events [RANGE {DAY} STEP {12 * HOUR}] WHERE {{ WINDOW ex:w {{ ?e ex:user ?u ; ex:value ?v . ?u ex:tier ?k }} }} GROUP BY ?u ?k", static=static, u="lex", k="lex", n="int", m="num")


# --- streams --------------------------------------------------------------------------------------------

def _streamed(spark: SparkSession, sf_dir: str, text: str, streams: Callable[[DataFrame], dict[str, DataFrame]], schema: str) -> DataFrame:
    """A live query run by Structured Streaming over the events' files, until they are used up: windows
    that the watermark has passed."""
    from .streaming.live import LiveQuery
    from .workspace import scratch

    raw = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)  # a stream's path is a folder
    at, columns = scratch(spark, "streamed"), [c.split()[0] for c in schema.split(", ")]
    spark.createDataFrame([], schema).write.parquet(at)
    LiveQuery(PREFIX + text, streams(raw), style="full", on_result=lambda out: out.select(*columns).write.mode("append").parquet(at)).start().await_end()
    return spark.read.schema(schema).parquet(at)


@register("live_streaming_equals_batch", f"""WITH {EV}, {LIVE(2 * DAY, DAY)} SELECT ws, we, u, round(avg(value), 6) AS m, count(*) AS n FROM (SELECT DISTINCT ws, we, e, u, value FROM w WHERE we <= (SELECT max(ts_ms) FROM ev)) GROUP BY ws, we, u""")
def live_streaming_equals_batch(spark, sf_dir):
    text = f"REGISTER RStream ex:o AS SELECT ?u (AVG(?v) AS ?m) (COUNT(?e) AS ?n) FROM NAMED WINDOW ex:w ON STREAM ex:events [RANGE {2 * DAY} STEP {DAY}] WHERE {{ WINDOW ex:w {{ ?e ex:user ?u ; ex:value ?v }} }} GROUP BY ?u"
    out = _streamed(spark, sf_dir, text, lambda raw: {f"{EX}events": as_quads(raw)}, "ws long, we long, u string, m__n double, n__n double")
    return out.select("ws", "we", "u", rounded(F.col("m__n")).alias("m"), F.col("n__n").cast("long").alias("n"))


@register("live_multi_window_equals_batch", f"SELECT ws, we, u, n FROM ({_two_windows()}) WHERE we <= (SELECT least(max(epoch_us(ts) // 1000) FILTER (event_type = 'purchase'), max(epoch_us(ts) // 1000) FILTER (event_type = 'click')) FROM events)")
def live_multi_window_equals_batch(spark, sf_dir):
    out = _streamed(spark, sf_dir, _TWO, lambda raw: {EX + k: as_quads(raw.where(F.col("event_type") == k)).withColumn("g", F.lit("")) for k in ("purchase", "click")}, "ws long, we long, u string, n__n double")
    return out.select("ws", "we", "u", F.col("n__n").cast("long").alias("n"))


@register("live_istream_equals_batch", f"WITH {EV}, {LIVE(2 * DAY, DAY)}, d AS (SELECT DISTINCT ws, we, u FROM w WHERE value > 150 AND we <= (SELECT max(ts_ms) FROM ev)) SELECT ws, we, u FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.ws = a.ws - {DAY} AND b.u = a.u)")
def live_istream_equals_batch(spark, sf_dir):
    text = f"REGISTER IStream ex:o AS SELECT DISTINCT ?u FROM NAMED WINDOW ex:w ON STREAM ex:events [RANGE {2 * DAY} STEP {DAY}] WHERE {{ WINDOW ex:w {{ ?e ex:user ?u ; ex:value ?v FILTER(?v > 150) }} }}"
    return _streamed(spark, sf_dir, text, lambda raw: {f"{EX}events": as_quads(raw)}, "ws long, we long, u string")


__all__ = ["ORACLES", "QUERIES"]
