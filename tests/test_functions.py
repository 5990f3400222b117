import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quadtide import sparql
from quadtide.functions import anomaly
from quadtide.model import mean, number_text, parse_number, quads_of


@pytest.mark.parametrize("name, args, want", [
    ("absolute_threshold_exceeded", [3, 1, 1.5], True),
    ("relative_threshold_exceeded", [1.05, 1, 0.5], False),
    ("catch_up", [5, 1, 3], True),
    ("volatility_increase", [1, 0.5, 1], False),
    ("is_outlier", [10, 3, 2, 3], True),
    ("is_outlier", [10, 3, 0, 3], False),
    ("relative_threshold_exceeded", [1, 0, 5], True),
    ("relative_threshold_exceeded", [-1, 0, 5], False),
    ("relative_threshold_exceeded", [0, 0, 0], False),
    ("trend_divergent", [1.0, 0.5, 0.5], False),
    ("trend_divergent", [1.0, 0.4, 0.5], True),
    ("absolute_threshold_exceeded", [math.nan, 1, 0], False),
])
def test_rules(spark, name, args, want):
    assert anomaly.evaluate_rule(name, args) is want
    f = anomaly.lookup("http://any.example/fn#" + name)
    assert spark.range(1).select(f.build(*(F.lit(float(a)) for a in args)).alias("r")).first()["r"] is want


def test_numbers(spark):
    row = spark.range(1).select(
        anomaly.abs_diff(F.lit(3.0), F.lit(5.0)).alias("a"), anomaly.relative_change(F.lit(3.0), F.lit(2.0)).alias("b"), anomaly.relative_change(F.lit(3.0), F.lit(0.0)).alias("c"),
        anomaly.zscore(F.lit(3.0), F.lit(1.0), F.lit(0.5)).alias("d"), anomaly.zscore(F.lit(3.0), F.lit(1.0), F.lit(1e-17)).alias("e")).first()
    assert tuple(row) == (2.0, 0.5, None, 4.0, 0.0)


def test_wrong_arity_and_unknown():
    with pytest.raises(ValueError):
        anomaly.evaluate_rule("is_outlier", [1.0])
    assert anomaly.lookup("http://any.example/fn#nothing") is None
    assert anomaly.lookup("http://any.example/is_outlier") is None
    assert len(anomaly.all_functions()) >= 9


def test_user_function(spark):
    anomaly.register_function("http://mine/double", lambda x: x * 2, 1)
    q = quads_of(spark, [(0, "http://e/a", "http://e/p", "4.5", "")])
    assert sparql.query(q, "SELECT ?r { ?s ?p ?o BIND(<http://mine/double>(?o) AS ?r) }").first()["r"] == "9"


@pytest.mark.parametrize("text, want", [("5", 5.0), ("-1.5e3", -1500.0), (".5", 0.5), ("5.", 5.0), ("5d", None), (" 5", None), ("", None), ("1e", None), ("true", None), ("inf", math.inf), ("-Infinity", -math.inf)])
def test_number_grammar(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(parse_number(F.col("t")).alias("n")).first()["n"] == want


@pytest.mark.parametrize("n, want", [(15.0, "15"), (-0.5, "-0.5"), (12345678.25, "12345678.25"), (1e-5, "0.00001"), (0.0, "0"), (1e15, "1000000000000000")])
def test_number_text(spark, n, want):
    assert spark.createDataFrame([(n,)], "n double").select(number_text(F.col("n")).alias("t")).first()["t"] == want


def test_builtins(spark):
    q = quads_of(spark, [(0, "http://e/a", "http://e/p", "Héllo wörld", ""), (0, "http://e/a", "http://e/d", "2024-03-05T06:07:08.5+01:00", "")])
    one = lambda e: sparql.query(q, f"PREFIX e: <http://e/> SELECT ({e} AS ?r) {{ e:a e:p ?x ; e:d ?d }}").first()["r"]
    assert one('STRBEFORE(?x, " ")') == "Héllo" and one('STRAFTER(?x, "zz")') == "" and one("STRLEN(?x)") == "11"
    assert one("SUBSTR(?x, 7)") == "wörld" and one("SUBSTR(?x, 0, 3)") == "Hé" and one('CONCAT(UCASE(?x), "!")') == "HÉLLO WÖRLD!"
    assert one("ENCODE_FOR_URI(\"a b*~/ü\")") == "a%20b%2A~%2F%C3%BC"
    assert one('REPLACE(?x, "[éö]", "_")') == "H_llo w_rld" and one('REGEX(?x, "^h", "i")') == "true" and one('REGEX("a.b", "a.b", "q")') == "true"
    assert one("YEAR(?d)") == "2024" and one("MONTH(?d)") == "3" and one("SECONDS(?d)") == "8.5" and one("TZ(?d)") == "+01:00" and one("TIMEZONE(?d)") == "PT1H"
    assert one("ROUND(2.5)") == "3" and one("ROUND(-2.5)") == "-2" and one("CEIL(-1.2)") == "-1" and one("ABS(-3)") == "3"
    assert one("IF(?x = ?d, 1, 2)") == "2" and one("COALESCE(?none, 1/0, 7)") == "7" and one("?x IN (1, ?x)") == "true" and one("3 NOT IN (1, 2)") == "true"
    assert one("DATATYPE(3)").endswith("#integer") and one("DATATYPE(?x)").endswith("#string") and one('LANGMATCHES("en-GB", "EN")') == "true" and one("LANG(?x)") == ""
    assert one('xsd:integer("7.9")') == "7" and one('xsd:boolean("0")') == "false" and one("xsd:double(?x)") is None and one('STRDT("5", xsd:decimal) + 1') == "6"
    assert one("isIRI(e:a)") == "true" and one("isLiteral(?x)") == "true" and one("sameTerm(?x, ?x)") == "true" and one("STR(e:a)") == "http://e/a" and one("IRI(\"http://z\") = <http://z>") == "true"
    assert len(one("UUID()")) == 45 and len(one("STRUUID()")) == 36 and 0 <= float(one("RAND()")) < 1 and one("NOW()").endswith("Z")
    assert len(one("SHA512(?x)")) == 128 and len(one("SHA384(?x)")) == 96


def test_deep_expressions_compile(spark):
    q = quads_of(spark, [(0, "http://e/a", "http://e/p", "2", "")])
    deep = "?o" + " + 1" * 40 + " - " + "(" * 12 + "?o" + " * 1)" * 12
    assert sparql.query(q, f"SELECT (({deep}) AS ?r) {{ ?s ?p ?o }}").first()["r"] == "40"


def test_mean_whatever_the_order(spark):
    """The decimals' mean, rounded once; as before where values are no decimals of 12 and 12 digits."""
    rng = random.Random(7)
    groups = [[rng.randrange(-99999, 99999) / 100 for _ in range(rng.randrange(1, 90))] for _ in range(60)]
    rows = [(k, v) for k, g in enumerate(groups) for v in g]
    for parts in (1, 5):
        rng.shuffle(rows)
        got = dict(spark.createDataFrame(rows, "k int, v double").repartition(parts).groupBy("k").agg(mean(F.col("v"))).collect())
        assert got == {k: float(sum(Fraction(str(v)) for v in g) / len(g)) for k, g in enumerate(groups)}
    odd = {"null": [None], "part": [None, 3.0, 4.5], "nan": [1.0, math.nan], "inf": [1.0, math.inf], "huge": [1e300, 3e300], "long": [1 / 3, 1 / 7], "tiny": [1e-9, 4e-9], "zero": [0.0, -0.0], "none": [50.1, -50.1]}
    got = dict(spark.createDataFrame([(k, v) for k, g in odd.items() for v in g], "k string, v double").groupBy("k").agg(mean(F.col("v"))).collect())
    assert math.isnan(got.pop("nan")) and got == {"null": None, "part": 3.75, "inf": math.inf, "huge": 2e300, "long": pytest.approx(5 / 21, rel=1e-15), "tiny": pytest.approx(2.5e-9, rel=1e-15), "zero": 0.0, "none": 0.0}


_AT_THRESHOLD = {
    "rule_absolute": (1, [[83.19, 31.11, 117.15], [79.6, 4.0, 101.8], [69.78, 66.4, 128.09]]),
    "rule_catch_up": (-1, [[82.79, 64.45, 28.62], [18.73, 75.01, 1.87], [55.53, 37.27, 1.4]]),
}


@pytest.mark.parametrize("name", sorted(_AT_THRESHOLD))
def test_rule_at_its_threshold(spark, tmp_path, name):
    """Each group's last value is exactly at the threshold to its mean, which isn't over it, in whatever order
    the values are added; each sum of doubles says that it is. With a step beyond, it is over."""
    from quadtide import workload

    step, groups = _AT_THRESHOLD[name]
    users = [*groups, *([*g[:2], g[2] + step] for g in groups)]
    rows = [(10 * u + k, u, v) for u, g in enumerate(users) for k, v in enumerate(g)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").selectExpr("event_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts", "user_id", "'view' AS event_type", "value").write.parquet(str(tmp_path / "events.parquet"))
    got = {int(r["e"].split("/")[-1]) for r in workload.QUERIES[name](spark, str(tmp_path)).collect()}
    assert {e for e in got if e % 10 == 2} == {10 * u + 2 for u in range(len(groups), len(users))}
