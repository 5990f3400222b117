import pytest
from pyspark.sql import functions as F

from quadtide import sparql
from quadtide.errors import QueryParseError, UnsupportedError
from quadtide.model import quads_of

E = "http://e/"
P = f"PREFIX e: <{E}> PREFIX fn: <https://any.example/fn#> "


@pytest.fixture(scope="module")
def people(spark):
    """Four triples: ages are plain strings, as the adapter fixtures have them."""
    rows = [(0, E + "alice", E + "knows", E + "bob", "", 0, None), (0, E + "bob", E + "knows", E + "charlie", "", 0, None), (0, E + "alice", E + "age", "30", "", 2, None), (0, E + "bob", E + "age", "25", "", 2, None)]
    return spark.createDataFrame(rows, "ts_ms long, s string, p string, o string, g string, o_kind int, o_num double").withColumn("o_kind", F.col("o_kind").cast("tinyint")).cache()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_pinned_counts(people):
    run = lambda t: sparql.query(people, P + t)
    assert run("SELECT ?s ?p ?o { ?s ?p ?o }").count() == 4
    assert run("SELECT ?s { ?s e:knows ?o }").count() == 2
    assert rows(run('SELECT ?s { ?s e:age ?a FILTER(?a > "25") }')) == [(E + "alice",)]
    assert rows(run("SELECT (COUNT(?s) AS ?n) { ?s e:knows ?o }")) == [("2",)]
    assert sparql.query(people, P + "SELECT (COUNT(?s) AS ?n) { ?s e:knows ?o }", "ntriples").first()["n"] == '"2"^^<http://www.w3.org/2001/XMLSchema#integer>'
    assert sparql.ask(people, P + "ASK { e:alice e:knows e:bob }") and not sparql.ask(people, P + "ASK { e:bob e:knows e:alice }")
    assert run("CONSTRUCT { ?b e:knownBy ?a } WHERE { ?a e:knows ?b }").count() == 2
    assert rows(run("SELECT ?s { ?s e:age ?a FILTER(fn:absolute_threshold_exceeded(?a, 25, 2)) }")) == [(E + "alice",)]
    assert rows(run("SELECT ?s { ?s e:age ?a FILTER(fn:absolute_threshold_exceeded(?a, 25)) }")) == []  # wrong arity
    assert rows(run("SELECT ?s { ?s e:knows ?a FILTER(fn:absolute_threshold_exceeded(?a, 25, 2)) }")) == []  # an IRI
    assert rows(run("SELECT ?s { ?s e:none ?o }")) == []


def test_ntriples_style(people):
    got = sparql.query(people, P + "SELECT ?s ?a { ?s e:age ?a } ORDER BY ?a", "ntriples").collect()
    assert [tuple(r) for r in got] == [(f"<{E}bob>", '"25"'), (f"<{E}alice>", '"30"')]


def test_unbound_joins(spark):
    q = quads_of(spark, [(0, E + "a", E + "p", "1", ""), (0, E + "b", E + "p", "2", ""), (0, E + "a", E + "q", "7", ""), (0, E + "x", E + "r", "7", ""), (0, E + "y", E + "r", "8", "")])
    # ?v is unbound for b, so it joins with every r
    got = rows(sparql.query(q, P + "SELECT ?s ?z ?v { ?s e:p ?o OPTIONAL { ?s e:q ?v } ?z e:r ?v }"))
    assert got == [(E + "a", E + "x", "7"), (E + "b", E + "x", "7"), (E + "b", E + "y", "8")]
    assert rows(sparql.query(q, P + "SELECT ?s { ?s e:p ?o OPTIONAL { ?s e:q ?v } FILTER(!BOUND(?v)) }")) == [(E + "b",)]
    assert rows(sparql.query(q, P + "SELECT ?s { ?s e:p ?o MINUS { ?z e:nothing ?w } }")) == [(E + "a",), (E + "b",)]
    assert rows(sparql.query(q, P + "SELECT ?s ?v { VALUES (?s ?v) { (e:a UNDEF) (UNDEF 8) } ?s e:r|e:p ?v }")) == [(E + "a", "1"), (E + "y", "8")]


def test_errors_are_unbound(spark):
    q = quads_of(spark, [(0, E + "a", E + "p", "0", ""), (0, E + "b", E + "p", "x", ""), (0, E + "c", E + "p", "4", "")])
    assert rows(sparql.query(q, P + "SELECT ?s ?r { ?s e:p ?o BIND(8 / ?o AS ?r) }")) == [(E + "a", None), (E + "b", None), (E + "c", "2")]
    # an error or true is true; an error and false is false
    assert rows(sparql.query(q, P + "SELECT ?s { ?s e:p ?o FILTER(8 / ?o = 2 || ?o = 0) }")) == [(E + "a",), (E + "c",)]
    assert rows(sparql.query(q, P + "SELECT (SUM(?o) AS ?t) (COUNT(?o) AS ?n) { ?s e:p ?o }")) == [(None, "3")]
    assert rows(sparql.query(q, P + "SELECT (SUM(?o) AS ?t) (AVG(?o) AS ?m) { ?s e:none ?o }")) == [("0", "0")]


def test_cycle_paths_end(spark):
    q = quads_of(spark, [(0, E + a, E + "n", E + b, "") for a, b in ("ab", "bc", "ca", "cd")])
    assert len(rows(sparql.query(q, P + "SELECT ?x ?y { ?x e:n+ ?y }"))) == 12
    assert rows(sparql.query(q, P + "SELECT ?y { e:a e:n* ?y }")) == [(E + x,) for x in "abcd"]
    assert rows(sparql.query(q, P + "SELECT ?x { ?x e:n? e:d }")) == [(E + "c",), (E + "d",)]
    assert rows(sparql.query(q, P + "SELECT ?x { ?x (e:n/e:n) e:d }")) == [(E + "b",)]


def test_graphs(spark):
    q = quads_of(spark, [(0, E + "a", E + "p", "1", E + "g1"), (0, E + "a", E + "q", "2", E + "g2"), (0, E + "b", E + "p", "3", E + "g1"), (0, E + "b", E + "q", "4", E + "g1"), (0, E + "c", E + "p", "5", "default")])
    assert rows(sparql.query(q, P + "SELECT ?s ?g { GRAPH ?g { ?s e:p ?x ; e:q ?y } }")) == [(E + "b", E + "g1")]
    assert rows(sparql.query(q, P + "SELECT ?s { GRAPH e:g2 { ?s ?p ?o } }")) == [(E + "a",)]
    assert rows(sparql.query(q, P + "SELECT ?s { ?s ?p ?o }")) == [(E + "c",)]


def test_order_and_slices(spark):
    q = quads_of(spark, [(0, E + "a", E + "p", "10", ""), (0, E + "a", E + "p", "9", ""), (0, E + "a", E + "p", "x", ""), (0, E + "a", E + "p", "http://z", "")])
    got = [r["o"] for r in sparql.query(q, P + "SELECT ?o { ?s e:p ?o } ORDER BY ?o").collect()]
    assert got[0] == "http://z" and got.index("9") < got.index("10")
    assert [r["o"] for r in sparql.query(q, P + "SELECT ?o { ?s e:p ?o FILTER(isNumeric(?o)) } ORDER BY DESC(?o) LIMIT 1").collect()] == ["10"]


def test_invalid(people):
    with pytest.raises(QueryParseError):
        sparql.query(people, "SELECT WHERE {")
    with pytest.raises(QueryParseError):
        sparql.query(people, P + "SELECT ?s { ?s ?p ?o FILTER(e:unknown(?o)) }")
    with pytest.raises(UnsupportedError):
        sparql.query(people, P + "SELECT (BNODE() AS ?b) { ?s ?p ?o }")


def test_pushdown(spark, tmp_path):
    q = quads_of(spark, [(k, E + "a", E + f"p{k % 3}", str(k), "") for k in range(10)])
    q.write.parquet(str(tmp_path / "q"))
    plan = sparql.query(spark.read.parquet(str(tmp_path / "q")), P + "SELECT ?s ?o { ?s e:p1 ?o FILTER(?o > 4) }")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p,http://e/p1)" in plan and "GreaterThan(o" in plan and "ts_ms" not in plan.split("ReadSchema")[1]
