import pytest

from quadtide.errors import QueryParseError
from quadtide.plans.ast import Call, Filter, Triple, Var, WindowPattern
from quadtide.plans.hybrid import split
from quadtide.plans.parser import parse_hybrid, parse_sparql

P = "PREFIX ex: <http://e/>\nPREFIX : <http://d/>\n"


def test_live_only():
    q = parse_hybrid(P + "REGISTER RStream ex:out AS SELECT * FROM NAMED WINDOW ex:w ON STREAM ex:s [RANGE 1000 STEP 100] WHERE { WINDOW ex:w { ?a ?b ?c } }")
    assert q.operator == "RStream" and q.name == "http://e/out"
    (w,) = q.live_windows
    assert (w.width, w.slide, w.stream) == (1000, 100, "http://e/s") and not q.historical_windows


def test_three_kinds_and_multi_line_clause():
    q = parse_hybrid(P + """REGISTER RStream ex:out AS
SELECT ?s ?v
FROM NAMED WINDOW :live ON STREAM ex:s
   [RANGE 5000
    STEP 1000]
FROM NAMED WINDOW :slide ON LOG ex:log [OFFSET 3600000 RANGE 60000 STEP 10000]
FROM NAMED WINDOW :fixed ON STREAM ex:s [START 10 END 20]
USING BASELINE :slide LAST
WHERE { WINDOW :live { ?s ex:p ?v } WINDOW :slide { ?s ex:p ?m } WINDOW :fixed { ?s ex:p ?f } }""")
    kinds = {w.name: w.kind for w in q.windows}
    assert kinds == {"http://d/live": "live", "http://d/slide": "sliding", "http://d/fixed": "fixed"}
    assert q.baseline.window == "http://d/slide" and q.baseline.mode == "last"
    parts = split(q)
    assert [w.name for w, _ in parts.historical] == ["http://d/slide", "http://d/fixed"]
    # projected items are those that mention a variable of the body
    assert [i.name for i in parts.historical[0][1].items] == ["s"]
    assert [i.name for i in parts.live.items] == ["s", "v"]


def test_nested_braces_and_static_patterns_stay_live():
    q = parse_hybrid(P + """SELECT ?s FROM NAMED WINDOW :l ON STREAM ex:s [RANGE 10 STEP 5] FROM NAMED WINDOW :h ON LOG ex:g [START 0 END 9]
WHERE { WINDOW :l { ?s ex:p ?v . FILTER NOT EXISTS { ?s ex:bad ?x . { ?x ex:y ?z } } } WINDOW :h { ?s ex:q ?o } ?s ex:room ?r . FILTER(?v > 3) }""")
    live = split(q).live.where.parts
    assert any(isinstance(p, Triple) for p in live) and any(isinstance(p, Filter) for p in live)
    assert [p.window for p in live if isinstance(p, WindowPattern)] == ["http://d/l"]


@pytest.mark.parametrize("text", [
    "SELECT ?s FROM NAMED WINDOW :h ON LOG ex:g [RANGE 10 STEP 5] WHERE { WINDOW :h { ?s ?p ?o } }",  # a log needs OFFSET
    "SELECT ?s FROM NAMED WINDOW :l ON STREAM ex:g [RANGE 10 STEP 0] WHERE { WINDOW :l { ?s ?p ?o } }",
    "SELECT ?s FROM NAMED WINDOW :l ON STREAM ex:g [RANGE 10 STEP 5] USING BASELINE :nope LAST WHERE { WINDOW :l { ?s ?p ?o } }",
    "SELECT ?s FROM NAMED WINDOW :l ON STREAM ex:g [RANGE 10 STEP 5] WHERE { WINDOW :other { ?s ?p ?o } }",
    "SELECT ?s FROM NAMED WINDOW nope:l ON STREAM ex:g [RANGE 10 STEP 5] WHERE { }",
    "this is not a query",
    "SELECT ?s FROM NAMED WINDOW :f ON LOG ex:g [START 9 END 1] WHERE { WINDOW :f { ?s ?p ?o } }",
])
def test_errors(text):
    with pytest.raises(QueryParseError):
        parse_hybrid(P + text)


def test_window_names_are_compared_expanded():
    q = parse_hybrid(P + "SELECT ?s FROM NAMED WINDOW ex:w ON STREAM ex:s [RANGE 9 STEP 3] WHERE { WINDOW <http://e/w> { ?s ?p ?o } }")
    assert q.windows[0].name == "http://e/w"


def test_comments_literals_and_modifiers():
    q = parse_sparql(P + """# a comment with { and }
SELECT DISTINCT ?s (COUNT(*) AS ?n) WHERE { /* block */ ?s ex:p "a } brace"@en , 'x\\n' , 4.5e3 , true ; a ex:T . }
GROUP BY ?s HAVING (COUNT(*) > 1) ORDER BY DESC(?n) ?s LIMIT 3 OFFSET 1""")
    assert q.distinct and q.limit == 3 and q.offset == 1 and len(q.where.parts) == 5
    assert q.where.parts[1].o.lex == "x\n" and q.where.parts[2].o.num == 4500.0
    assert q.order_by[0][1] is False and q.order_by[1] == (Var("s"), True)


@pytest.mark.parametrize("text", ["SELECT", "SELECT ?s WHERE { ?s ?p }", "SELECT ?s WHERE { ?s ?p ?o", "SELECT (COUNT(?s) ?n) { ?s ?p ?o }", "SELECT ?s { ?s nope:p ?o }", "FROM x"])
def test_invalid_sparql(text):
    with pytest.raises(QueryParseError):
        parse_sparql(text)


def test_precedence():
    f = parse_sparql("SELECT ?s { ?s ?p ?o FILTER(!bound(?x) || ?o + 2 * 3 >= 7 && ?o != 4) }").where.parts[1].expr
    assert f.name == "or" and f.args[1].name == "and" and f.args[1].args[0].args[0] == Call("+", [Var("o"), Call("*", [f.args[1].args[0].args[0].args[1].args[0], f.args[1].args[0].args[0].args[1].args[1]])])
