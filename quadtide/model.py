"""The quad model: rows of (ts_ms, s, p, o, g) with the object's kind and number derived once.

A variable of a query is three columns: `x` (lexical form), `x__k` (kind) and `x__n` (number, for
numeric literals). Two terms are equal if lexical form and kind are. NULL means unbound, or an
expression error, so SQL's three-valued logic gives SPARQL's error tables.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IRI, DECIMAL, STRING, BOOLEAN, INTEGER, DATETIME = 0, 1, 2, 3, 4, 5
XSD = "http://www.w3.org/2001/XMLSchema#"
DATATYPES = {DECIMAL: "decimal", STRING: "string", BOOLEAN: "boolean", INTEGER: "integer", DATETIME: "dateTime"}
NUMERIC = (DECIMAL, INTEGER)

QUAD = T.StructType([
    T.StructField("ts_ms", T.LongType()),
    T.StructField("s", T.StringType()),
    T.StructField("p", T.StringType()),
    T.StructField("o", T.StringType()),
    T.StructField("g", T.StringType()),
    T.StructField("o_kind", T.ByteType()),
    T.StructField("o_num", T.DoubleType()),
])

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_SPECIAL = r"(?i)^[+-]?(inf|infinity|nan)$"


def parse_number(text: Column) -> Column:
    """The double that a lexical form denotes, NULL for any other text. Stricter than a cast, which
    takes "5d" and " 5 ", and without errors under ANSI rules."""
    low = F.lower(text)
    special = F.when(low.contains("nan"), F.lit(float("nan"))).when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(text.rlike(_NUMBER), text.try_cast("double")).when(text.rlike(_SPECIAL), special)


def is_iri(text: Column) -> Column:
    return text.startswith("http://") | text.startswith("https://")


#: An absolute IRI: a scheme, and no blanks, controls or characters that IRIs exclude.
_ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*:[^\x00-\x20<>\"{}|^`\\]*$"


def valid_iri(text: str) -> bool:
    return re.match(_ABSOLUTE[:-1] + r"\Z", text) is not None


def checked(quads: DataFrame) -> DataFrame:
    """Typed quads whose subject, predicate, graph or IRI object is no IRI are an error when they are read."""
    def sure(name: str, where: Column) -> Column:
        bad = F.raise_error(F.concat(F.lit(f"invalid IRI in {name}: "), F.col(name))).cast("string")
        return F.when(where & ~F.col(name).rlike(_ABSOLUTE), bad).otherwise(F.col(name)).alias(name)

    tests = {"s": F.lit(True), "p": F.lit(True), "g": F.col("g") != "", "o": F.col("o_kind") == IRI}
    return quads.select(*(sure(c, tests[c]) if c in tests else F.col(f"`{c}`") for c in quads.columns))


def typed(quads: DataFrame, live: bool = False) -> DataFrame:
    """Adds o_kind and o_num to rows of (ts_ms, s, p, o, g): an http(s) object is an IRI, one that
    reads as a number a decimal, anything else a string. Null or "default" graphs are the default graph.
    live: an http(s) object that is no valid IRI is a string, as in streams."""
    number, iri = parse_number(F.col("o")), is_iri(F.col("o"))
    if live:
        iri = iri & F.col("o").rlike(_ABSOLUTE)
    g = F.when(F.col("g").isNull() | (F.col("g") == "default"), "").otherwise(F.col("g"))
    kind = F.when(iri, IRI).when(number.isNotNull(), DECIMAL).otherwise(STRING).cast("tinyint")
    return quads.select(F.col("ts_ms").cast("long").alias("ts_ms"), "s", "p", "o", g.alias("g"), kind.alias("o_kind"), F.when(~iri, number).alias("o_num"))


def quads_of(spark, rows, kinds: dict[int, int] | None = None) -> DataFrame:
    """Quads of Python tuples (ts_ms, s, p, o, g)."""
    return typed(spark.createDataFrame(list(rows), "ts_ms long, s string, p string, o string, g string"))


def with_time(quads: DataFrame) -> DataFrame:
    """Adds ts, a TIMESTAMP, for streaming watermarks."""
    return quads.withColumn("ts", F.timestamp_millis("ts_ms"))


def number_text(n: Column) -> Column:
    """The shortest plain decimal text of a double; whole numbers have no point."""
    size = F.abs(n)
    whole = (n == F.floor(n)) & (size < 1e15)
    plain = (size >= 1e-3) & (size < 1e7)
    long = F.regexp_replace(n.try_cast("decimal(38,15)").cast("string"), r"\.?0+$", "")
    return F.when(F.isnan(n), "NaN").when(size == float("inf"), F.when(n > 0, "INF").otherwise("-INF")).when(whole, n.try_cast("bigint").cast("string")).when(plain, n.cast("string")).otherwise(F.coalesce(long, n.cast("string")))


def mean(n: Column) -> Column:
    """Aggregate: the mean of doubles, each taken as the decimal that its shortest text says, rounded once to a
    double; so it is the same whatever the order and the partitions of the rows, and a comparison
    with a threshold that a value meets exactly can't go either way. Where a value has more than 12 decimals or 12
    digits before them, or is no number, or all are under 0.001, the sum of doubles has to do, whose last bits depend
    on the order."""
    d = n.try_cast("decimal(24,12)")
    exact = (F.count(n) == F.count(F.when(d.cast("double") == n, 1))) & (F.max(F.abs(n)) >= 1e-3)
    quotient = F.try_divide(F.try_sum(d).try_cast("decimal(30,12)"), F.count(n).cast("decimal(18,0)"))  # 20 decimals
    return F.coalesce(F.when(exact, quotient.cast("double")), F.avg(n))


def escaped(text: Column) -> Column:
    r = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    r = F.replace(r, F.lit('"'), F.lit('\\"'))
    return F.replace(F.replace(r, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def ntriples(lex: Column, kind: Column) -> Column:
    """A term in N-Triples syntax."""
    quoted = F.concat(F.lit('"'), escaped(lex), F.lit('"'))
    out = F.when(kind == IRI, F.concat(F.lit("<"), lex, F.lit(">"))).when(kind == STRING, quoted)
    for k, name in DATATYPES.items():
        if k != STRING:
            out = out.when(kind == k, F.concat(quoted, F.lit(f"^^<{XSD}{name}>")))
    return out
