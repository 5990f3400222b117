"""N-Triples and N-Quads text: one projection of regular-expression groups over lines.

A line is `[timestamp] <s> <p> (<iri> | "literal"[^^<datatype> | @lang]) [<g>] .` Blank lines and
lines that begin with # are skipped. A missing timestamp becomes the time of reading. Datatype and
language are not kept; escapes stay as written. A graph that isn't an IRI is the default graph.
"""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryParseError
from ..model import typed

LINE = (
    r'^\s*(?:([0-9]+)\s+)?<([^>]*)>\s*<([^>]*)>\s*'
    r'(?=([<"]))(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:\s*\^\^\s*<[^>]*>|\s*@[A-Za-z0-9-]+)?)'
    r'\s*(?:<([^>]*)>)?.*$'
)
_LINE = re.compile(LINE, re.S)
_SKIPPED = r"^\s*(#.*)?$"
_MAX_TIME = 2**63 - 1
#: A control character that lines don't have, as a rule.
_MARK = "\x01"


def parse_line(line: str, now_ms: int | None = None) -> tuple[int, str, str, str, str]:
    """(ts_ms, s, p, o, g) of one line; QueryParseError if it can't be read."""
    m = _LINE.match(line.strip().rstrip("."))
    if not m:
        body = re.sub(r"^\s*[0-9]+\s+", "", line.strip().rstrip(".")).strip()
        if re.match(r"<[^>]*>\s*<[^>]*>", body):
            raise QueryParseError(f"Invalid object format: {line!r}")
        raise QueryParseError(f"not a quad: {line!r}")
    ts, s, p, _, iri, literal, g = m.groups()
    now = now_ms if now_ms is not None else int(time.time() * 1000)
    return int(ts) if ts and int(ts) <= _MAX_TIME else now, s, p, iri if iri is not None else literal, g or ""


def parse_lines(lines: DataFrame, column: str = "value", now_ms: int | None = None) -> DataFrame:
    """Adds ts_ms, s, p, o, g and error (NULL for a good line) to a DataFrame of lines; batch or
    streaming. Skipped lines are gone."""
    now = F.lit(now_ms).cast("long") if now_ms is not None else (F.unix_millis(F.current_timestamp()))
    line = F.regexp_replace(F.trim(F.col(column)), r"\.+\s*$", "")
    # one match a line: its groups are put between marks and cut there; a line that has the mark is matched group by group
    marked = F.regexp_replace(line, LINE, _MARK + _MARK.join(f"${k}" for k in range(1, 8)))
    plain = ~line.contains(_MARK)
    groups = F.when(plain & marked.startswith(_MARK), F.split(marked, _MARK)).when(~plain & line.rlike(LINE), F.array(F.lit(""), *(F.regexp_extract(line, LINE, k) for k in range(1, 8))))
    kept = lines.where(~F.col(column).rlike(_SKIPPED)).withColumn("_groups", groups)
    group = lambda k: F.col("_groups")[k]
    good = F.col("_groups").isNotNull()
    return kept.select(
        *(F.col(f"`{c}`") for c in lines.columns),
        F.when(good, F.coalesce(group(1).try_cast("long"), now)).alias("ts_ms"),
        group(2).alias("s"),
        group(3).alias("p"),
        F.when(group(4) == '"', group(6)).otherwise(group(5)).alias("o"),
        group(7).alias("g"),
        F.when(~good, F.concat(F.lit("Invalid line: "), F.col(column))).alias("error"),
    )


def read_nquads(spark: SparkSession, path: str, now_ms: int | None = None) -> DataFrame:
    """Typed quads of a file or folder; bad lines are left out (see bad_lines)."""
    return typed(parse_lines(spark.read.text(path), now_ms=now_ms).where("error IS NULL"))


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that can't be read, with the reason."""
    return parse_lines(spark.read.text(path)).where("error IS NOT NULL").select(F.col("value").alias("line"), "error")


def stream_nquads(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """Typed quads of the files that appear in a folder, as a stream."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return typed(parse_lines(lines).where("error IS NULL"))


def to_line(quads: DataFrame, timestamps: bool = True) -> DataFrame:
    """The N-Quads line of each quad, as a column `value`."""
    obj = F.when(F.col("o_kind") == 0, F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(F.concat(F.lit('"'), "o", F.lit('"')))
    graph = F.when(F.col("g") != "", F.concat(F.lit(" <"), "g", F.lit(">"))).otherwise("")
    ts = F.concat(F.col("ts_ms").cast("string"), F.lit(" ")) if timestamps else F.lit("")
    return quads.select(F.concat(ts, F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), obj, graph, F.lit(" .")).alias("value"))
