"""URL filter: host-suffix and path-prefix expressions joined to rules on short hash prefixes.

A URL becomes the pairs of its host's suffixes (at label bounds) and its path's prefixes that end in
a slash, the empty prefix included. A rule is filed under its host and the part of its path up to
the last slash. Both sides meet in an equi-join on the first four bytes of a SHA-256; then the full
digest and the rest of the rule's path are confirmed, so short-prefix collisions change nothing.
Of the rules that fit, the longest (characters of host and path) wins; ties go to the longer host,
then to block. No more suffixes and prefixes are made than the deepest rule has, which leaves out
none that could match. All of it is built-in functions.

Defined cases: a null url or one without "://" has an empty host and path, and no rule fits; a null
page_id is kept; repeated rows stay repeated; rules with null parts are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many rules (about 200 bytes each) are broadcast; more are shuffled, with the URLs' side salted.
BROADCAST_RULES = 100_000
SALTS = 16


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, as this module's rules read them."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    upper, lower = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("abcdefghijklmnopqrstuvwxyz")
    low = F.call_function("translate", host, upper, lower)
    return F.coalesce(low, F.lit("")), F.coalesce(path, F.lit(""))


def _digest(host: Column, prefix: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), prefix), 256)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule and verdict of each row of pages. rules: host, path, verdict."""
    spark = pages.sparkSession
    host, path = F.col("host"), F.col("path")
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(
        F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).distinct()
    anchor = F.regexp_extract("rule_path", r"^(?s:.*)/", 0)
    rules = rules.withColumn("rule_digest", _digest(F.col("rule_host"), anchor)).withColumn("prefix", F.substring("rule_digest", 1, 8))
    n, labels, slashes = rules.agg(F.count(F.lit(1)), F.max(F.size(F.split("rule_host", r"\."))), F.max(F.size(F.split("rule_path", "/")) - 1)).first()
    urls = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).select("_id", *(c.alias(k) for c, k in zip(url_parts(F.col("_url")), ("host", "path"))))
    # a row's number: its expressions are made in one task, so the partial aggregate sends one row on
    urls = urls.withColumn("_row", F.monotonically_increasing_id())
    if not n:
        return urls.select(F.col("_id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    split_host, split_path = F.split(host, r"\."), F.split(path, "/")
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(split_host), F.lit(labels))), lambda k: F.array_join(F.slice(split_host, -k, k), "."))
    depth = F.least(F.size(split_path) - 1, F.lit(slashes))
    paths = F.transform(F.sequence(F.lit(0), depth), lambda k: F.when(k == 0, "").otherwise(F.concat(F.array_join(F.slice(split_path, 1, k), "/"), F.lit("/"))))
    exprs = urls.withColumn("_host", F.explode(hosts)).withColumn("_prefix", F.explode(paths)).withColumn("digest", _digest(F.col("_host"), F.col("_prefix"))).withColumn("prefix", F.substring("digest", 1, 8)).drop("_host", "_prefix")
    if n <= BROADCAST_RULES:
        met = exprs.join(F.broadcast(rules), "prefix", "left")
    else:
        salted = rules.withColumn("_salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
        met = exprs.withColumn("_salt", F.pmod("_row", F.lit(SALTS)).cast("int")).join(salted, ["prefix", "_salt"], "left")
    fits = (F.col("digest") == F.col("rule_digest")) & path.startswith(F.col("rule_path"))
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("long"), F.length("rule_host").alias("long_host"),
        (F.col("rule_verdict") == "block").cast("int").alias("blocks"), "rule_host", "rule_path", "rule_verdict")
    best = met.groupBy("_row").agg(*(F.first(c).alias(c) for c in ("_id", "host", "path")), F.max(F.when(fits, rank)).alias("best"))
    return best.select(F.col("_id").alias(id_col), "host", "path", F.concat("best.rule_host", "best.rule_path").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
