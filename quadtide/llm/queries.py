"""The queries of the operators: (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chroma, lattice, minhash, packing, pii, quality, tokenbin, urlfilter, warc
from .common import read_table
from .sql import ORACLES

#: Fixed values of the URL query: (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(read_table(spark, sf_dir, "pages"), min_revisit=0)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are those of base spans, which the contract's patterns fix; spans has all, and the counts of
    all follow."""
    found = pii.detect(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(F.col(f"base_{k}").alias(f"n_{k}") for k in pii.KINDS), "base_sha256", "spans", *(F.col(f"n_{k}").alias(f"all_{k}") for k in pii.KINDS))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return urlfilter.judge(pages, spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=4, percent=80)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenbin.write_and_read(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op7_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(read_table(spark, sf_dir, "embeddings"), least=0.98)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op10_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tunes made from every row of embeddings; those whose id is divisible by 100 are the queries.
    A row for each recording and one for each match of two classes."""
    tunes = chroma.recordings(read_table(spark, sf_dir, "embeddings"))
    return chroma.listing(*chroma.search(chroma.fingerprints(tunes, "rec_id", "media"), "rec_id % 100 = 0"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_quality": op1_quality,
    "op2_warc": op2_warc,
    "op3_pii": op3_pii,
    "op4_url_filter": op4_url_filter,
    "op5_token_files": op5_token_files,
    "op6_minhash": op6_minhash,
    "op7_lattice": op7_lattice,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_packing": op9_packing,
    "op10_chroma": op10_chroma,
    "pipeline": pipeline,
}
