"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(id, comp) for every end of an edge (a, b); comp is the least id that it reaches.

    Every round takes the least label among neighbours, then jumps to the label's own label, so the
    number of rounds is about the logarithm of the longest shortest path. Labels and edges are
    written tables, read by sort-merge joins whose skewed partitions the engine can split; only the
    number of changed labels comes to the driver.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), f"{label}-edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")), f"{label}-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("comp").alias("near"))
        stepped = labels.join(near, labels.id == near.a).select("id", F.col("comp").alias("was"), F.least("comp", "near").alias("mid"))
        jump = labels.select(F.col("id").alias("at"), F.col("comp").alias("beyond"))
        after = materialize(stepped.join(jump, F.col("mid") == F.col("at"), "left").select("id", "was", F.least("mid", F.coalesce("beyond", "mid")).alias("comp")), f"{label}-{turn}")
        discard(labels)
        if not after.where("comp != was").limit(1).count():
            discard(both)
            return after.select("id", "comp")
        labels = after.select("id", "comp")
        labels._quadtide_path = after._quadtide_path
