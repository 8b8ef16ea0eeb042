"""Connected components of an edge table by large-star and small-star steps.

Edges are (a, b) over any orderable type. Every step is a join and an
aggregation; neighbours of a node are never gathered. Each round is written to
the shared folder, and one row (count and checksum) tells whether it changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaspark.llm.common import materialize



def _written(least: DataFrame) -> DataFrame:
    """Written, so that the join with it is one of two plain exchanges: Spark
    splits a node with very many neighbours over tasks."""
    return materialize(least, "cc-least")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest one (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return (both.where(F.col("b") > F.col("a")).join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """A node's smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = _written(down.groupBy("a").agg(F.min("b").alias("m")))
    return (down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .where("a <> b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node."""
    now = materialize(edges.select("a", "b").where("a <> b").distinct(), "cc")
    seen = None
    while True:
        now = materialize(_small_star(materialize(_large_star(now), "cc")), "cc")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 31))).first()
        if mark == seen:
            break
        seen = mark
    return (now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
