"""Connected components of an edge list by alternating large-star and small-star steps (Kiveris et al.)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest one (itself included)."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and itself are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of comparable node ids -> (node, component), the smallest node of each component; stars are final.

    Nodes without an edge are not returned; loops and repeated edges do no harm, null ends are dropped. Each round is
    written to the shared folder and the rounds end when a round changes nothing, which takes a logarithmic number of
    them in practice. A node with many neighbours stays cheap as minima are combined before they are shuffled.
    """
    edges = written(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == last or not seen[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        last = seen
        before, edges = edges, written(_small_star(_large_star(edges).distinct()).distinct(), "edges")
        discard(before)
