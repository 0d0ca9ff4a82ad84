"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import Written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a moves to the smallest of a and its neighbours."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("u"), F.col("b").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a, and a itself, moves to the smallest of them. Edges have u < v."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v")
    return (
        moved.where("u > m").select(F.col("m").alias("u"), F.col("u").alias("v"))
        .union(least.select(F.col("m").alias("u"), "v"))
        .distinct()
    )


def components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has a link: root is the smallest node it reaches.

    edges: (u, v), in either order, repeats and loops allowed. No node's neighbours are ever gathered in one
    place: each step takes minima (combined before the shuffle) and joins them back. Both steps keep the
    components, and at the fixed point every link is (root, node). Rounds grow with the logarithm of the
    longest path; each is written to the shared folder, so a lost executor never costs an earlier round.
    """
    keep = Written(spark)
    now = keep(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    k, seen = 0, None
    for _ in range(max_rounds):
        after = keep(_small_star(_large_star(now)))
        k += 1
        keep.drop(k - 1)
        now = after
        # Links between equal sets of nodes: the checksum stands still only at the fixed point of stars.
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
