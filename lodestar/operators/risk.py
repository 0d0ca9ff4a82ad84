"""Risk of changing a node, 0 to 100, from its place in the graph, its tests and its history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.scoring import WEIGHTS, band, factors, is_test_path, reasons, weight
from lodestar.operators.bitmaps import dependents_within
from lodestar.operators.graph import checked_depth, get_node

CONTAINED = 4


def reach(edges: DataFrame, depth: int, to: DataFrame) -> DataFrame:
    """(src, dst): the pairs with a path of 1 to depth edges, each once, without loops. Distinct after every hop.

    to: (key), the few ends asked for. Paths grow backwards from the ends, so what does not lead to them is never touched;
    a node that very many paths cross is split by the adaptive plan's skew join.
    """
    checked_depth(depth)
    step = edges.select("src", "dst").where("src <> dst").distinct()
    first = step.join(to.select(F.col("key").alias("dst")).distinct(), "dst", "left_semi")
    seen = frontier = first.select("src", "dst")
    before = step.select(F.col("src").alias("far"), F.col("dst").alias("src"))
    for _ in range(depth - 1):
        frontier = frontier.join(before, "src").select(F.col("far").alias("src"), "dst").where("src <> dst").distinct()
        seen = seen.union(frontier)
    return seen.distinct()


def owners(contains: DataFrame, files: DataFrame, levels: int = CONTAINED) -> DataFrame:
    """(node, file): the file that holds a node over at most `levels` CONTAINS edges; a file holds itself."""
    own = files.select(F.col("key").alias("node"), F.col("key").alias("file"))
    step = contains.select(F.col("src").alias("node"), "dst")
    found = frontier = own
    for _ in range(levels):
        frontier = frontier.join(step, "node").select(F.col("dst").alias("node"), "file")
        found = found.union(frontier)
    return found.groupBy("node").agg(F.min("file").alias("file"))


def metrics(nodes: DataFrame, edges: DataFrame, contains: DataFrame, files: DataFrame, partners: DataFrame, depth: int = 2, only: bool = False) -> DataFrame:
    """One row a node: the counts that the score is made of, all of distinct nodes.

    nodes: (key). edges: calls and imports (src, dst, type). contains: (src, dst). files: (key, path, change_count),
    change_count null where the history was not read. partners: (file, jaccard), a row for each side of a pair.
    only: nodes are few of many, and only what leads to them is walked. Otherwise the dependents of all nodes are
    counted in bitmaps, without a row for each pair.
    """
    links = edges.where(F.col("type").isin("CALLS", "IMPORTS"))
    near = links.select("src", "dst").where("src <> dst").distinct()
    owner = owners(contains, files)
    in_tests = owner.join(files.select(F.col("key").alias("file"), "path"), "file").where(is_test_path(F.col("path"))).select(F.col("node").alias("src"))
    tests = edges.where("type = 'CALLS'").select("src", "dst").distinct().join(in_tests, "src", "left_semi")
    # Every count is a row (key, which, n), so that one grouping by key takes them all.
    parts = [("direct_dependents", near, "dst"), ("dependencies", near, "src"), ("test_references", tests, "dst")]
    counted = None
    if only:
        parts.append(("dependents", reach(links, depth, nodes), "dst"))
    else:
        checked_depth(depth)
        counted = dependents_within(links, depth).select("key", F.lit("dependents").alias("which"), F.col("dependents").alias("n"))
    for name, rows, end in parts:
        one = rows.groupBy(F.col(end).alias("key")).agg(F.count("*").alias("n")).select("key", F.lit(name).alias("which"), "n")
        counted = one if counted is None else counted.unionAll(one)
    counts = counted.groupBy("key").agg(*[F.sum(F.when(F.col("which") == name, F.col("n"))).alias(name) for name in ("dependents", "direct_dependents", "dependencies", "test_references")])
    coupled = partners.groupBy("file").agg(F.count("*").alias("co_partners"), F.max("jaccard").alias("max_jaccard"))
    of_file = files.select(F.col("key").alias("file"), "path", "change_count").join(coupled, "file", "left")
    all_ = nodes.select("key").join(owner.withColumnRenamed("node", "key"), "key", "left").join(counts, "key", "left").join(of_file, "file", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("dependents", "direct_dependents", "dependencies", "test_references", "co_partners")]
    return all_.select("key", "path", *zero, F.coalesce("max_jaccard", F.lit(0.0)).alias("max_jaccard"), F.col("change_count").cast("long").alias("change_count"))


def score_node(nodes: DataFrame, key: str, edges: DataFrame, contains: DataFrame, files: DataFrame, partners: DataFrame, depth: int = 2) -> DataFrame:
    """The score of one node, from what leads to it alone; NodeNotFound if there is no such node."""
    return score(metrics(get_node(nodes, key), edges, contains, files, partners, depth, only=True))


def score(counted: DataFrame) -> DataFrame:
    """Adds score, band, factors, weights and reasons to metrics()."""
    made = factors()
    total = sum((made[f] * weight(f) for f in WEIGHTS), F.lit(0.0))
    scored = counted.withColumn("score", F.round(F.lit(100.0) * total, 1))
    entries = lambda of: F.map_filter(F.create_map(*[x for f in WEIGHTS for x in (F.lit(f), of(f))]), lambda _, v: v.isNotNull())
    return scored.select(
        "*", band(F.col("score")).alias("band"), entries(lambda f: F.round(made[f], 4)).alias("factors"), entries(lambda f: F.when(weight(f) > 0, F.round(weight(f), 4))).alias("weights"), reasons().alias("reasons")
    )


def rank(scored: DataFrame, limit: int | None = None) -> DataFrame:
    """Riskiest first; every node is scored before the limit."""
    out = scored.orderBy(F.desc("score"), "key")
    return out if limit is None else out.limit(limit)


def risk_colours(nodes: DataFrame, scored: DataFrame) -> DataFrame:
    """(key, band), 'unscored' where a node has no score."""
    return nodes.select("key").join(scored.select("key", "band"), "key", "left").select("key", F.coalesce("band", F.lit("unscored")).alias("band"))


def dashboard(scored: DataFrame) -> DataFrame:
    """One row: nodes, critical ones, the highest score."""
    return scored.agg(F.count("*").alias("nodes"), F.count_if(F.col("band") == "critical").alias("critical"), F.coalesce(F.max("score"), F.lit(0.0)).alias("max_score"))


def bar_widths(scored: DataFrame) -> DataFrame:
    """(key, width): the score in percent of the highest one."""
    top = scored.agg(F.max("score").alias("top"))
    return scored.select("key", "score").join(F.broadcast(top)).select("key", F.round(F.when(F.col("top") > 0, 100.0 * F.col("score") / F.col("top")).otherwise(0.0), 2).alias("width"))
