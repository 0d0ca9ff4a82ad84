"""Property-graph operators over two tables: nodes (key, label, …) and edges (src, dst, type, confidence, …).

Traversals never enumerate paths. Per hop they keep one row per node, the most confident way to it, and join it
to the edges; since no edge raises confidence, the best path of every length is among them. Depth is at most 5,
so the hops unroll into one lazy plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators import trigram

MAX_DEPTH = 5
#: Products of confidences are compared at this many decimals, so the order of multiplication cannot matter.
DIGITS = 9


class NodeNotFound(LookupError):
    """No node has the key asked for."""


def checked_depth(depth: int) -> int:
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be between 1 and {MAX_DEPTH}, not {depth}")
    return depth


def best_paths(edges: DataFrame, roots: DataFrame, depth: int, *, forward: bool) -> DataFrame:
    """(node, hops, confidence, route, via): per hop count, the most confident path between a root and each node.

    edges: (src, dst, type, confidence). roots: (node). forward follows edges from the roots; otherwise the nodes
    that reach a root are found. route runs from the root to the node. via holds the edge types in the direction
    of the edges. Roots are never results. Ties go to the smallest route.
    """
    checked_depth(depth)
    near, far = ("src", "dst") if forward else ("dst", "src")
    step = edges.select(F.col(near).alias("__near"), F.col(far).alias("__far"), F.col("type"), F.coalesce("confidence", F.lit(1.0)).alias("c")).where("__near <> __far")
    first = roots.select(F.col("node").alias("__root"))
    step = step.join(first, F.col("__far") == F.col("__root"), "left_anti")
    none = F.array().cast("array<string>")
    frontier = roots.select("node", F.lit(1.0).alias("confidence"), F.array(F.col("node").cast("string")).alias("route"), none.alias("via"))
    hops = []
    for hop in range(1, depth + 1):
        via = F.concat("via", F.array("type")) if forward else F.concat(F.array("type"), "via")
        moved = frontier.join(step, F.col("node") == F.col("__near")).select(
            F.col("__far").alias("node"), F.struct(F.round(-F.col("confidence") * F.col("c"), DIGITS).alias("r"), F.concat("route", F.array(F.col("__far").cast("string"))).alias("route"), via.alias("via"), (F.col("confidence") * F.col("c")).alias("confidence")).alias("w")
        )
        frontier = moved.groupBy("node").agg(F.min("w").alias("w")).select("node", "w.confidence", "w.route", "w.via")
        hops.append(frontier.withColumn("hops", F.lit(hop)))
    out = hops[0]
    for more in hops[1:]:
        out = out.unionByName(more)
    return out.select("node", "hops", "confidence", "route", "via")


def nearest(paths: DataFrame) -> DataFrame:
    """One row a node: fewest hops, then highest confidence, then smallest route."""
    best = F.min(F.struct("hops", F.round(-F.col("confidence"), DIGITS).alias("r"), "route", "via", "confidence")).alias("w")
    return paths.groupBy("node").agg(best).select("node", "w.hops", "w.confidence", "w.route", "w.via")


def dependencies(edges: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """What the roots reach over CALLS and IMPORTS."""
    return nearest(best_paths(edges.where(F.col("type").isin("CALLS", "IMPORTS")), roots, depth, forward=True))


def dependents(edges: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """What reaches the roots over CALLS and IMPORTS."""
    return nearest(best_paths(edges.where(F.col("type").isin("CALLS", "IMPORTS")), roots, depth, forward=False))


def neighbours(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """(node, hops, confidence, seed): the undirected CALLS neighbourhood of seeds, which are left out."""
    calls = edges.where(F.col("type") == "CALLS").select("src", "dst", "type", "confidence")
    both = calls.unionByName(calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "confidence"))
    found = nearest(best_paths(both, seeds, depth, forward=True))
    return found.select("node", "hops", "confidence", F.element_at("route", 1).alias("seed"))


def get_node(nodes: DataFrame, key: str) -> DataFrame:
    """The node with that key; raises NodeNotFound if there is none."""
    found = nodes.where(F.col("key") == key)
    if not found.take(1):
        raise NodeNotFound(key)
    return found


SEARCHED = ["qualname", "path", "name", "dotted_name"]


def search_nodes(nodes: DataFrame, query: str, limit: int = 25) -> DataFrame:
    """Nodes with the query as a literal in any case in qualname, path, name or dotted_name, shortest name first.

    The dotted name does not count in the order, so modules come first.
    """
    q = F.lower(F.lit(query))
    hit = F.lit(False)
    for c in SEARCHED:
        hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), q)
    return shortest_first(nodes.where(hit), limit)


def shortest_first(found: DataFrame, limit: int) -> DataFrame:
    shown = F.length(F.coalesce("qualname", "path", "name", F.lit("")))
    return found.withColumn("shown_length", shown).orderBy("shown_length", "key").limit(limit)


def index_nodes(nodes: DataFrame, path: str) -> None:
    """Writes the trigram index that search_index() reads."""
    trigram.build(nodes, SEARCHED, path)


def search_index(spark: SparkSession, path: str, query: str, limit: int = 25) -> DataFrame:
    """search_nodes() over indexed nodes: only the candidates of the query's rarest trigrams are read."""
    return shortest_first(trigram.search(spark, path, query, SEARCHED), limit)


def truncated(ordered: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """The first rows of an ordered table and whether there are more; one row beyond the limit is read."""
    return ordered.limit(limit), ordered.limit(limit + 1).count() > limit


def files_view(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, confidence): every File node with each of its imports, once with null where it has none."""
    files = nodes.where("label = 'File'").select(F.col("key").alias("src"))
    imports = edges.where("type = 'IMPORTS'").select("src", "dst", "confidence")
    return files.join(imports, "src", "left").select("src", "dst", "confidence")


def calls_view(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, confidence): calls that start at a Function node."""
    functions = nodes.where("label = 'Function'").select(F.col("key").alias("src"))
    return edges.where("type = 'CALLS'").join(functions, "src", "left_semi").select("src", "dst", "confidence")


def inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges both of whose ends are among the nodes."""
    keys = nodes.select("key")
    return edges.join(keys, edges.src == keys.key, "left_semi").join(keys, edges.dst == keys.key, "left_semi")


def collapse(nodes: DataFrame, edges: DataFrame, group: Column, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Groups of nodes with their sizes, and the edges between different groups merged with their number.

    types: node labels that stay; the caller keeps at least one.
    """
    shown = nodes if types is None else nodes.where(F.col("label").isin(types))
    member = shown.select("key", group.alias("grp"))
    groups = member.groupBy("grp").agg(F.count("*").alias("members"))
    a, b = member.select(F.col("key").alias("src"), F.col("grp").alias("src_group")), member.select(F.col("key").alias("dst"), F.col("grp").alias("dst_group"))
    merged = edges.join(a, "src").join(b, "dst").where("src_group <> dst_group").groupBy("src_group", "dst_group", "type").agg(F.count("*").alias("merged"))
    return groups, merged


def project_impact(items: DataFrame, member: DataFrame) -> DataFrame:
    """(grp, hops): the fewest hops at which a change reaches each visible group. member: (node, grp)."""
    return items.join(member, "node").groupBy("grp").agg(F.min("hops").alias("hops"))


def route_edges(items: DataFrame) -> DataFrame:
    """(src, dst): the distinct steps of the routes of the items, along the route."""
    steps = F.arrays_zip(F.slice("route", 1, F.size("route") - 1).alias("src"), F.slice("route", 2, F.size("route") - 1).alias("dst"))
    return items.where(F.size("route") > 1).select(F.explode(steps).alias("s")).select("s.src", "s.dst").distinct()


def aggregate_calls(sites: DataFrame) -> DataFrame:
    """Call sites (src, dst, resolution, confidence, line) as one edge a pair: the surest resolution, sorted distinct lines, their number."""
    best = F.max(F.struct("confidence", F.col("resolution")))
    own = ["repo"] if "repo" in sites.columns else []
    out = sites.groupBy(*own, "src", "dst").agg(best.alias("b"), F.array_sort(F.collect_set("line")).alias("lines"))
    return out.select(*own, "src", "dst", F.lit("CALLS").alias("type"), "b.confidence", "b.resolution", "lines", F.size("lines").alias("count"))


def serialise_edges(edges: DataFrame) -> DataFrame:
    """(type, source, target, resolution, confidence, count, line): edges as callers get them; what an edge lacks is null."""
    kinds = {"resolution": "string", "confidence": "double", "count": "long", "line": "int"}
    return edges.select("type", F.col("src").alias("source"), F.col("dst").alias("target"), *[(F.col(c) if c in edges.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


def last_wins(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The last row of each key in that order."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(o) if isinstance(o, str) else o.desc() for o in order])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def first_wins(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All rows of new, and those of old whose key is not in it. Same columns."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti"), allowMissingColumns=True)


def merge_properties(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both by key. New values replace old ones, also with null; what only old has (rows, columns) stays.

    So what another step set, such as the change_count of a file, outlives the next parse. Keys are unique on both sides.
    """
    theirs = [c for c in old.columns if c not in new.columns]
    kept = old.select(*key, F.struct(*[c for c in old.columns if c not in key]).alias("__old"))
    fresh = new.select(*key, F.struct(*[c for c in new.columns if c not in key]).alias("__new"))
    pick = lambda c: F.col(f"__new.{c}") if c not in old.columns else F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}"))
    out = fresh.join(kept, key, "full")
    return out.select(*key, *[pick(c).alias(c) for c in new.columns if c not in key], *[F.col(f"__old.{c}").alias(c) for c in theirs])


def repeated_keys(nodes: DataFrame, key: str = "key") -> DataFrame:
    """(key, n) of keys that more than one row has: none in a graph that keeps its constraint."""
    return nodes.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def sweep(rows: DataFrame, run_id: str, keep_label: str | None = "Repo", repos: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What stays after a run, and what it left behind: rows of another run or of none. Rows of keep_label stay.

    repos: (repo), those the run was about; rows of other repositories stay.
    """
    stale = F.col("run_id").isNull() | (F.col("run_id") != run_id)
    if repos is not None:
        rows = rows.join(repos.select("repo", F.lit(True).alias("__in_run")).distinct(), "repo", "left")
        stale = stale & F.col("__in_run").isNotNull()
    if keep_label and "label" in rows.columns:
        stale = stale & (F.col("label") != keep_label)
    return rows.where(~stale).drop("__in_run"), rows.where(stale).drop("__in_run")


def count_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count("*").alias("n"))


def count_relationships(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type", F.coalesce("resolution", F.lit("none")).alias("resolution")).agg(F.count("*").alias("n"))
