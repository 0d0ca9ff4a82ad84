"""Simple cycles of a directed graph: strongly connected components first, then two half-paths that meet.

Components come from labels: in rounds every node learns the smallest node that reaches it and the smallest one that it
reaches. Edges between nodes of different labels are in no cycle and go. Nodes whose two labels are one node are its
component; the others are labelled again among themselves, until none is left.
Each round also takes the label of its label, so labels travel in doubling steps along long chains.

A cycle of k edges is ceil(k/2) steps ahead of its smallest member and floor(k/2) steps back to it. Both halves are walked
from every start over larger nodes only, and meet in a join on (start, end): a path of more than half the longest cycle is
never built, and whatever can't return to its start meets nothing. All of it runs over numbers of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lodestar.operators.bitmaps import numbered
from lodestar.plans.written import Written

MAX_CYCLE = 6
MAX_ROUNDS = 10_000


def _labels(edges: DataFrame, keep: Written) -> DataFrame:
    """(way, node, label): the smallest node that reaches a node ('to') and that it reaches ('from'), itself included."""
    step = keep(
        edges.select(F.lit("to").alias("way"), F.col("src").alias("near"), F.col("dst").alias("node"))
        .union(edges.select(F.lit("from").alias("way"), F.col("dst").alias("near"), F.col("src").alias("node")))
    )
    now = keep(step.select("way", "node", F.col("node").alias("label")).union(step.select("way", "near", "near")).distinct())
    for _ in range(MAX_ROUNDS):
        heard = step.join(now.select("way", F.col("node").alias("near"), "label"), ["way", "near"]).groupBy("way", "node").agg(F.min("label").alias("heard"))
        after = now.join(heard, ["way", "node"], "left").select("way", "node", F.col("label").alias("old"), F.least("label", F.coalesce("heard", "label")).alias("label"))
        further = now.select("way", F.col("node").alias("label"), F.col("label").alias("further"))
        seen = Observation()
        after = after.join(further, ["way", "label"]).select("way", "node", "old", F.least("label", "further").alias("label")).observe(seen, F.count_if(F.col("old") != F.col("label")).alias("moved"))
        now = keep(after.select("way", "node", "label", "old")).drop("old")
        if not seen.get["moved"]:
            return now
    raise RuntimeError(f"labels did not settle in {MAX_ROUNDS} rounds")


def within_components(edges: DataFrame, keep: Written | None = None) -> DataFrame:
    """(src, dst): the distinct edges, without loops, that lie inside a strongly connected component."""
    keep = keep or Written(edges.sparkSession)
    rest, inside = keep(edges.select("src", "dst").where("src <> dst").distinct()), None
    while inside is None or not rest.isEmpty():
        of = _labels(rest, keep).groupBy("node").agg(F.min(F.when(F.col("way") == "to", F.col("label"))).alias("to"), F.min(F.when(F.col("way") == "from", F.col("label"))).alias("from_"))
        a, b = of.select(F.col("node").alias("src"), F.struct("to", "from_").alias("a")), of.select(F.col("node").alias("dst"), F.struct("to", "from_").alias("b"))
        same = keep(rest.join(a, "src").join(b, "dst").where("a = b").select("src", "dst", (F.col("a.to") == F.col("a.from_")).alias("settled")))
        # A node that one node reaches and that reaches it is in that node's component: nothing to label again.
        settled, rest = same.where("settled").drop("settled"), same.where("not settled").drop("settled")
        inside = settled if inside is None else inside.union(settled)
    return inside


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the nodes of strongly connected components of two nodes and more, with the smallest of them."""
    keep = Written(edges.sparkSession)
    return _labels(within_components(edges, keep), keep).where("way = 'to'").select("node", F.col("label").alias("component"))


def _by_number(edges: DataFrame, keep: Written) -> tuple[DataFrame, DataFrame]:
    """The distinct edges without loops between the numbers of their ends, and (key, n), numbers in order of keys."""
    step = keep(edges.select("src", "dst").where("src <> dst").distinct())
    ids = keep(numbered(step.select(F.col("src").alias("key")).union(step.select("dst")), keep))
    a, b = ids.select(F.col("key").alias("src"), F.col("n").alias("s")), ids.select(F.col("key").alias("dst"), F.col("n").alias("d"))
    return keep(step.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))), ids


def _walks(first: DataFrame, on: DataFrame, name: str, longest: int, keep: Written) -> DataFrame:
    """(start, end, edges, name1, name2, …): walks of 1 to longest edges over nodes larger than their start, with what lies between its ends, outwards.

    first: (start, end), walks of one edge. on: (end, to). Only walks that go on are written; the longest ones are read once.
    """
    between = [f"{name}{k}" for k in range(1, longest)]
    padded = lambda rows, k: rows.select("start", "end", F.lit(k).alias("edges"), *[F.col(c) if i < k - 1 else F.lit(None).cast("bigint").alias(c) for i, c in enumerate(between)])
    now, out = first, padded(first, 1)
    for k in range(2, longest + 1):
        fresh = F.col("to") > F.col("start")
        for c in ("end", *between[: k - 2]):
            fresh = fresh & (F.col("to") != F.col(c))
        now = now.join(on, "end").where(fresh).select("start", F.col("to").alias("end"), *between[: k - 2], F.col("end").alias(between[k - 2]))
        now = keep(now) if k < longest else now
        out = out.union(padded(now, k))
    return out


def cycles(imports: DataFrame, max_length: int = MAX_CYCLE) -> DataFrame:
    """(files, hops): every simple cycle of 2 to max_length edges, once, from its smallest member.

    Nodes are numbered in order of their keys, so halves are a few numbers a row, and all lengths meet in one join.
    """
    keep = Written(imports.sparkSession, sorted_joins=True)
    edges, ids = _by_number(imports, keep)
    step = keep(within_components(edges, keep))
    half, rest = (max_length + 1) // 2, max_length // 2
    ahead = _walks(step.where("src < dst").select(F.col("src").alias("start"), F.col("dst").alias("end")), step.select(F.col("src").alias("end"), F.col("dst").alias("to")), "a", half, keep)
    back = _walks(step.where("dst < src").select(F.col("dst").alias("start"), F.col("src").alias("end")), step.select(F.col("dst").alias("end"), F.col("src").alias("to")), "b", rest, keep)
    met = ahead.withColumnRenamed("edges", "there").join(back.withColumnRenamed("edges", "home"), ["start", "end"]).where("there = home or there = home + 1")
    a, b = [f"a{k}" for k in range(1, half)], [f"b{k}" for k in range(1, rest)]
    for x in a:
        for y in b:
            met = met.where(F.coalesce(F.col(x) != F.col(y), F.lit(True)))
    found = keep(met.select(F.array_compact(F.array("start", *a, "end", *reversed(b))).alias("ring"), (F.col("there") + F.col("home")).alias("hops")))
    named = found.select("ring", "hops", F.posexplode("ring").alias("at", "n")).join(ids, "n")
    files = F.transform(F.array_sort(F.collect_list(F.struct("at", "key"))), lambda x: x["key"])
    return keep(named.groupBy("ring", "hops").agg(files.alias("files")).select("files", "hops"))


def minimal_cycles(found: DataFrame, limit: int | None = None) -> DataFrame:
    """The shortest `limit` cycles, or all, without those whose members strictly contain a reported one's."""
    kept = found if limit is None else found.orderBy("hops", "files").limit(limit)
    # A contained cycle starts at a member: join on members, not on all pairs. A longest one contains none of its own length.
    member = kept.select(F.col("files").alias("small"), F.col("hops").alias("h"), F.element_at("files", 1).alias("m"))
    inside = kept.withColumn("m", F.explode("files")).join(member, "m").where("h < hops and size(array_except(small, files)) = 0").select("files").distinct()
    return kept.join(inside, "files", "left_anti")
