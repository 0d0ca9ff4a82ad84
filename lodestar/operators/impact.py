"""Ranked change impact: who reaches a node, how surely, and by which route."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.keys import short_key
from lodestar.operators.graph import DIGITS, best_paths

DECAY = 0.6
DEPTH = 3


def impact(edges: DataFrame, roots: DataFrame, depth: int = DEPTH, decay: float = DECAY) -> DataFrame:
    """(node, hops, confidence, score, route, via) of every node that reaches a root over CALLS and IMPORTS.

    score = product of confidences * decay ** (hops - 1); each node keeps its best score, then fewest hops, then
    smallest route. Rounded to 4 decimals after ranking; best first.
    """
    if not 0 < decay <= 1:
        raise ValueError(f"decay must be in (0, 1], not {decay}")
    paths = best_paths(edges.where(F.col("type").isin("CALLS", "IMPORTS")), roots, depth, forward=False)
    score = F.col("confidence") * F.pow(F.lit(float(decay)), F.col("hops") - 1)
    scored = paths.withColumn("score", score)
    best = F.min(F.struct(F.round(-F.col("score"), DIGITS).alias("r"), "hops", "route", "via", "confidence", "score")).alias("w")
    found = scored.groupBy("node").agg(best)
    out = found.select("node", "w.hops", F.round("w.confidence", 4).alias("confidence"), F.round("w.score", 4).alias("score"), "w.route", "w.via")
    return out.orderBy(F.desc("score"), "hops", "node")


def summarize(items: DataFrame, label: str = "label") -> DataFrame:
    """One row: total, direct, max_hops, top_score, by_hop and by_type as maps in words."""
    one = items.agg(F.count("*").alias("total"), F.count_if(F.col("hops") == 1).alias("direct"), F.coalesce(F.max("hops"), F.lit(0)).alias("max_hops"), F.coalesce(F.max("score"), F.lit(0.0)).alias("top_score"))
    by_hop = items.groupBy("hops").agg(F.count("*").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hops", "n"))), lambda x: F.concat_ws(":", x["hops"], x["n"])), ",").alias("by_hop"))
    by_type = items.groupBy(F.col(label).alias("t")).agg(F.count("*").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("n"), F.col("t")))), lambda x: F.concat_ws(":", x["t"], -x["col1"])), ",").alias("by_type"))
    return one.join(F.broadcast(by_hop)).join(F.broadcast(by_type))  # one row each


def route_text(route) -> F.Column:
    """A route as the short forms of its keys."""
    return F.array_join(F.transform(route, lambda k: short_key(k)), " -> ")


def radius_block(items: DataFrame, root: str, depth: int = DEPTH, limit: int = 15) -> str:
    """The blast radius as a block of text for a prompt; reads at most limit + 1 rows."""
    rows = items.withColumn("text", route_text(F.col("route"))).limit(limit + 1).collect()
    if not rows:
        return f"Blast radius of `{root}`: nothing in this repository reaches it within {depth} hops."
    shown = rows[:limit]
    direct = sum(r.hops == 1 for r in shown)
    lines = [f"Blast radius of `{root}` — {len(shown)} node(s) within {depth} hop(s), {direct} of them direct" + (", capped" if len(rows) > limit else "") + ":"]
    for r in shown:
        lines.append(f"  {r.node} — hop {r.hops}, confidence {r.confidence:.2f}, via {' then '.join(r.via)}\n    route: {r.text}")
    return "\n".join(lines)


def signature() -> F.Column:
    """A symbol's signature from kind, qualname, parameters, returns, is_async and base_classes."""
    params = F.array_join(F.transform("parameters", lambda p: F.concat(p["name"], F.coalesce(F.concat(F.lit(": "), F.nullif(p["annotation"], F.lit(""))), F.lit("")))), ", ")
    returns = F.coalesce(F.concat(F.lit(" -> "), F.nullif("returns", F.lit(""))), F.lit(""))
    bases = F.when(F.size(F.coalesce("base_classes", F.array().cast("array<string>"))) > 0, F.concat(F.lit("("), F.array_join("base_classes", ", "), F.lit(")"))).otherwise("")
    function = F.concat(F.when(F.col("is_async"), "async ").otherwise(""), F.lit("def "), "qualname", F.lit("("), F.coalesce(params, F.lit("")), F.lit(")"), returns)
    return F.when(F.col("kind") == "class", F.concat(F.lit("class "), "qualname", bases)).otherwise(function)


def describe(items: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds `description`: place and signature of the symbol, with the first line of its docstring, else path and label.

    items: (node, module, qualname, path, label, display); symbols: one row a (module, qualname) counts.
    """
    first = symbols.dropDuplicates(["module", "qualname"]).select(F.col("module").alias("__m"), F.col("qualname").alias("__q"), F.col("path").alias("__p"), "line_start", signature().alias("__s"), "docstring")
    joined = items.join(first, F.col("module").eqNullSafe(F.col("__m")) & (F.col("qualname") == F.col("__q")), "left")
    place = F.coalesce(F.concat_ws(":", F.coalesce("__p", "path"), F.col("line_start").cast("string")), "module", F.lit("?"))
    doc = F.coalesce(F.concat(F.lit("\n    doc: "), F.nullif(F.substring_index(F.trim("docstring"), "\n", 1), F.lit(""))), F.lit(""))
    with_symbol = F.concat(place, F.lit(" — "), "__s", doc)
    return joined.withColumn("description", F.coalesce(with_symbol, F.concat(F.coalesce("path", "display"), F.lit(" — "), "label"))).drop("__m", "__q", "__p", "__s", "line_start", "docstring")


def build_prompt(root: str, items: DataFrame, top: int = 25, depth: int = DEPTH) -> str:
    """The evidence for an explanation in prose: counts, and the highest-scoring nodes with their routes.

    items: impact() with `description` and `label`. Reads the counts and `top` rows.
    """
    summary = summarize(items).first()
    rows = items.withColumn("text", route_text(F.col("route"))).orderBy(F.desc("score"), "hops", "node").limit(top).collect()
    count = lambda s, unit="": ", ".join(f"{n} at {k}{unit}" for k, n in (x.rsplit(":", 1) for x in s.split(","))) if s else "none"
    lines = ["The symbol being changed:", f"  {root}", "", f"{summary.total} node(s) reach it within {depth} hop(s): {summary.direct} directly.", f"Affected by type: {count(summary.by_type)}.", f"Affected by distance: {count(summary.by_hop, ' hop')}.", "", f"The {len(rows)} highest-scoring, each with the route the change travels:"]
    for k, r in enumerate(rows, 1):
        lines += [f"\n[{k}] hop {r.hops}, confidence {r.confidence:.2f}, score {r.score:.2f}, via {' then '.join(r.via)}", f"    {r.description}", f"    route: {r.text}"]
    return "\n".join(lines)
