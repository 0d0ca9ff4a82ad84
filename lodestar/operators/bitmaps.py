"""Sets of nodes, as arrays while small and as bitmaps beyond: how many nodes reach each node within a few edges, without a row for each pair.

Nodes are numbered. A hop sends the set of an edge's source along the edge, and a node joins what it receives. A node that at most
`LIGHT` numbers reach gathers them in one array, so a sparse graph of any size costs eight bytes a number. Any other set is a row for each
block of 32,768 numbers it touches, of 4 KB whatever it holds, joined by OR: a node between 100,000 sources and 100,000
targets costs 200,000 messages a block and not 10^10 pairs. Shuffles compress the empty part of a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.plans.written import Written

LIGHT = 4096


def numbered(keys: DataFrame, keep: Written) -> DataFrame:
    """(key, n): the distinct keys in order, from 1. Every part of the sort numbers its own; only their counts meet."""
    parts = keep(keys.select("key").distinct().repartitionByRange("key").sortWithinPartitions("key").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    counts = parts.groupBy(part).agg(F.count("*").alias("rows"))  # a row a part of the sort
    first = counts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("first"))
    return parts.withColumn("part", part).join(F.broadcast(first), "part").select("key", (F.col("first") + F.col("at") % (1 << 33) + 1).alias("n"))


def _holds(bits, n):
    """Whether a number is in the bitmap of its block."""
    at = F.bitmap_bit_position(n).cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1


def _hop(step: DataFrame, small: DataFrame | None, large: DataFrame | None, keep: Written) -> tuple[DataFrame, DataFrame]:
    """The sets one hop on, of both kinds: (node, ids) of nodes that few messages reach and (node, block, bits) of the others.

    An edge sends its source and the source's set. Nodes are told apart by the ids that would reach them, repeats included.
    """
    weight, sent = F.lit(1), step
    if small is not None:
        sizes = small.select(F.col("node").alias("s"), F.size("ids").alias("n")).union(large.select("node", F.lit(LIGHT)).distinct())
        weight, sent = F.lit(1) + F.coalesce("n", F.lit(0)), step.join(sizes, "s", "left")
    heavy = keep(sent.groupBy("d").agg(F.sum(weight).alias("load")).where(F.col("load") > LIGHT).select("d"))
    light_step, heavy_step = step, None
    if not heavy.isEmpty():
        light_step, heavy_step = step.join(heavy, "d", "left_anti"), step.join(heavy, "d", "left_semi")

    def messages(to: DataFrame) -> DataFrame:
        if small is None:
            return to.select("d", F.array("s").alias("ids"))
        return to.join(small.withColumnRenamed("node", "s"), "s", "left").select("d", F.concat(F.array("s"), F.coalesce("ids", F.array().cast("array<bigint>"))).alias("ids"))

    # Dealt by node before they are gathered: no part of a set is made before it travels.
    gathered = messages(light_step).repartition("d").groupBy(F.col("d").alias("node")).agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    if heavy_step is None:
        return gathered, step.sparkSession.range(0).select(F.col("id").alias("node"), F.col("id").alias("block"), F.lit(b"").alias("bits"))
    ids = messages(heavy_step).select("d", F.explode("ids").alias("id")).select("d", F.bitmap_bucket_number("id").alias("block"), F.bitmap_bit_position("id").alias("bit"))
    bits = ids.repartition("d", "block").groupBy("d", "block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    if small is not None:
        bits = bits.union(heavy_step.join(large.withColumnRenamed("node", "s"), "s").select("d", "block", "bits"))
    return gathered, bits.groupBy(F.col("d").alias("node"), "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def dependents_within(edges: DataFrame, depth: int) -> DataFrame:
    """(key, dependents): the number of other nodes with a path of 1 to depth edges to each node that has any."""
    keep = Written(edges.sparkSession)
    step = edges.select("src", "dst").where("src <> dst").distinct()
    ids = keep(numbered(step.select(F.col("src").alias("key")).union(step.select("dst")), keep))
    a, b = ids.select(F.col("key").alias("src"), F.col("n").alias("s")), ids.select(F.col("key").alias("dst"), F.col("n").alias("d"))
    step = keep(step.join(a, "src").join(b, "dst").select("s", "d"))
    small = large = None
    for hop in range(depth):
        small, large = _hop(step, small, large, keep)
        if hop < depth - 1:
            small, large = keep(small), keep(large)
    few = small.select("node", (F.size("ids") - F.array_contains("ids", F.col("node")).cast("int")).cast("long").alias("dependents"))
    itself = F.when(F.bitmap_bucket_number("node") == F.col("block"), _holds(F.col("bits"), F.col("node")).cast("int")).otherwise(0)
    many = large.groupBy("node").agg(F.sum(F.bitmap_count("bits") - itself).alias("dependents"))
    return few.union(many).where("dependents > 0").join(ids.withColumnRenamed("n", "node"), "node").select("key", "dependents")
