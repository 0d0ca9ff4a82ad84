"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies c = target / source size, at most 2. All get
floor(c) copies; the rest, f = c - floor(c), is each one's probability of one more. Pivotal rounding pairs two
documents and moves probability from one to the other, weighed by their sizes so that the words expected stay
the same, until one of them is 0 or 1; the direction is drawn so that each probability keeps its expectation.
The one left over meets the next. A shard of a source ends with at most one document undecided; these meet in
groups of `FAN_IN`, level by level, until each source has one, which is then drawn. A source's taken words
differ from its target by one document's size at most.

Draws come from hashes of ids and sizes, so reruns agree. Rows that repeat id, text and source count together first: m of
them take floor(m * f) at once and share one fraction. Shards hold about `SHARD_ROWS` of these however large a source
is, and a shard is rounded as a stream. Sources are rows of a table throughout: their order comes from a sort, their
targets from rounds of one sum each, and nothing of a source reaches the driver but those sums.

Defined results: null and empty texts have size 0 and are taken floor(c) times; a null source is one of its own, the
last; null ids are ids like others; an empty table gives an empty result; very long texts only count by their words.
Columns of the documents may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import Written, n_words, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_COPIES = 2.0
SHARD_ROWS = 4096
FAN_IN = 64
BROADCAST_SOURCES = 100_000  # above it the table of sources joins by shuffle


def ranked(sources: DataFrame, keep: Written) -> DataFrame:
    """Adds rank, 0 for the first source by code point, null last. Each part of the sort counts its own rows."""
    parts = keep(sources.orderBy(F.col("s").isNull(), "s").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    counts = parts.groupBy(part).agg(F.count("*").alias("n"))  # a row a part of the sort
    first = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    return parts.withColumn("part", part).join(F.broadcast(first), "part").withColumn("rank", F.col("first") + F.col("at") % (1 << 33)).drop("part", "at", "first")


def targets(sources: DataFrame, keep: Written, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_COPIES) -> DataFrame:
    """(s, source_size, rows, target): words to take of each source (s, source_size, rows).

    Shares of the total by weight, none above `most` times the source's size; what exceeds is shared anew among the
    others. A round needs two sums over the sources, and every round fills at least one more.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table_ = keep(ranked(sources, keep).withColumn("w", weight))
    total, whole, left, filled = share * (table_.agg(F.sum("source_size")).first()[0] or 0), 0.0, 0.0, -1
    full = F.lit(False)
    while True:
        r = table_.agg(F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0)), F.count_if(full)).first()
        if r[2] == filled or not r[1]:
            break
        left, whole, filled = total - most * r[0], r[1], r[2]
        full = full | (F.lit(left) * F.col("w") / F.lit(whole) > most * F.col("source_size"))
    due = F.lit(left) * F.col("w") / F.lit(whole) if whole else F.lit(0.0)
    return table_.select("s", "source_size", "rows", F.when(full, most * F.col("source_size")).otherwise(due).alias("target"))


def pivot(rows: Iterable[tuple[int, float, float]]) -> tuple[dict[int, int], tuple[int, float] | None]:
    """Rounds (number, size, probability) rows of positive sizes in order; draws follow from what is in the rows.

    Returns the decisions by number, and the number and probability of the one left undecided.
    """
    rows = list(rows)
    draws = np.random.Generator(np.random.PCG64([len(rows), *(int(s) for _, s, _ in rows[:8])])).random(len(rows))
    done: dict[int, int] = {}
    held: tuple[int, float, float] | None = None
    for (k, size, p), draw in zip(rows, draws.tolist(), strict=True):
        if p <= 1e-12 or p >= 1 - 1e-12:
            done[k] = round(p)
            continue
        if held is None:
            held = (k, size, p)
            continue
        j, other, q = held
        # Mass in words: up moves it from j to k as far as one becomes integral, down from k to j.
        up, down = min((1 - p) * size, q * other), min(p * size, (1 - q) * other)
        move = up if draw * (up + down) < down else -down
        p, q = p + move / size, q - move / other
        ends = [(x, a, b) for x, a, b in ((k, size, p), (j, other, q)) if 1e-9 < b < 1 - 1e-9]
        for x, b in ((k, p), (j, q)):
            if not 1e-9 < b < 1 - 1e-9:
                done[x] = round(b)
        held = ends[0] if ends else None
    return done, held and (held[0], held[2])


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col), F.xxhash64(F.col(id_col), F.col(text_col)).alias("__key"), F.col(source_col).cast("string").alias("__source"), n_words(F.col(text_col)).alias("size"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id_col, __key (a hash of id and text), __source, size, source_size, target, copies, taken.

    Rows that repeat are documents of their own. The table of sources is broadcast only up to BROADCAST_SOURCES names.
    """
    keep = Written(docs.sparkSession)
    rows = keep(sized(docs, id_col, text_col, source_col).groupBy(id_col, "__key", "__source", "size").agg(F.count("*").alias("m")))
    found = rows.groupBy(F.col("__source").alias("s")).agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("rows"))
    shards = F.ceil(F.col("rows") / SHARD_ROWS)
    per_source = keep(targets(found, keep).select("s", "source_size", "target", F.greatest(F.lit(1), shards).cast("long").alias("shards")))
    n_sources, most = per_source.agg(F.count("*"), F.coalesce(F.max("shards"), F.lit(1))).first()
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.join(F.broadcast(per_source) if n_sources <= BROADCAST_SOURCES else per_source, F.col("__source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("base", F.floor(ratio + 1e-12)).withColumn("p", F.greatest(ratio - F.col("base"), F.lit(0.0)) * F.when(F.col("size") > 0, F.col("m")).otherwise(0))
    rows = rows.withColumn("ones", F.floor(F.col("p") + 1e-9)).withColumn("p", F.greatest(F.col("p") - F.col("ones"), F.lit(0.0)))
    rows = rows.withColumn("shard", F.pmod(F.col("__key"), F.col("shards")))
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, __key long, __source string, size long, m long, source_size long, target double, shards long, base long, p double, ones long, shard long, extra int"

    def round_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__key", "size"], kind="stable").reset_index(drop=True)
        size, p = pdf["size"].to_numpy(float), pdf["p"].to_numpy(float)
        done, held = pivot((k, size[k], p[k]) for k in range(len(pdf)) if size[k] > 0)
        extra = np.array([done.get(k, -1 if size[k] > 0 else 0) for k in range(len(pdf))], np.int32)
        if held:
            p[held[0]] = held[1]
            if pdf["shards"].iat[0] <= 1:  # the last of its source: drawn
                key = int(pdf["__key"].iat[held[0]]) & (2**63 - 1)
                extra[held[0]] = int(np.random.Generator(np.random.PCG64(key)).random() < held[1])
        return pdf.assign(p=p, extra=extra)

    done, level = None, rows
    while True:
        out = keep(level.groupBy("__source", "shard").applyInPandas(round_shard, schema))
        part = out.where("extra >= 0")
        done = part if done is None else done.union(part)
        if most <= 1:
            break
        # What each shard leaves undecided: one row a shard. FAN_IN shards make one of the next level.
        level = out.where("extra < 0").drop("extra").withColumn("shard", F.expr(f"shard div {FAN_IN}")).withColumn("shards", F.expr(f"(shards + {FAN_IN - 1}) div {FAN_IN}"))
        most = -(-most // FAN_IN)
    one = done.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "m")))  # of the rows that repeat, the first ones get the more
    copies = F.col("base") + (F.col("nth") <= F.col("ones") + F.col("extra")).cast("long")
    return one.select(id_col, "__key", "__source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("__key", "__source")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; all columns stay, whatever their names.

    Rows that share id and text are told apart by their rank in the order of a hash of all their columns, so reruns take the
    same ones. Texts without words and empty tables behave as in mix().
    """
    key = F.xxhash64("doc_id", "text")
    hashed = [F.col(f"`{c}`") for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("__id"), key.alias("__k"), F.xxhash64(*hashed).alias("__all"))
    keyed = keyed.withColumn("__r", F.row_number().over(Window.partitionBy("__id", "__k").orderBy("__all")))
    counts = mix(docs).select("doc_id", "__key", "copies").withColumn("__rank", F.row_number().over(Window.partitionBy("doc_id", "__key").orderBy(F.desc("copies"))))
    taken = counts.where("copies > 0").select("doc_id", "__key", "__rank", F.col("copies").cast("int").alias("copies"))
    same = F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__k") == F.col("__key")) & (F.col("__r") == F.col("__rank"))
    joined = keyed.join(taken, same).select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("nth"))
    return joined.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
