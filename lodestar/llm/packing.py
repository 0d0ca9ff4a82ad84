"""Packing: optimal length buckets by dynamic programming, and token-budget batches inside each.

Documents longer than `max_len` tokens are cut into pieces of `max_len` and a rest; nothing is dropped. The
exact histogram of piece lengths, at most `max_len` rows whatever the corpus, goes to the driver, where dynamic
programming chooses the `n_buckets` upper bounds that make the total padding least. Every piece is padded to
its bucket's bound; a batch holds budget // bound pieces of one bucket.

Batches are cut along one numbering of each bucket: pieces fall into shards by hash, shard sizes give each
shard its first number, and a row number inside the shard does the rest. So a bucket has at most one batch that
is not full, and no task needs more than a shard, however many pieces one bucket holds.

Defined results: null and empty texts have no tokens and no pieces, an empty table no rows. Repeated rows and null
ids are packed each for itself; equal pieces of one id count together until they are numbered, so no shard grows with
them. Very long texts are pieces like others. Only the columns named are read, so others may have any
name. Batches are numbered from 0 within a bucket. Tokens are the words [^\\x20\\x09-\\x0D]+ unless a column of counts is named.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import Written, n_words, table


@dataclass(frozen=True)
class PackParams:
    max_len: int = 2048
    n_buckets: int = 12
    budget: int = 16384
    shard_rows: int = 50_000


def best_bounds(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Upper bounds of at most n_buckets buckets that pad least: sum of count * (bound - length).

    lengths ascend and differ. cost[k][j]: least padded volume of the first j lengths in k buckets.
    """
    n = len(lengths)
    if not n:
        return []
    total = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    cost = np.full(n + 1, np.inf)
    cost[0] = 0
    back = []
    for _ in range(min(n_buckets, n)):
        nxt, choice = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            way = cost[:j] + lengths[j - 1] * (total[j] - total[:j])
            choice[j] = np.argmin(way)
            nxt[j] = way[choice[j]]
        back.append(choice)
        cost = nxt
    bounds, j = [], n
    for choice in reversed(back):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(choice[j])
    return bounds[::-1]


def pack(docs: DataFrame, p: PackParams = PackParams(), id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """One row per piece: id_col, piece, start_token, n_tokens, bucket, bound, batch, slot, padding."""
    spark = docs.sparkSession
    keep = Written(spark)
    size = F.col(count_col).cast("long") if count_col else n_words(F.col(text_col))
    sized = docs.select(F.col(id_col), size.alias("__n")).where("__n > 0")
    m = F.lit(p.max_len)
    pieces = sized.select(id_col, "__n", F.explode(F.sequence(F.lit(0), F.expr(f"int((__n - 1) div {p.max_len})"))).alias("piece"))
    pieces = pieces.select(id_col, "piece", (F.col("piece").cast("long") * m).alias("start_token"), F.least(m.cast("long"), F.col("__n") - F.col("piece") * m).cast("int").alias("n_tokens"))
    pieces = keep(pieces.groupBy(id_col, "piece", "start_token", "n_tokens").agg(F.count("*").alias("__m")))
    found = sorted((r.n_tokens, r.m, r.groups) for r in pieces.groupBy("n_tokens").agg(F.sum("__m").alias("m"), F.count("*").alias("groups")).collect())  # max_len rows at most
    lengths, counts = np.array([a for a, *_ in found], np.int64), np.array([b for _, b, _ in found], np.int64)
    bounds = best_bounds(lengths, counts, p.n_buckets)
    shards = max(1, -(-sum(c for *_, c in found) // p.shard_rows))
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<int>"), lambda b: b < F.col("n_tokens")))
    dealt = pieces.withColumn("bucket", bucket).withColumn("__h", F.xxhash64(id_col, "piece"))
    dealt = dealt.withColumn("__shard", F.pmod("__h", F.lit(shards)))
    sizes = dealt.groupBy("bucket", "__shard").agg(F.sum("__m").alias("__size"))
    before = Window.partitionBy("bucket").orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("bucket", "__shard", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__first"))  # n_buckets * shards rows
    inside = Window.partitionBy("bucket", "__shard").orderBy("__h", id_col, "piece", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    numbered = dealt.withColumn("__k", F.coalesce(F.sum("__m").over(inside), F.lit(0))).join(first, ["bucket", "__shard"])
    numbered = numbered.withColumn("__nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__m") - 1)))
    bound = F.element_at(F.array(*[F.lit(b) for b in bounds]) if bounds else F.array(F.lit(0)), F.col("bucket") + 1)
    numbered = numbered.withColumn("bound", bound).withColumn("__at", F.col("__first") + F.col("__k") + F.col("__nth"))
    fits = F.greatest(F.lit(1), F.floor(F.lit(p.budget) / F.col("bound")))
    return numbered.select(
        id_col, "piece", "start_token", "n_tokens", "bucket", "bound", F.floor(F.col("__at") / fits).alias("batch"), (F.col("__at") % fits).alias("slot"), (F.col("bound") - F.col("n_tokens")).alias("padding")
    )


def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their batches; copies of a document are packed each for itself.

    Texts without words have no pieces, null ids are packed like others, an empty table gives no rows.
    """
    return pack(docs)
