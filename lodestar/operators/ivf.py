"""Nearest vectors for a whole table of queries: an inverted file of vectors by centroid, exact scores inside the lists read.

Centroids come from spherical k-means over a bounded sample (`SAMPLE` vectors, those with the smallest hash of their id). Every
vector is indexed: it goes to the list of its nearest centroid, and a long list is cut into pieces, so copies of one vector
never fill a task. A query reads its `probes` nearest lists; scores there are cosines in double precision. With `exact` it then
reads every other list that may hold something closer than its k-th hit: a list reaches as far as its farthest member, and the
angle to a member is at least the angle to the centroid less that. So the rows are those of a full comparison.

Vectors and queries that are null, zero, of another width or hold null or non-finite values are in no list and find nothing.
Ties go to the smaller id. Fewer than k hits are all given.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.plans.written import Written

SAMPLE = 10_000
MAX_LISTS = 4096
ROUNDS = 10
PIECE_VALUES = 4_000_000  # numbers of a piece's vectors in one task
QUERIES = 4096  # of one list in one task
SLACK = 1e-9


@dataclass
class Index:
    """lists: (id, embedding, list, piece), partitioned by list. The rest is a row a list."""

    lists: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    pieces: np.ndarray


def unit_rows(column: pa.ChunkedArray | pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors that count, as unit rows in double precision, and where they are."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    fits = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), width), False).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(fits)).flatten()
    rows = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)  # nulls become NaN
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.sqrt((rows * rows).sum(1))
    good = np.isfinite(size) & (size > 0)
    return rows[good] / size[good, None], fits[good]


def kmeans(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows; the first are spread by taking the row farthest from those taken."""
    k = min(k, len(rows))
    chosen, near = [0], rows @ rows[0]
    while len(chosen) < k:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, rows @ rows[chosen[-1]])
    centre = rows[chosen].copy()
    for _ in range(rounds):
        of = (rows @ centre.T).argmax(1)
        sums = np.zeros_like(centre)
        np.add.at(sums, of, rows)
        size = np.sqrt((sums * sums).sum(1))
        moved = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], centre)
        if np.allclose(moved, centre):
            break
        centre = moved
    return centre


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def build(vectors: DataFrame, path: str, n_lists: int | None = None, id_col: str = "id", vector_col: str = "embedding") -> None:
    """Writes the index of all vectors below path. n_lists: about the root of their number unless given, MAX_LISTS at most."""
    keep = Written(vectors.sparkSession)
    slim = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    widths = slim.where("embedding is not null").groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width = widths.width if widths else 0
    n = widths["count"] if widths else 0
    sample = slim.where(F.size("embedding") == width).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toArrow().column(0) if width else None
    rows = unit_rows(sample, width)[0] if width else np.zeros((0, 1))
    centre = kmeans(rows, n_lists or min(MAX_LISTS, max(1, math.isqrt(n)))) if len(rows) else np.zeros((0, max(1, width)))
    held = vectors.sparkSession.sparkContext.broadcast(centre)  # MAX_LISTS rows at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, where = unit_rows(batch.column(1), width)
            cosines = unit @ held.value.T
            of = cosines.argmax(1)
            some = batch.take(pa.array(where))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(of, pa.int32()), pa.array(_angles(cosines[np.arange(len(of)), of]), pa.float64())], names=["id", "embedding", "list", "angle"])

    id_type = slim.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, embedding array<double>, list int, angle double"
    placed = keep(slim.mapInArrow(assign, schema) if len(centre) else slim.limit(0).selectExpr("id", "embedding", "0 as list", "0D as angle"))
    per_piece = max(1, PIECE_VALUES // max(1, width))
    stats = placed.groupBy("list").agg(F.max("angle").alias("radius"), F.ceil(F.count("*") / per_piece).cast("int").alias("pieces"))
    stats = keep(stats)
    dealt = placed.join(F.broadcast(stats.select("list", "pieces")), "list")  # MAX_LISTS rows at most
    dealt.select("id", "embedding", F.pmod(F.xxhash64("id", F.hash("embedding")), F.col("pieces")).cast("int").alias("piece"), "list").write.partitionBy("list").parquet(f"{path}/lists")
    centres = vectors.sparkSession.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(centre)], "list int, centroid array<double>")
    centres.join(stats, "list", "left").select("list", "centroid", F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("pieces", F.lit(0)).alias("pieces")).write.parquet(f"{path}/centroids")


def load(spark: SparkSession, path: str) -> Index:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    lists = spark.read.parquet(f"{path}/lists") if rows else spark.createDataFrame([], "id long, embedding array<double>, piece int, list int")
    return Index(lists, np.array([r.centroid for r in rows]).reshape(len(rows), len(rows[0].centroid) if rows else 1), np.array([r.radius for r in rows]), np.array([r.pieces for r in rows], np.int64))


def _probe(index: Index, probes: int, further: bool):
    """(qid, q, list, piece): the pieces a query reads; with `further`, those beyond its first lists that its k-th hit doesn't rule out."""
    centre, radius, pieces = index.centroids, index.radius, index.pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, where = unit_rows(batch.column(1), centre.shape[1])
            cosines = unit @ centre.T
            first = np.argsort(-cosines, 1, kind="stable")[:, :probes]
            reads = np.zeros(cosines.shape, bool)
            np.put_along_axis(reads, first, True, 1)
            if further:
                worst = batch.column(2).to_numpy(zero_copy_only=False)[where]
                reads = ~reads & (_angles(cosines) - radius <= _angles(worst)[:, None] + SLACK)
            row, of = np.nonzero(reads)
            times = pieces[of]
            row, of = np.repeat(row, times), np.repeat(of, times)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
            some = batch.take(pa.array(where[row]))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(of, pa.int32()), pa.array(piece, pa.int32())], names=["qid", "q", "list", "piece"])

    return run


def _best(k: int, width: int):
    def run(key, queries, vectors):
        q, which = unit_rows(queries.column("q"), width)
        v, where = unit_rows(vectors.column("embedding"), width)
        if not len(q) or not len(v):
            return pa.table({"qid": queries.column("qid").slice(0, 0), "id": vectors.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
        order = pc.sort_indices(vectors.column("id").take(pa.array(where))).to_numpy()
        v, where = v[order], where[order]  # by id, so that a stable sort settles ties
        out = []
        for low in range(0, len(q), 256):
            scores = q[low : low + 256] @ v.T
            best = np.argsort(-np.round(scores, 9), 1, kind="stable")[:, :k]
            out.append((np.repeat(np.arange(low, low + len(scores)), best.shape[1]), best.ravel(), np.take_along_axis(scores, best, 1).ravel()))
        row, at, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"qid": queries.column("qid").take(pa.array(which[row])), "id": vectors.column("id").take(pa.array(where[at])), "score": pa.array(score)})

    return run


def _hits(index: Index, asked: DataFrame, k: int, id_type: str) -> DataFrame:
    """The k best hits of each query in each piece it reads. Lists that nobody reads are not read; very many queries of one list are cut too."""
    per_list = asked.where("piece = 0").groupBy("list").agg(F.count("*").alias("n")).collect()  # a row a list, MAX_LISTS at most
    lists = index.lists.where(F.col("list").isin([r.list for r in per_list]))
    cuts = -(-max([r.n for r in per_list], default=1) // QUERIES)
    asked = asked.withColumn("cut", F.pmod(F.xxhash64("qid"), F.lit(cuts)).cast("int"))
    lists = lists.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))))
    by = ["list", "piece", "cut"]
    q_type = asked.schema["qid"].dataType.simpleString()
    return asked.groupBy(*by).cogroup(lists.groupBy(*by)).applyInArrow(_best(k, index.centroids.shape[1]), f"qid {q_type}, id {id_type}, score double")


def nearest(index: Index, queries: DataFrame, k: int = 8, probes: int = 8, exact: bool = False, query_id: str = "qid", query_col: str = "q") -> DataFrame:
    """(qid, id, score): the k vectors closest to each query of a table."""
    keep = Written(queries.sparkSession)
    asked = keep(queries.select(F.col(query_id).alias("qid"), F.col(query_col).cast("array<double>").alias("q")))
    q_type, id_type = (df.schema[c].dataType.simpleString() for df, c in ((asked, "qid"), (index.lists, "id")))
    if not len(index.centroids):
        return asked.limit(0).select("qid", F.lit(None).cast(id_type).alias("id"), F.lit(None).cast("double").alias("score"))
    schema = f"qid {q_type}, q array<double>, list int, piece int"
    first = keep(asked.mapInArrow(_probe(index, probes, False), schema))
    best = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "id")
    top = lambda hits: hits.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k)
    hits = keep(top(_hits(index, first, k, id_type)))
    if exact and probes < len(index.centroids):
        kth = hits.where(F.col("nth") == k).select(F.col("qid"), F.col("score").alias("worst"))
        more = asked.join(kth, "qid", "left").select("qid", "q", F.coalesce("worst", F.lit(-1.0)).alias("worst"))
        further = keep(more.mapInArrow(_probe(index, probes, True), schema))
        hits = top(hits.drop("nth").union(_hits(index, further, k, id_type)))
    return hits.drop("nth")
