"""Embedding near-dedup with spherical-cap filters from structured random product codes.

A filter is a direction made of one codeword from each of `PARTS` random codes on the parts of a randomly
rotated vector; there are `CODES` such product codes. A vector passes the filters of a code whose inner product
exceeds its own alpha: the value that lets `LIST` filters through. (With one alpha for all vectors the lists
ran from 1 to 335 filters and a fifth of the pairs at the threshold were missed; with one alpha each, none of
1,000.) List decoding finds them without visiting all: a filter among the LIST best uses in every part one of
the LIST best codewords. Vectors of one label that pass one filter meet and their cosine is taken in double
precision. The number of filters grows with the number of vectors, so buckets stay small.

Copies of one vector collapse first, with their number. A bucket above `BLOCK` vectors is cut into blocks and
each pair of blocks is a task of its own, so no task grows with a bucket and no pair is left out. A pair that
shares several filters counts in the smallest. Tasks return link counts and a spanning forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import Written, table
from lodestar.llm.components import components

THRESHOLD = 0.93
PARTS = 3
CODES = 4
LIST = 7
PER_BUCKET = 8
BLOCK = 2048
TASK_ROWS = 20_000
SEED = 7


class Filters:
    """The product codes for vectors of d dimensions, for about n vectors."""

    def __init__(self, d: int, n: int):
        rng = np.random.Generator(np.random.PCG64([SEED, d]))
        parts = min(PARTS, d)
        self.words = int(min(128, max(12, round((n / PER_BUCKET) ** (1 / parts)))))
        self.cuts = [(int(c[0]), int(c[-1]) + 1) for c in np.array_split(np.arange(d), parts)]
        self.codes = []
        for _ in range(CODES):
            rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
            words = []
            for a, b in self.cuts:
                c = rng.standard_normal((self.words, b - a))
                words.append(c / np.linalg.norm(c, axis=1, keepdims=True))
            self.codes.append((rotation, words))

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The filters each unit vector passes: a row of CODES * LIST numbers, ascending."""
        found = []
        for k, (rotation, words) in enumerate(self.codes):
            turned, total, code = x @ rotation, np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
            for (a, b), c in zip(self.cuts, words, strict=True):
                s = turned[:, a:b] @ c.T
                best = np.argsort(-s, axis=1, kind="stable")[:, :LIST]
                total = (total[:, :, None] + np.take_along_axis(s, best, 1)[:, None, :]).reshape(len(x), -1)
                code = (code[:, :, None] * self.words + best[:, None, :]).reshape(len(x), -1)
                top = np.argsort(-total, axis=1, kind="stable")[:, :LIST]
                total, code = np.take_along_axis(total, top, 1), np.take_along_axis(code, top, 1)
            found.append(code + k * self.words ** len(self.cuts))
        return np.sort(np.concatenate(found, axis=1), axis=1)


def local_links(x: np.ndarray, copies: np.ndarray, side: np.ndarray, lists: list[np.ndarray], me: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the vectors of one task: links by copies of the other, and a root each (spanning forest).

    side: 0 or 1; with both present only pairs across them count. me: this task's filter; a pair that shares a
    smaller one is left to that.
    """
    n = len(x)
    links, root = np.zeros(n, np.int64), np.arange(n)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    if side.any() and not side.all():
        near &= side[:, None] != side[None]
    rows = np.flatnonzero(near.any(1))
    if not len(rows):
        return links, root
    near = near[np.ix_(rows, rows)]
    small = [lists[r][lists[r] < me] for r in rows]
    values, count = np.unique(np.concatenate(small), return_counts=True) if small else (np.zeros(0), np.zeros(0))
    values = values[count > 1]
    shared = np.zeros(near.shape, bool)
    for at in range(0, len(values), 1024):
        part = values[at : at + 1024]
        has = np.zeros((len(rows), len(part)), np.float32)
        for k, s in enumerate(small):
            own = s[np.isin(s, part)]
            has[k, np.searchsorted(part, own)] = 1
        shared |= has @ has.T > 0
    links[rows] = (near & ~shared) @ copies[rows]
    low = np.arange(len(rows))
    while True:  # least number reachable
        new = np.minimum(low, np.where(near, low[None], len(rows)).min(1))
        new = new[new]
        if (new == low).all():
            break
        low = new
    root[rows] = rows[low]
    return links, root


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # else squares of tiny or huge components leave double range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _emit(filters: Filters, payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                raw = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                passed = filters.decode(_unit(raw))
                row = pa.array(np.repeat(np.arange(len(raw)), passed.shape[1]))
                out = {"label": batch.column("label").take(row), "filter": pa.array(passed.ravel())}
                if payload:
                    for name, values in (("vector", raw), ("filters", passed.astype(np.int32))):
                        out[name] = pa.array([v.tobytes() for v in values], pa.binary()).take(row)
                    out["rep"], out["copies"] = (batch.column(c).take(row) for c in ("rep", "copies"))
                yield pa.RecordBatch.from_pydict(out)

    return run


def _task(threshold: float, kind: str):
    def run(rows):
        d = {c: rows.column(c).to_pylist() for c in ("label", "filter", "b1", "b2", "block", "rep", "copies", "vector", "filters")}
        groups: dict[tuple, list[int]] = {}
        for k, key in enumerate(zip(d["label"], d["filter"], d["b1"], d["b2"], strict=True)):
            groups.setdefault(key, []).append(k)
        out_rep, out_root, out_n = [], [], []
        for (_, me, b1, b2), ks in groups.items():
            if len(ks) < 2:
                continue
            x = _unit(np.stack([np.frombuffer(d["vector"][k], kind) for k in ks]))
            side = np.array([d["block"][k] != b1 for k in ks]) if b1 != b2 else np.zeros(len(ks), bool)
            if b1 != b2 and (side.all() or not side.any()):
                continue
            lists = [np.frombuffer(d["filters"][k], np.int32) for k in ks]
            links, root = local_links(x, np.array([d["copies"][k] for k in ks], np.int64), side, lists, me, threshold)
            rep = [d["rep"][k] for k in ks]
            for k in np.flatnonzero((links > 0) | (root != np.arange(len(ks)))).tolist():
                out_rep.append(rep[k])
                out_root.append(rep[int(root[k])])
                out_n.append(int(links[k]))
        return pa.table({"u": pa.array(out_rep, pa.int64()), "v": pa.array(out_root, pa.int64()), "n": pa.array(out_n, pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: id_col, n_links, component_id, kept.

    Vectors that are null, empty or zero, hold null or non-finite components, or have a null label or id link
    with nothing. Vectors of different lengths never link. Rows that repeat are vectors of their own, linked to
    each other; of vectors that share an id each has its own row, and the id stands for all of them in component_id. Very
    long vectors are rotated like others, in memory of their length squared; an empty table gives no rows; other columns
    may have any name. The loop below has a round for each length that a good vector has. Copies of one vector meet again
    in the last join only, whose large partitions the adaptive plan splits.
    """
    spark = vectors.sparkSession
    keep = Written(spark)
    # Floats stay floats on the way, which loses nothing; all else is compared as doubles.
    element = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    kind = {"float": "<f4", "double": "<f8"}[element]
    v = F.col("v")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(f"array<{element}>").alias("v"))
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    valid = rows.where("good").select("id", F.concat_ws(":", F.size("v"), "label").alias("label"), "v")
    reps = keep(valid.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    found = []
    for d, n in reps.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect():  # a row per length
        filters = Filters(d, n)
        own = reps.where(F.size("v") == d)
        sizes = keep(own.mapInArrow(_emit(filters, False), "label string, filter long").groupBy("label", "filter").agg(F.count("*").alias("m")))
        total, hot_rows = sizes.agg(F.coalesce(F.sum("m"), F.lit(0)), F.count_if(F.col("m") > BLOCK)).first()
        hot = sizes.where(F.col("m") > BLOCK).select("label", "filter", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
        sent = own.mapInArrow(_emit(filters, True), "label string, filter long, vector binary, filters binary, rep long, copies long")
        sent = sent.join(F.broadcast(hot) if hot_rows < 100_000 else hot, ["label", "filter"], "left")
        sent = sent.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        sent = sent.withColumn("b1", F.least("block", "other")).withColumn("b2", F.greatest("block", "other")).drop("other", "blocks")
        n_tasks = max(64, -(-total // TASK_ROWS))
        sent = sent.withColumn("task", F.pmod(F.xxhash64("label", "filter", "b1", "b2"), F.lit(n_tasks)))
        found.append(sent.groupBy("task").applyInArrow(_task(threshold, kind), "u long, v long, n long"))
    if not found:
        none = rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
        return none
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    links = keep(links)
    root = components(spark, links.select("u", "v"))
    counts = links.groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    named = reps.join(counts, "rep", "left").join(root, F.col("rep") == F.col("node"), "left")
    named = named.select(F.col("label").alias("l"), F.col("v").alias("w"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    linked = valid.join(named, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w"))).select("id", "n_links", "component_id")
    alone = rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
