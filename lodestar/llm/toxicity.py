"""Toxicity: a factorization machine over hashed terms.

Terms are lower-cased words and the first bytes of longer words (stems), hashed. A text's value of a term is the logarithm
of its frequency, so a long text with many insults and a short one with few look alike. The score is the logistic of
    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),
in which the second sum is that of all pairs <v_i, v_j> x_i x_j: an insult weighs more beside a mention of whom it is for.

It is fitted on a bounded sample of the labelled rows that may train (`ToxicityParams.sample_per_class` ids a class, those
with the smallest hash; one text an id; `max_terms` terms a text), and calibrated on a part of them that it didn't see.
Terms that fewer than `min_texts` sampled texts hold have no weight. Every whole text is then scored in Arrow batches.

Defined results: a null or empty text has no terms and scores as such. Ids in the held-out third never train, whatever their
label; null ids are not held out and have no label. Rows with a null label or whose id has no document do not train; of an id's
labels the largest counts, of its texts the one with the smallest hash. With fewer than `min_per_class` labelled rows
of a class there is no model and every score is 0. Repeated rows are scored each on its own, very long texts whole, in memory
of some 40 bytes a word. Empty tables give empty results. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import table
from lodestar.llm.hashing import mix, span_hashes, word_spans
from lodestar.llm.quality import platt

#: Capital letters become small, whatever else of ASCII is no letter or digit becomes a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class ToxicityParams:
    sample_per_class: int = 2000
    max_terms: int = 2048  # a sampled text trains with its most frequent ones
    min_per_class: int = 8
    min_texts: int = 8
    association: float = 3.0
    common: float = 0.5  # share of the sampled texts
    calibrate: int = 5  # every fifth row of the sample calibrates
    bits: int = 18
    stems: tuple[int, ...] = (4, 5, 7)  # bytes
    scale: float = 100.0
    factors: int = 4
    rounds: int = 100
    rate: float = 0.1
    l2: float = 1e-3
    threshold: float = 0.7
    parts: int = 3  # ids whose CRC-32 leaves `held` modulo `parts` never train
    held: int = 1


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of the terms that have some: their ids ascend; a and b calibrate."""

    ids: np.ndarray
    w: np.ndarray
    v: np.ndarray
    w0: float
    a: float
    b: float

    def raw(self, ids: np.ndarray, x: np.ndarray) -> float:
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        known = self.ids[at] == ids
        at, x = at[known], x[known]
        vx = self.v[at] * x[:, None]
        return float(self.w0 + self.w[at] @ x + 0.5 * (vx.sum(0) ** 2 - (vx * vx).sum(0)).sum())

    def score(self, ids: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.raw(ids, x) + self.b, -40, 40))))


def terms(raw: bytes, p: ToxicityParams) -> tuple[np.ndarray, np.ndarray]:
    """The hashed terms of a text, ascending, and their values."""
    data = raw.translate(FOLD)
    starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0)
    kinds = [span_hashes(data, starts, ends)]
    for n in p.stems:
        longer = ends - starts > n
        kinds.append(mix(span_hashes(data, starts[longer], starts[longer] + n) + np.uint64(n)))
    ids, counts = np.unique(np.concatenate(kinds) >> np.uint64(64 - p.bits), return_counts=True)
    return ids.astype(np.int64), np.log1p(counts * (p.scale / (len(starts) + 20)))


BLOCK = 128  # rows whose products are held at once


def chosen_terms(ids: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, p: ToxicityParams) -> np.ndarray:
    """Terms whose mean value differs between the classes by `association` standard errors, and those common enough to be context."""
    some, at, count = np.unique(np.concatenate(ids), return_inverse=True, return_counts=True)
    x, toxic = np.concatenate(values), np.repeat(y == 1, [len(i) for i in ids])
    far, spread = np.zeros(len(some)), np.zeros(len(some))
    for side, sign in ((toxic, 1), (~toxic, -1)):
        n = max(1, ((y == 1) == (sign > 0)).sum())
        mean, square = np.bincount(at[side], x[side], len(some)) / n, np.bincount(at[side], x[side] ** 2, len(some)) / n
        far += sign * mean
        spread += (square - mean**2) / n
    keep = (count >= p.min_texts) & ((np.abs(far) >= p.association * np.sqrt(np.maximum(spread, 0))) | (count >= p.common * len(y)))
    return some[keep] if keep.any() else some[:1]


def train(ids: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, p: ToxicityParams) -> ToxicityModel:
    """Adam over all rows not held back for calibration, classes alike; what it holds besides the sample is of one block."""
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        held[np.flatnonzero(y == c)[:: p.calibrate]] = True
    some = chosen_terms([i for i, back in zip(ids, held, strict=True) if not back], [x for x, back in zip(values, held, strict=True) if not back], y[~held], p)
    rows = []
    for i, x in zip(ids, values, strict=True):
        at = np.minimum(np.searchsorted(some, i), len(some) - 1)
        known = some[at] == i
        rows.append((at[known].astype(np.int32), x[known].astype(np.float32)))
    blocks = []
    for low in range(0, len(y), BLOCK):
        part = rows[low : low + BLOCK]
        n = [len(at) for at, _ in part]
        blocks.append((low, np.repeat(np.arange(len(n)), n), np.concatenate([at for at, _ in part]), np.concatenate([x for _, x in part])))
    size, k = len(some), p.factors
    weight = np.where(y == 1, 0.5 / max(1, (y[~held] == 1).sum()), 0.5 / max(1, (y[~held] == 0).sum())) * ~held
    theta = np.zeros((size + 1, k + 1))  # the last row's first entry is w0; columns are w and the factors
    theta[:size, 1:] = np.random.Generator(np.random.PCG64(7)).normal(0, 0.05, (size, k))
    first, second = np.zeros_like(theta), np.zeros_like(theta)

    def forward(block) -> tuple[np.ndarray, np.ndarray]:
        low, row, col, x = block
        m = min(BLOCK, len(y) - low)
        sums = np.stack([np.bincount(row, theta[col, f] * x, m) for f in range(k + 1)], 1)
        squares = np.bincount(row, (theta[col, 1:] ** 2).sum(1) * x * x, m)
        return theta[size, 0] + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - squares), sums

    for t in range(1, p.rounds + 1):
        g = p.l2 * theta
        g[size] = 0
        for block in blocks:
            low, row, col, x = block
            z, sums = forward(block)
            r = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[low : low + len(z)]) * weight[low : low + len(z)]
            rx = r[row] * x
            g[:size, 0] += np.bincount(col, rx, size)
            for f in range(1, k + 1):  # the derivative of the pairs by v_if
                g[:size, f] += np.bincount(col, rx * (sums[row, f] - theta[col, f] * x), size)
            g[size, 0] += r.sum()
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        theta -= p.rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    z = np.concatenate([forward(block)[0] for block in blocks])
    a, b = platt(z[held], y[held])
    return ToxicityModel(some, theta[:size, 0].copy(), theta[:size, 1:].copy(), float(theta[size, 0]), a, b)


def crc(id_: Column) -> Column:
    return F.crc32(id_.cast("string").cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, p: ToxicityParams, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, y, text) of at most sample_per_class rows a class, one an id; the chosen ids are few by that bound, so they are broadcast."""
    known = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(crc(F.col("id")) % p.parts != p.held).groupBy("id").agg(F.max("y").alias("y"))
    of = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(p.sample_per_class) for y in (0, 1)]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(of[0].union(of[1])), "id")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text"))).alias("one")  # a row an id before the shuffle
    return texts.groupBy("id", "y").agg(one).select(F.xxhash64("id").alias("order"), F.col("id").cast("string").alias("id"), "y", "one.text")


def _sparse_rows(p: ToxicityParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(3).to_pylist():
                ids, x = terms((text or "").encode("utf-8", "surrogatepass"), p)
                most = np.sort(np.argsort(-x, kind="stable")[: p.max_terms])
                out.append((ids[most].astype(np.int32).tobytes(), x[most].astype(np.float32).tobytes()))
            cols = [pa.array([o[k] for o in out], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], names=["order", "id", "y", "ids", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams(), id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel | None:
    """The driver gets one bounded sparse vector a sampled row: at most max_terms each."""
    sample = labelled_sample(docs, labels, p, id_col, text_col)
    found = sample.mapInArrow(_sparse_rows(p), "order long, id string, y int, ids binary, x binary").collect()
    found.sort(key=lambda r: (r.order, r.id))
    y = np.array([r.y for r in found], float)
    if min((y == 0).sum(), (y == 1).sum()) < p.min_per_class:
        return None
    model = train([np.frombuffer(r.ids, np.int32).astype(np.int64) for r in found], [np.frombuffer(r.x, np.float32) for r in found], y, p)
    # The sample takes classes alike; the log-odds move to the classes' shares among all rows that may train.
    of = labels.where(F.col("toxic").isin(0, 1) & (crc(F.col(id_col)) % p.parts != p.held)).groupBy(F.col("toxic").cast("int").alias("toxic")).count().collect()
    share = {r.toxic: r["count"] for r in of}
    shift = np.log(share[1] / share[0]) - np.log((y == 1).sum() / (y == 0).sum())
    return ToxicityModel(model.ids, model.w, model.v, model.w0, model.a, model.b + float(shift))


def score(docs: DataFrame, model: ToxicityModel | None, p: ToxicityParams = ToxicityParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, held_out, score, predicted."""
    id_type = docs.schema[id_col].dataType
    held = model and docs.sparkSession.sparkContext.broadcast(model)  # at most 2**bits terms, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            found = [held.value.score(*terms(t.as_py() or b"", p)) if held else 0.0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["id", "score"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = slim.mapInArrow(run, f"id {id_type.simpleString()}, score double")
    out = F.coalesce(crc(F.col("id")) % p.parts == p.held, F.lit(False))
    return scored.select(F.col("id").alias(id_col), out.alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
