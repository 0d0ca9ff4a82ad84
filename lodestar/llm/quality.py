"""Quality rules: a calibrated logistic regression over hashed word and character n-grams, and fixed text rules.

The model is fitted on a bounded sample of the labelled rows (`QualityParams.sample_per_class` ids of each class,
those with the smallest hash, so reruns agree; one text an id and `max_features` features a text, so the bound
holds in rows and bytes) and calibrated on a part of it held out. Every whole text is then scored in Arrow batches
against a fixed threshold. Features are hashed; the counts of the rules are exact.

Defined results: a null or empty text has no words, so it fails the rules. Rows with a null label, or whose
id is null or not in the documents, do not train; of an id's labels the smallest counts, of its texts the one with
the smallest hash. With fewer than `min_per_class` labelled rows of either class there is no model: the probability
is null and the rules alone decide. Repeated rows are scored each on its own. Very long texts are scored whole, in
pieces of bounded memory. Empty tables give empty results. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import table
from lodestar.llm.hashing import BYTE_CODE, mix, span_hashes, word_spans


@dataclass(frozen=True)
class QualityParams:
    sample_per_class: int = 1000
    max_features: int = 8192  # a sampled text trains with its most frequent ones
    min_per_class: int = 8
    held_out: int = 4  # every fourth row of the sample calibrates
    bits: int = 14  # hashed features for words, and as many for characters
    char_n: int = 4
    threshold: float = 0.5  # documents whose probability of good quality is below it are rejected
    rounds: int = 150
    rate: float = 0.5
    l2: float = 1e-4
    min_words: int = 50
    max_repeat_percent: int = 50


@dataclass(frozen=True)
class QualityModel:
    """Weights by hashed feature; the score a*x+b of the weighted sum is a calibrated log-odds."""

    weights: np.ndarray
    a: float
    b: float

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * raw + self.b, -40, 40)))


PIECE = 1 << 18
BLOCK = 64


def feature_counts(raw: bytes, hashes: np.ndarray, p: QualityParams) -> tuple[np.ndarray, np.ndarray]:
    """How often each hashed word uni- or bigram occurs, and each hashed character n-gram (bytes)."""
    shift, size = np.uint64(64 - p.bits), 1 << p.bits
    words, chars = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for low in range(0, len(hashes), PIECE):
        one = hashes[low : low + PIECE + 1]
        words += np.bincount((one[:PIECE] >> shift).astype(np.int64), minlength=size)
        if len(one) > 1:
            words += np.bincount((mix(one[:-1] * np.uint64(3) + one[1:]) >> shift).astype(np.int64), minlength=size)
    data = np.frombuffer(raw, np.uint8)
    for low in range(0, len(data) - p.char_n + 1, PIECE):
        part = data[low : low + PIECE + p.char_n - 1]
        h = np.zeros(len(part) - p.char_n + 1, np.uint64)
        for k in range(p.char_n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + BYTE_CODE[part[k : k + len(h)]]
        chars += np.bincount((h >> shift).astype(np.int64), minlength=size)
    return words, chars


def repeated_words(raw: bytes, hashes: np.ndarray) -> int:
    """Words in 3-word windows found twice or more. Hashes find candidates; the words of each are compared."""
    n = len(hashes)
    if n < 4:
        return 0
    window = mix(mix(hashes[:-2] * np.uint64(3) + hashes[1:-1]) * np.uint64(5) + hashes[2:])
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    if not same.any():
        return 0
    again, before = order[1:][same], order[:-1][same]
    words = raw.split()
    if any(words[a : a + 3] != words[b : b + 3] for a, b in zip(again.tolist(), before.tolist(), strict=True)):
        seen: dict[tuple, list[int]] = {}  # different windows share a hash: the candidates are grouped by their words
        for k in {*again.tolist(), *before.tolist()}:
            seen.setdefault(tuple(words[k : k + 3]), []).append(k)
        again = before = np.array([k for places in seen.values() if len(places) > 1 for k in places], np.int64)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[again + k] = covered[before + k] = True
    return int(covered.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int, bytes, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; then what scoring reuses: the bytes and the words' hashes."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    starts, ends = word_spans(raw)
    hashes = span_hashes(raw, starts, ends)
    word_chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    n_symbols = sum(raw.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    n_dup_lines, seen = 0, set()
    for line in raw.split(b"\n"):
        if line.split(None, 1):
            n_dup_lines += line in seen
            seen.add(line)
    return len(starts), word_chars, n_symbols, n_dup_lines, repeated_words(raw, hashes), raw, hashes


def fails_rules(n_words: int, n_repeat_words: int, p: QualityParams) -> bool:
    return n_words < p.min_words or 100 * n_repeat_words > p.max_repeat_percent * n_words


def labelled_sample(docs: DataFrame, labels: DataFrame, p: QualityParams) -> DataFrame:
    """(doc_id, y, text) of at most sample_per_class rows a class, one an id; the ids are few by that bound, so they are broadcast."""
    rows = labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"))
    of = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample_per_class) for y in (0, 1)]
    chosen = of[0].union(of[1])
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text"))).alias("one")  # a row an id before the shuffle
    return texts.groupBy("doc_id", "y").agg(one).select("doc_id", "y", "one.text")


def _sparse_rows(p: QualityParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                *_, raw, hashes = base_counts(text)
                share = np.concatenate([c / max(1, c.sum()) for c in feature_counts(raw, hashes, p)])
                ids = np.flatnonzero(share)
                ids = np.sort(ids[np.argsort(-share[ids], kind="stable")[: p.max_features]])
                out.append((ids.astype(np.int32).tobytes(), share[ids].astype(np.float32).tobytes()))
            cols = [pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *cols], names=["doc_id", "y", "ids", "values"])

    return run


def fit(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> QualityModel | None:
    """The driver gets one bounded sparse vector a sampled row: at most max_features each."""
    sample = labelled_sample(docs, labels, p)
    id_type = sample.schema["doc_id"].dataType.simpleString()  # ids are only ordered, whatever their type
    found = sample.mapInArrow(_sparse_rows(p), f"doc_id {id_type}, y int, ids binary, values binary").collect()
    found.sort(key=lambda r: (r.doc_id, r.y, r.ids, r.values))
    y = np.array([r.y for r in found], float)
    if min((y == 0).sum(), (y == 1).sum()) < p.min_per_class:
        return None
    ids = [np.frombuffer(r.ids, np.int32) for r in found]
    values = [np.frombuffer(r["values"], np.float32) for r in found]
    model = train(ids, values, y, p)
    # The sample takes classes alike; the log-odds move to the classes' shares among all labelled rows.
    share = {r.quality: r["count"] for r in labels.where("quality in (0, 1)").groupBy(F.col("quality").cast("int").alias("quality")).count().collect()}
    shift = np.log(share[1] / share[0]) - np.log((y == 1).sum() / (y == 0).sum())
    return QualityModel(model.weights, model.a, model.b + float(shift))


def train(ids: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, p: QualityParams) -> QualityModel:
    """Full-batch gradient descent with per-weight rates; classes count alike. Then Platt's scaling on rows held out.

    Each step goes over blocks of rows and adds up, so what it holds besides the sample is of one block.
    """
    held = np.zeros(len(y), bool)
    for c in (0, 1):  # of both classes
        held[np.flatnonzero(y == c)[:: p.held_out]] = True
    size, blocks = 2 << p.bits, []
    for low in range(0, len(y), BLOCK):
        n = [len(i) for i in ids[low : low + BLOCK]]
        # Square roots keep frequent features from ruling.
        blocks.append((low, low + len(n), np.repeat(np.arange(len(n), dtype=np.int32), n), np.concatenate(ids[low : low + BLOCK]), np.sqrt(np.concatenate(values[low : low + BLOCK]))))

    def sums(w: np.ndarray) -> np.ndarray:
        w = w.astype(np.float32)
        return np.concatenate([np.bincount(row, w[col] * val, high - low) for low, high, row, col, val in blocks])

    w, bias, grad2 = np.zeros(size), 0.0, np.full(size, 1e-8)
    weight = np.where(y == 1, 0.5 / max(1, (y[~held] == 1).sum()), 0.5 / max(1, (y[~held] == 0).sum())) * ~held
    for _ in range(p.rounds):
        z = sums(w) + bias
        r = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        g, r32 = p.l2 * w, r.astype(np.float32)
        for low, high, row, col, val in blocks:
            g += np.bincount(col, r32[low:high][row] * val, size)
        grad2 += g * g
        w -= p.rate * g / np.sqrt(grad2)
        bias -= p.rate * r.sum()
    z = sums(w) + bias
    a, b = platt(z[held], y[held])
    return QualityModel(w.astype(np.float32), a, a * bias + b)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps for the logistic curve a*z+b, with Platt's smoothed targets."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        s = np.maximum(q * (1 - q), 1e-9)
        g = np.array([((q - t) * z).sum() + 1e-3 * (a - 1), (q - t).sum()])
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
        if abs(step).max() < 1e-8:
            break
    return max(a, 1e-6), b


def raw_score(weights: np.ndarray, counts: tuple[np.ndarray, np.ndarray]) -> float:
    """The weighted sum over square roots of the features' shares, as in training."""
    total, low = 0.0, 0
    for c in counts:
        if n := c.sum():
            total += float(np.sqrt(c / n) @ weights[low : low + len(c)])
        low += len(c)
    return total


SCORED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"


def score(docs: DataFrame, model: QualityModel | None, p: QualityParams = QualityParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, the counts, base_failed, probability (null without a model), kept."""
    id_type = docs.schema[id_col].dataType
    held = model and docs.sparkSession.sparkContext.broadcast((model.weights, model.a, model.b))  # 2**(bits+1) floats, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held and QualityModel(*held.value)
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]
        types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                n, chars, symbols, lines, repeat, raw, hashes = base_counts(text)
                failed = fails_rules(n, repeat, p)
                prob = None if m is None else float(m.probability(np.float64(raw_score(m.weights, feature_counts(raw, hashes, p)))))
                rows.append((n, chars, symbols, lines, repeat, failed, prob, not failed and (prob is None or prob >= p.threshold)))
            if rows:
                cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[id_col, *names])

    slim = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return slim.mapInArrow(run, f"`{id_col}` {id_type.simpleString()}, {SCORED}")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules and the model keep, with their own columns; a pure filter, so nothing joins back.

    Null and empty texts go; rows that repeat, ids that are null and columns of any name stay as they are; an empty table stays empty.
    """
    p = QualityParams()
    model = fit(docs, table(spark, sf_dir, "labels"), p)
    held = model and spark.sparkContext.broadcast((model.weights, model.a, model.b))

    @F.pandas_udf("boolean")
    def keeps(texts):
        m = held and QualityModel(*held.value)

        def one(text):
            n, _, _, _, repeat, raw, hashes = base_counts(text)
            if fails_rules(n, repeat, p):
                return False
            return m is None or float(m.probability(np.float64(raw_score(m.weights, feature_counts(raw, hashes, p))))) >= p.threshold

        return texts.map(one).astype(bool)

    return docs.where(keeps(F.col("text")))
