"""Vector and hybrid retrieval: exact cosine top-k, and reserved slots for what the call graph adds."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.graph import neighbours

# Fixed values.
DIMENSIONS = 1536
MAX_K = 50
SEEDS = 5
EXPANSION = 0.6
GRAPH_SHARE = 0.4
EMBED_BATCH, PRICE_PER_MILLION = 128, 0.02


def hash_vector(text: str, dimensions: int = DIMENSIONS) -> list[float]:
    """A unit vector from a stream of SHA-256 digests: the same for the same text, meaningless otherwise."""
    seed, raw, k = text.encode("utf-8", "surrogatepass"), b"", 0
    while len(raw) < 2 * dimensions:
        raw += hashlib.sha256(seed + k.to_bytes(4, "big")).digest()
        k += 1
    values = [int.from_bytes(raw[2 * i : 2 * i + 2], "big") / 32768.0 - 1.0 for i in range(dimensions)]
    norm = math.sqrt(math.fsum(v * v for v in values)) or 1.0
    return [v / norm for v in values]


def bind(value: Column, use) -> Column:
    """use(value) with the value computed once: a lambda's variable stands for it wherever `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hash_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """hash_vector() as built-in functions: SHA-256 of the text and a counter, two bytes a value; null stays null."""
    blocks = -(-2 * dimensions // 32)
    counted = lambda raw: F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.sha2(F.concat(raw, F.unhex(F.lpad(F.hex(k), 8, "0"))), 256))
    value = lambda digits, i: F.conv(F.substring(digits, i * 4 + 1, F.lit(4)), 16, 10).cast("double") / 32768.0 - 1.0
    values = lambda digits: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: value(digits, i))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = lambda v: bind(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x)))
    made = bind(F.encode(text, "UTF-8"), lambda raw: bind(F.array_join(counted(raw), ""), lambda digits: bind(values(digits), unit)))
    return F.when(text.isNotNull(), made)


class ProviderError(RuntimeError):
    """A provider broke its contract or failed; the message names it."""


def embed_batch(name: str, embed, texts: list[str], dimensions: int) -> list[list[float]]:
    """Vectors of texts in their order from embed(texts) -> [(index, vector)], in any order. Blank texts go as one space."""
    try:
        made = embed([t if t.strip() else " " for t in texts])
    except Exception as e:
        raise ProviderError(f"{name}: {type(e).__name__}: {e}") from e
    if sorted(i for i, _ in made) != list(range(len(texts))):
        raise ProviderError(f"{name}: {len(made)} vectors for {len(texts)} texts")
    ordered = [list(map(float, v)) for _, v in sorted(made, key=lambda x: x[0])]
    wrong = next((len(v) for v in ordered if len(v) != dimensions), None)
    if wrong is not None:
        raise ProviderError(f"{name}: a vector has {wrong} dimensions, not {dimensions}")
    return ordered


def embed_with(rows: DataFrame, name: str, embed, dimensions: int, text_col: str = "text", batch: int = 256) -> DataFrame:
    """rows with `embedding` from a provider, `batch` texts a call, each task its own calls; a null text has none."""
    schema = rows.withColumn("embedding", F.lit(None).cast("array<double>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for low in range(0, len(part), batch):
                piece = part.slice(low, batch)
                texts = piece.column(text_col).to_pylist()
                some = [t for t in texts if t is not None]
                vectors = iter(embed_batch(name, embed, some, dimensions) if some else [])
                made = pa.array([None if t is None else next(vectors) for t in texts], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*piece.columns, made], names=[*piece.schema.names, "embedding"])

    return rows.mapInArrow(run, schema)


def checked_width(vectors: DataFrame, column: str, dimensions: int) -> DataFrame:
    """The same table; reading a vector of another width fails."""
    wrong = F.concat(F.lit(f"{column} must have {dimensions} dimensions, not "), F.size(column).cast("string"))
    return vectors.withColumn(column, F.when(F.size(column) == dimensions, F.col(column)).otherwise(F.raise_error(wrong).cast(vectors.schema[column].dataType)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null where a vector is null or zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def top_k(vectors: DataFrame, query: DataFrame, k: int = 8, kinds: list | None = None, kind_col: str = "kind") -> DataFrame:
    """The k rows closest to the query vector, with `score`. query: one row (q). Each partition keeps k rows."""
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be between 1 and {MAX_K}, not {k}")
    pool = vectors if kinds is None else vectors.where(F.col(kind_col).isin(kinds))
    scored = pool.join(F.broadcast(query.select("q"))).withColumn("score", cosine(F.col("embedding"), F.col("q"))).drop("q")
    return scored.where(F.col("score").isNotNull()).orderBy(F.desc(F.round("score", 9)), "id").limit(k)


def hybrid(vectors: DataFrame, edges: DataFrame, query: DataFrame, k: int = 8, depth: int = 1, seeds: int = SEEDS) -> DataFrame:
    """(id, symbol_key, score, source, hops, seed): vector hits and the call-graph neighbourhood of the best ones.

    vectors: (id, symbol_key, part, embedding). A neighbour's score is its own cosine * 0.6 * its confidence; of k
    slots max(1, int(0.4 k)) at most go to neighbours that the wider vector search had not found. With k = 1 that
    slot is a neighbour's.
    """
    hits = top_k(vectors, query, min(MAX_K, max(k, 2 * seeds)))
    first = hits.orderBy(F.desc(F.round("score", 9)), "id").limit(seeds).where("symbol_key is not null").select(F.col("symbol_key").alias("node")).distinct()
    around = neighbours(edges, first, depth).join(hits.select(F.col("symbol_key").alias("node")), "node", "left_anti")
    pool = vectors.where("part = 0").join(around, vectors.symbol_key == around.node).join(F.broadcast(query.select("q")))
    scored = pool.withColumn("score", cosine(F.col("embedding"), F.col("q")) * EXPANSION * F.col("confidence"))
    slots = max(1, int(k * GRAPH_SHARE))
    graph = scored.orderBy(F.desc(F.round("score", 9)), "id").limit(min(slots, k)).select("id", "symbol_key", "score", F.lit("graph").alias("source"), "hops", "seed")
    taken = graph.agg(F.count("*").alias("taken"))
    ranked = hits.orderBy(F.desc(F.round("score", 9)), "id").limit(k).select("id", "symbol_key", "score", F.lit("vector").alias("source"), F.lit(None).cast("int").alias("hops"), F.lit(None).cast("string").alias("seed"))
    # k rows at most: numbering them in one task is free.
    position = F.size(F.filter(F.col("all_ids"), lambda x: (x["r"] < F.round(-F.col("score"), 9)) | ((x["r"] == F.round(-F.col("score"), 9)) & (x["id"] < F.col("id")))))
    listed = ranked.agg(F.collect_list(F.struct(F.round(-F.col("score"), 9).alias("r"), "id")).alias("all_ids"))
    kept = ranked.join(F.broadcast(listed)).join(F.broadcast(taken)).where(position < F.lit(k) - F.col("taken")).drop("all_ids", "taken")
    return kept.unionByName(graph).orderBy(F.desc(F.round("score", 9)), "id")


def search(vectors: DataFrame, edges: DataFrame, query: DataFrame, k: int = 8, mode: str = "hybrid", depth: int = 1, kinds: list | None = None) -> DataFrame:
    """Hybrid or vector search. A filter on kinds forces vector mode, since neighbours may be of any kind; depth is 1 or 2."""
    if not 1 <= depth <= 2:
        raise ValueError(f"depth must be 1 or 2, not {depth}")
    if mode == "vector" or kinds is not None:
        found = top_k(vectors, query, k, kinds)
        return found.select("id", "symbol_key", "score", F.lit("vector").alias("source"), F.lit(None).cast("int").alias("hops"), F.lit(None).cast("string").alias("seed"))
    return hybrid(vectors, edges, query, k, depth)


def payload(chunks: DataFrame, model: str, run_id: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """Chunks as vector rows stamped with the model and the run. A blank text is embedded as one space."""
    text = F.when(F.trim("text") == "", " ").otherwise(F.col("text"))
    return chunks.withColumn("embedding", hash_embedding(text, dimensions)).withColumn("model", F.lit(model)).withColumn("run_id", F.lit(run_id))


def embedding_cost(tokens: Column) -> Column:
    return tokens / 1e6 * PRICE_PER_MILLION
