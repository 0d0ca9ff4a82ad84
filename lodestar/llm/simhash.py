"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at distance 3 or less have a variant in the middle: one of them reaches it by at most
two flipped bits, the other by at most one. So every distinct fingerprint emits all its variants of up to one
flip, and of two flips where the meeting needs them: fingerprints of even parity flip two bits of the upper
half, odd ones two bits of the lower half. That is enough. At distance 3 the parities differ and one half
holds two of the three bits; the fingerprint whose half it is flips those two and the other one flips the
third. It makes 561 variants a fingerprint rather than 2,081, and loses no pair.

Variants are shuffled in packed blocks (a fingerprint and the number of its flip pattern: 10 bytes each) and
sorted in the bucket they hash to. Distinct fingerprints within two flips of one variant number 2,081 at most,
so no variant is hot, however many copies there are: copies of one fingerprint collapse before. A bucket links
each fingerprint to one that is within one flip of the variant, which triangle inequality makes a true link;
pairs are verified all the same. Links between all pairs of a group are never emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import Written, table
from lodestar.llm.components import components

RADIUS = 3
SEED = 42
SHINGLE = 3
VARIANTS_PER_BUCKET = 1 << 22
FINGERPRINTS_PER_BATCH = 512  # 5 MB of variants
FINGERPRINTS_PER_TASK = 8192


def fingerprint(text: str | None) -> int:
    """The signed 64-bit value of the SimHash over XXH64 of word 3-shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(whole, SEED)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(size)
        starts, stops = (ends - size)[: 1 - SHINGLE].tolist(), (ends[SHINGLE - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[a:b], SEED) for a, b in zip(starts, stops, strict=True)]
    h = np.array(hashes, ">u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 8192):  # bounded memory for very long texts
        ones += np.unpackbits(h[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=[id_col, "fp"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {id_type}, fp long")


def flip_patterns() -> tuple[np.ndarray, np.ndarray, int]:
    """The patterns of even and of odd fingerprints, and how many of the first have one flip at most."""
    one = [0] + [1 << i for i in range(64)]
    two = [[(1 << i) | (1 << j) for i in range(low, low + 32) for j in range(low, i)] for low in (32, 0)]
    return np.array(one + two[0], np.uint64), np.array(one + two[1], np.uint64), len(one)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _emit(n_buckets: int):
    even, odd, _ = flip_patterns()
    item = np.dtype([("fp", "<u8"), ("flip", "<u2")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, FINGERPRINTS_PER_BATCH):
                fp = whole.column(0).slice(at, FINGERPRINTS_PER_BATCH).to_numpy().view(np.uint64)
                parity = _popcount(fp) % 2
                variants = np.where((parity == 0)[:, None], fp[:, None] ^ even[None], fp[:, None] ^ odd[None])
                bucket = _bucket(variants, n_buckets).ravel()
                order = np.argsort(bucket, kind="stable")
                packed = np.empty(len(order), item)
                packed["fp"] = fp[order // len(even)]
                packed["flip"] = order % len(even)
                present, first = np.unique(bucket[order], return_index=True)
                edges = [*first.tolist(), len(order)]
                blobs = pa.array([packed[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(present.astype(np.int64)), blobs], names=["bucket", "block"])

    return run


def _bucket(variants: np.ndarray, n_buckets: int) -> np.ndarray:
    h = (variants ^ (variants >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(33)) % np.uint64(n_buckets)).astype(np.int32)


def meet(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among the packed variants of one bucket: each to one centre of its variant."""
    even, odd, near = flip_patterns()
    fp, flip = packed["fp"], packed["flip"]
    variant = fp ^ np.where(_popcount(fp) % 2 == 0, even[flip], odd[flip])
    # Within a variant, those of one flip at most come first.
    order = np.lexsort((fp, flip >= near, variant))
    variant, fp, is_near = variant[order], fp[order], (flip < near)[order]
    new = np.ones(len(variant), bool)
    new[1:] = variant[1:] != variant[:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    link = ~new & is_near[first]
    u, v = fp[first][link], fp[link]
    true = (u != v) & (_popcount(u ^ v) <= RADIUS)
    pairs = np.unique(np.stack([u[true], v[true]], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def links(distinct: DataFrame, n: int) -> DataFrame:
    """(u, v): links of the distinct fingerprints `fp` that keep every component of 'distance 3 or less'."""
    patterns = len(flip_patterns()[0])
    n_buckets = max(256, -(-n * patterns // VARIANTS_PER_BUCKET))
    item = np.dtype([("fp", "<u8"), ("flip", "<u2")])

    def joined(rows):
        u, v = meet(np.concatenate([np.frombuffer(b, item) for b in rows.column("block").to_pylist()]))
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    spread = distinct.select("fp").repartition(max(1, -(-n // FINGERPRINTS_PER_TASK)), "fp")
    return spread.mapInArrow(_emit(n_buckets), "bucket long, block binary").groupBy("bucket").applyInArrow(joined, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, fingerprint (16 lowercase hex digits), component_id (smallest id reachable).

    Null and empty texts, and those without words, have fingerprint zero and link like any other. Repeated rows
    and exact copies share a fingerprint. A null id is never a component's smallest unless all are null. Very long texts
    count whole, in bounded pieces; an empty table gives no rows; other columns may have any name. Copies of one fingerprint
    meet again in the last join only, whose large partitions the adaptive plan splits.
    """
    spark = docs.sparkSession
    keep = Written(spark)
    of = keep(fingerprints(docs, id_col, text_col))
    distinct = keep(of.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n_rows")))
    root = components(spark, links(distinct, distinct.count()))
    linked = distinct.join(root, distinct.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "root").select("fp", "component_id")
    return of.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that with the smallest id, a missing id last, then with the smallest hash of its text.

    Rows are told apart by id and a hash of all they hold, so rows that share an id or have none stay unless they are near-duplicates.
    What agrees in all of that is a copy; copies combine before the shuffle or in the partitions of the join. Columns may have any name.
    """
    names = [f"`{c}`" for c in docs.columns]
    hashed = [F.col(f"`{c}`") for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64("text").alias("text"), F.xxhash64(*hashed).alias("all"))
    rows = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key.alias("key")).alias("row"), "text")
    kept = near_duplicates(rows, "row").select(*[F.col(f"component_id.key.{c}").alias(c) for c in ("none", "id", "text", "all")]).distinct()
    one = docs.select(F.struct(*names).alias("row"), *[key.getField(c).alias(c) for c in ("none", "id", "text", "all")])
    one = one.join(kept, ["none", "id", "text", "all"], "left_semi").dropDuplicates(["none", "id", "text", "all"])
    return one.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
