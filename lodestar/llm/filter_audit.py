"""Filter interaction audit: what five filters remove in each of their 120 orders, by part of the corpus.

One pass over the texts turns a document into a mask of the filters A-D that it fails and the SHA-256 of its text. Copies
are found by aggregation: rows of one text, part and label count together, and the smallest id of a text decides which of
them fail E. Inside tasks the masks index a precomputed table of first failures (32 masks by 120 orders); `np.bincount`
adds up (order, step, label), one array a part and task, and Spark sums the arrays. All columns follow from them.

Defined results: a null text is empty; a null part is the empty string. A null id is not smaller than any id and none is
smaller than it, so such rows never fail E nor make others fail it; they have no label. Rows that repeat an id with the same
text don't fail E through each other. Of an id's label rows any one counts. Texts are handled one at a time and split in
pieces, so a long one costs its distinct words. Empty tables give no rows. Only the columns named are read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import Written, table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
STEPS = len(FILTERS) + 1  # the last stands for documents that stay
E_BIT = 1 << FILTERS.index("E")
PIECE = 1 << 20
HELD = 64  # parts a task counts before it hands their arrays on

UPPER = bytes(range(65, 91))
LATER = bytes(range(128, 192))  # continuation bytes of UTF-8
JUNK = b"#$%&*|"


@dataclass(frozen=True)
class AuditParams:
    min_words: int = 100
    min_distinct_percent: int = 80
    max_upper_percent: int = 10


def first_failures() -> np.ndarray:
    """For each mask of failed filters and each order, the step (from 0) that removes the document; 5 if none does."""
    out = np.full((1 << len(FILTERS), len(ORDERS)), len(FILTERS), np.int64)
    for k, order in enumerate(ORDERS):
        for step in reversed(range(len(FILTERS))):
            fails = np.arange(len(out)) >> FILTERS.index(order[step]) & 1
            out[fails == 1, k] = step
    return out


def _words(raw: bytes) -> tuple[int, int]:
    """Words and distinct words, with one piece of the text split at a time."""
    if len(raw) <= PIECE:
        words = raw.split()
        return len(words), len(set(words))
    n, seen, rest = 0, set(), b""
    for low in range(0, len(raw), PIECE):
        part = rest + raw[low : low + PIECE]
        words = part.split()
        rest = words.pop() if words and not part[-1:].isspace() else b""
        n += len(words)
        seen.update(words)
    if rest:
        n += 1
        seen.add(rest)
    return n, len(seen)


def own_mask(raw: bytes, p: AuditParams) -> int:
    """The filters A to D that a text fails, as bits."""
    n, distinct = _words(raw)
    upper, points = len(raw) - len(raw.translate(None, UPPER)), len(raw.translate(None, LATER))
    junk = len(raw.translate(None, JUNK)) < len(raw)
    return (n < p.min_words) | (100 * distinct < p.min_distinct_percent * n) << 1 | (100 * upper > p.max_upper_percent * points) << 2 | junk << 3


def masks(docs: DataFrame, p: AuditParams = AuditParams(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask, key) of every row; key is the SHA-256 of the text."""
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            found = [(own_mask(t, p), hashlib.sha256(t).digest()) for t in (x.as_py() or b"" for x in texts)]
            cols = [pa.array([m for m, _ in found], pa.int32()), pa.array([k for _, k in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["id", "part", "mask", "key"])

    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"id {id_type.simpleString()}, part string, mask int, key binary")


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One array a part: counts by order, step and (all, good, toxic), flattened."""
    table_, at, size = first_failures(), np.arange(len(ORDERS)) * STEPS, len(ORDERS) * STEPS
    held: dict[str, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        parts = list(held)
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array([held[k].T.ravel() for k in parts], pa.list_(pa.int64()))], names=["part", "counts"])

    for batch in batches:
        for low in range(0, len(batch), 4096):
            piece = batch.slice(low, 4096)
            names, which = np.unique(np.array(piece.column(0).to_pylist(), object), return_inverse=True)
            mask, label, n, n_copies = (piece.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5))
            mask, n = np.concatenate([mask, mask | E_BIT]), np.concatenate([n - n_copies, n_copies])
            label, which = np.concatenate([label, label]), np.concatenate([which, which])
            key = (which[:, None] * size + at + table_[mask]).ravel()
            for k, weight in enumerate((n, n * (label & 1), n * (label >> 1))):
                sums = np.bincount(key, np.repeat(weight, len(ORDERS)), len(names) * size).astype(np.int64).reshape(len(names), size)
                for name, row in zip(names, sums, strict=True):
                    held.setdefault(name, np.zeros((3, size), np.int64))[k] += row
            if len(held) > HELD:
                yield out()
                held.clear()
    if held:
        yield out()


def audit(spark: SparkSession, docs: DataFrame, labels: DataFrame, p: AuditParams = AuditParams(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row a part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    keep = Written(spark)
    slim = keep(masks(docs, p, id_col, text_col, part_col))  # some 60 bytes a document, so that texts are read once
    counted = slim.where("id is not null").groupBy("id", "part", "mask", "key").agg(F.count("*").alias("n"))
    code = F.max((F.col("quality") == 1).cast("int")), F.max((F.col("toxic") == 1).cast("int"))
    of = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.coalesce(code[0], F.lit(0)) + 2 * F.coalesce(code[1], F.lit(0))).alias("label"))
    known = counted.join(of, "id", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    bare = slim.where("id is null").groupBy("id", "part", "mask", "key").agg(F.count("*").alias("n")).withColumn("label", F.lit(0))
    # An id has one label, so each group has one row of its smallest id, and all rows of a text become a few.
    has_id = F.col("id").isNotNull()
    groups = keep(
        known.unionByName(bare).groupBy("key", "part", "mask", "label")
        .agg(F.sum("n").alias("n"), F.sum(F.when(has_id, F.col("n")).otherwise(0)).alias("n_known"), F.min(F.when(has_id, F.struct("id", "n"))).alias("low"))
    )
    least = groups.groupBy("key").agg(F.min("low.id").alias("least"))
    first = F.when(F.col("low.id") == F.col("least"), F.col("low.n")).otherwise(0)
    rows = groups.join(least, "key").select("part", "mask", "label", "n", F.coalesce(F.col("n_known") - first, F.lit(0)).alias("n_copies"))
    arrays = rows.mapInArrow(_tally, "part string, counts array<bigint>")
    each = arrays.select("part", F.posexplode("counts").alias("at", "n")).groupBy("part", "at").agg(F.sum("n").alias("n"))
    place, kind = F.floor(F.col("at") / 3), F.col("at") % 3
    cell = each.groupBy("part", F.floor(place / STEPS).cast("int").alias("k"), (place % STEPS + 1).cast("int").alias("step")).agg(
        *(F.sum(F.when(kind == i, F.col("n")).otherwise(0)).alias(name) for i, name in enumerate(("removed", "good_lost", "toxic_lost")))
    )
    order = F.element_at(F.array(*map(F.lit, ORDERS)), F.col("k") + 1)
    later = Window.partitionBy("part", "k").orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cell = cell.withColumn("filter_order", order).withColumn("kept", F.coalesce(F.sum("removed").over(later), F.lit(0))).where(F.col("step") < STEPS)
    # What fails a filter is what it removes where it comes first; what fails it alone, where it comes last.
    of_filter = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    at_step = lambda s: F.max(F.when(F.col("step") == s, F.col("removed"))).over(of_filter)
    return cell.select(
        "part", "filter_order", "step", "kept", "removed", (at_step(1) - F.col("removed")).alias("redundant"), at_step(len(FILTERS)).alias("unique_fails"),
        "good_lost", "toxic_lost", F.sum("removed").over(of_filter).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""with recursive d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t, coalesce(lang, '') as part from documents),
  w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, min(doc_id) over (partition by t) as least from d),
  l as (select doc_id, coalesce(max((quality = 1)::int), 0) as good, coalesce(max((toxic = 1)::int), 0) as toxic from labels where doc_id is not null group by doc_id),
  m as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, (len(ws) < 100)::int + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::int
      + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > least, false)::int as mask from w left join l using (doc_id)),
  h as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by all),
  o as (select '' as filter_order, 0 as step union all select filter_order || f, step + 1 from o, (select unnest(['A', 'B', 'C', 'D', 'E']) as f) where not contains(filter_order, f)),
  orders as (select filter_order from o where step = 5),
  steps as (select filter_order, step, filter_order[step] as f, list_sum(list_transform(string_split(filter_order[:step - 1], ''), lambda x: coalesce(1 << (strpos('ABCDE', nullif(x, '')) - 1), 0))) as before,
      1 << (strpos('ABCDE', filter_order[step]) - 1) as bit from orders, (select unnest(range(1, 6)) as step)),
  cells as (select part, filter_order, step, f, coalesce(sum(n) filter (mask & coalesce(before, 0)::int = 0 and mask & bit = 0), 0)::bigint as kept, coalesce(sum(n) filter (mask & coalesce(before, 0)::int = 0 and mask & bit > 0), 0)::bigint as removed,
      coalesce(sum(n) filter (mask & coalesce(before, 0)::int > 0 and mask & bit > 0), 0)::bigint as redundant, coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
      coalesce(sum(good) filter (mask & coalesce(before, 0)::int = 0 and mask & bit > 0), 0)::bigint as good_lost, coalesce(sum(toxic) filter (mask & coalesce(before, 0)::int = 0 and mask & bit > 0), 0)::bigint as toxic_lost
    from h, steps group by part, filter_order, step, f, before, bit)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley from cells"""
