"""Substring dedup by relative Lempel-Ziv parsing against every reference block, word by word.

Documents fall into reference blocks whose size grows with the corpus. A phrase is 35 consecutive words. Each
block is indexed by phrase, and the indexes of all blocks are merged by hash: a phrase that several blocks hold
is offered a reference block, along a tree over block numbers, so that no block answers for more than
`FAN` - 1 others a level, however common a passage is.

Every document is then factored greedily, left to right: at each phrase that has a reference, a factor goes on while the
next phrases have one in the same block (places that follow each other are asked for in the own block only, where two places
of a phrase are known). The next factor starts at the first phrase after those, so phrases across the boundary of two
factors are looked up too. The words under factors, each at least 35 long, are those that go.

No hash decides this. A block sends the words of its phrases that have a reference to the block of that
reference, once a phrase; there they are factored against its words, compared byte for byte, and extended as far
as both agree: these are the factors of the second table, with block, place and length. (The smallest holder of a
phrase refers to the next one, whose words or whose reference's words were compared with its own, so it sends none.) What a hash promised and
words don't keep (a clash) is settled by the words themselves: all texts of such a phrase are counted over all
blocks, and the documents of the blocks that hold it are factored again.

Defined results: null, empty and short texts have no phrase and keep all their words; repeated rows repeat each
other's phrases, so those of at least 35 words keep none (of very many equal rows two are parsed and stand for all); an empty table gives an empty result; very long texts
stay whole in their block and are hashed in bounded pieces. Only the columns named are read, so others may have
any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import Written, table
from lodestar.llm.hashing import span_hashes

PHRASE = 35
FAN = 8
BLOCK_BYTES = (2 << 20, 32 << 20)  # least and most
BUCKETS_PER_BLOCK_BYTES = 4
TASK_BLOCKS = 4
HOT_ROWS, HOT_KEYS = 64, 100_000  # rows with more copies than HOT_ROWS and than a HOT_KEYS-th of all rows are parsed twice only


class Phrases:
    """The phrases of single-spaced texts that all have one, in one buffer; places count its words."""

    def __init__(self, texts: list[bytes], length: int, hashed: bool = True):
        self.length, self.text = length, b"\n".join(texts)
        data = np.frombuffer(self.text, np.uint8)
        gap = np.flatnonzero((data == 32) | (data == 10))
        if texts:
            self.starts, self.ends = np.concatenate([[0], gap + 1]), np.concatenate([gap, [len(data)]])
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.flatnonzero(data[gap] == 10) + 1])[: len(texts)]  # word of each text
        last = np.concatenate([self.first[1:], [len(self.starts)]])[: len(texts)]
        whole = np.ones(len(self.starts), bool)
        whole[(last[:, None] - np.arange(1, length)).ravel()] = False
        self.place = np.flatnonzero(whole)
        self.hash = span_hashes(data, self.starts[self.place], self.ends[self.place + length - 1]) if hashed else None

    def words(self, a: int, b: int) -> bytes:
        return self.text[self.starts[a] : self.ends[b - 1]]


def same_words(a: Phrases, i: np.ndarray, b: Phrases, j: np.ndarray) -> np.ndarray:
    """Whether phrases i of a and j of b have the same words, pair by pair; pairs that advance together compare at once."""
    same, n = np.ones(len(i), bool), a.length
    p, q = a.place[i], b.place[j]
    cuts = [0, *(np.flatnonzero((np.diff(p) != 1) | (np.diff(q) != 1)) + 1).tolist(), len(i)]
    for x, y in zip(cuts, cuts[1:], strict=False):
        if x < y and a.words(p[x], p[y - 1] + n) != b.words(q[x], q[y - 1] + n):
            same[x:y] = [a.words(p[k], p[k] + n) == b.words(q[k], q[k] + n) for k in range(x, y)]
    return same


class Block:
    """A reference block: its documents in order of their words, its distinct phrases and their first two places."""

    def __init__(self, raws: list[bytes | None], length: int):
        self.norm = [b" ".join((raw or b"").split()) for raw in raws]
        self.n_words = [t.count(b" ") + 1 if t else 0 for t in self.norm]
        self.docs = sorted((k for k, n in enumerate(self.n_words) if n >= length), key=self.norm.__getitem__)
        self.phrases = Phrases([self.norm[k] for k in self.docs], length)
        h = self.phrases.hash
        order = np.argsort(h, kind="stable")
        new = np.ones(len(h), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        edge = np.flatnonzero(new)
        self.distinct, self.count = h[order][edge], np.diff(edge, append=len(h))
        self.of = np.empty(len(h), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.least, self.second = order[edge], order[np.minimum(edge + 1, max(0, len(h) - 1))]

    def bucket(self, n_buckets: int) -> np.ndarray:
        """The bucket of each distinct phrase; ascends with the hash."""
        return ((self.distinct >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)

    def clashes(self) -> np.ndarray:
        """Hashes that phrases of different words share in this block."""
        i = np.flatnonzero(self.least[self.of] != np.arange(len(self.of)))
        return np.unique(self.phrases.hash[i[~same_words(self.phrases, i, self.phrases, self.least[self.of[i]])]])


def runs(go_on: np.ndarray) -> np.ndarray:
    """How many steps in a row each place has, itself included. go_on: whether the next place continues this one."""
    stops = np.flatnonzero(~go_on)
    return stops[np.searchsorted(stops, np.arange(len(go_on)))] - np.arange(len(go_on)) + 1


def going_on(place: np.ndarray, partner: np.ndarray, has: np.ndarray) -> np.ndarray:
    """Whether each phrase is continued by the next one at the place after its partner's."""
    out = np.zeros(len(place), bool)
    out[:-1] = has[:-1] & has[1:] & (np.diff(place) == 1) & (np.diff(partner) == 1)
    return out


def factors(found: np.ndarray, reach: np.ndarray, place: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Greedy factors (first word, end) of one document. reach: for how many phrases the longest factor at each goes on."""
    out, k, hits = [], 0, np.flatnonzero(found)
    while k < len(hits):
        w = hits[k]
        n = int(reach[w])
        out.append((int(place[w]), int(place[w]) + n - 1 + length))
        k = int(np.searchsorted(hits, w + n))
    return out


def documents(block: Block, found: np.ndarray, reach: np.ndarray, with_text: bool) -> dict[str, list]:
    """n_words, n_removed, n_factors, kept and spans (words, start:end) of each document, in the order they came."""
    ph, length = block.phrases, block.phrases.length
    n = len(block.norm)
    out = {"n_words": block.n_words, "n_removed": [0] * n, "n_factors": [0] * n, "kept": list(block.norm), "spans": [""] * n}
    edge = np.searchsorted(ph.place, [*ph.first.tolist(), len(ph.starts)]).tolist()
    for d, k in enumerate(block.docs):
        low, high = edge[d], edge[d + 1]
        if not found[low:high].any():
            continue
        cut = factors(found[low:high], reach[low:high], ph.place[low:high], length)
        at, first = int(ph.first[d]), int(ph.first[d])
        kept, spans = [], []
        for a, b in cut:
            if a > at:
                kept.append(ph.words(at, a))
            if spans and a <= spans[-1][1]:
                spans[-1][1] = b
            else:
                spans.append([a, b])
            at = b
        if at < first + block.n_words[k]:
            kept.append(ph.words(at, first + block.n_words[k]))
        out["n_removed"][k] = sum(b - a for a, b in spans)
        out["n_factors"][k] = len(cut)
        out["kept"][k] = b" ".join(kept)
        out["spans"][k] = ",".join(f"{a - first}:{b - first}" for a, b in spans)
    out["kept"] = [t.decode("utf-8", "replace") if with_text else hashlib.sha256(t).hexdigest() for t in out["kept"]]
    return out


# --- the index of all blocks ----------------------------------------------------------------------------------


def _index(n_buckets: int, length: int):
    def run(key, rows):
        block = Block(rows.column("raw").to_pylist(), length)
        present, first = np.unique(block.bucket(n_buckets), return_index=True)
        edge = [*first.tolist(), len(block.distinct)]
        return pa.table({
            "bucket": pa.array(present, pa.int64()),
            "block": pa.array([key[0].as_py()] * len(present), pa.int64()),
            "phrases": pa.array([block.distinct[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)], pa.binary()),
        })

    return run


def merge(blocks: list[int], lists: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block and phrase: whether another block holds it too, its reference block, whether a block refers here, and
    whether the block is the smallest that holds it.

    It is the smallest holder among the FAN blocks next to it in number, or where the block is that itself, among
    FAN * FAN, and so on; the smallest of all refers to the next. Phrases of one passage so keep one reference.
    """
    size = [len(x) for x in lists]
    every, source = np.concatenate(lists), np.repeat(np.array(blocks, np.int64), size)
    by_block = np.argsort(source, kind="stable")
    order = by_block[np.argsort(every[by_block], kind="stable")]
    h = every[order]
    shared = np.zeros(len(h), bool)
    shared[1:] = h[1:] == h[:-1]
    shared[:-1] |= shared[1:]
    at = order[shared]
    h, block = every[at], source[at]
    reference, asked, least = np.full(len(at), -1, np.int64), np.zeros(len(at), bool), np.zeros(len(at), bool)
    width, most = FAN, max(blocks) + 1
    while len(at) and (reference < 0).any():
        new = np.ones(len(at), bool)
        group = block // width if width < most * FAN else np.zeros(len(at), np.int64)
        new[1:] = (h[1:] != h[:-1]) | (group[1:] != group[:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        to = block[first]
        if width >= most * FAN:  # the smallest of all
            own = np.flatnonzero(new)
            to[own], least[own] = block[own + 1], True
        now = (reference < 0) & (to != block)
        asked[first[now & ~least]] = True
        reference = np.where(now, to, reference)
        width *= FAN
    out = [np.zeros(len(every), kind) for kind in (bool, np.int64, bool, bool)]
    for whole, values in zip(out, (True, reference, asked, least), strict=True):
        whole[at] = values
    ends = np.cumsum(size)
    return [tuple(whole[e - n : e] for whole in out) for e, n in zip(ends, size, strict=True)]


def _merge(key, rows):
    blocks = rows.column("block").to_pylist()
    out = merge(blocks, [np.frombuffer(b, np.uint64) for b in rows.column("phrases").to_pylist()])
    return pa.table({
        "block": pa.array(blocks, pa.int64()),
        "bucket": pa.array([key[0].as_py()] * len(blocks), pa.int64()),
        "found": pa.array([np.packbits(f).tobytes() for f, *_ in out], pa.binary()),
        "reference": pa.array([r[f].astype(np.int32).tobytes() for f, r, *_ in out], pa.binary()),
        "asked": pa.array([np.packbits(a[f]).tobytes() for f, _, a, _ in out], pa.binary()),
        "least": pa.array([np.packbits(x[f]).tobytes() for f, _, _, x in out], pa.binary()),
    })


# --- parsing --------------------------------------------------------------------------------------------------

PARSED = "m long, block long, n_words long, n_removed long, n_factors long, kept string, spans string, reference long, starts binary, phrases binary, found binary, clash long"
_TYPES = {"m": pa.int64(), "block": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "n_factors": pa.int64(), "kept": pa.string(), "spans": pa.string(),
          "reference": pa.int64(), "starts": pa.binary(), "phrases": pa.binary(), "found": pa.binary(), "clash": pa.int64()}


def _rows(n: int, id_type: pa.DataType, **columns) -> pa.Table:
    """Rows of PARSED and the id, null where nothing is given."""
    every = {"id": id_type, **_TYPES}
    return pa.table({c: columns[c] if isinstance(columns.get(c), pa.ChunkedArray) else pa.array(columns.get(c) or [None] * n, t) for c, t in every.items()})


def _of_block(key, docs: pa.Table, made: dict[str, list]) -> pa.Table:
    ids = docs.column("id")
    return _rows(len(ids), ids.type, id=ids, m=docs.column("m"), block=[key] * len(ids), **made)


def _parse(n_buckets: int, length: int, with_text: bool):
    """Documents; then a row a reference block with the words sent there; then one with what is found, and the clashes."""

    def run(key, docs, answers):
        me, ids = key[0].as_py(), docs.column("id")
        block = Block(docs.column("raw").to_pylist(), length)
        ph, bucket = block.phrases, block.bucket(n_buckets)
        reference = np.full(len(block.distinct), -1, np.int64)
        asked, least = np.zeros(len(reference), bool), np.zeros(len(reference), bool)
        bits = lambda raw, n: np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)
        for b, found, of, a, x in zip(*(answers.column(c).to_pylist() for c in ("bucket", "found", "reference", "asked", "least")), strict=True):
            low, high = np.searchsorted(bucket, [b, b + 1])
            hit = bits(found, high - low)
            reference[low:high][hit] = np.frombuffer(of, np.int32)
            asked[low:high][hit], least[low:high][hit] = bits(a, hit.sum()), bits(x, hit.sum())
        here = np.arange(len(block.of))
        twice = (block.count > 1)[block.of]
        partner = np.where(block.least[block.of] == here, block.second[block.of], block.least[block.of])
        outside = reference[block.of]
        along = going_on(ph.place, ph.place[partner], twice)
        reach_in = np.where(twice, runs(along), 0)
        along = going_on(ph.place, ph.place, outside >= 0) & (np.diff(outside, append=-1) == 0)
        reach_out = np.where(outside >= 0, runs(along), 0)
        found = twice | (outside >= 0)
        parts = [_of_block(me, docs, documents(block, found, np.maximum(reach_in, reach_out), with_text))]
        sent = segments(block, np.where(asked, me, -1)) | segments(block, np.where(least, -1, reference))
        if sent:
            parts.append(_rows(len(sent), ids.type, block=[me] * len(sent), reference=list(sent), starts=[np.array([a for a, _ in s], np.int64).tobytes() for s in sent.values()], phrases=[b"\n".join(t for _, t in s) for s in sent.values()]))
        parts.append(_rows(1, ids.type, block=[me], found=[np.packbits(found).tobytes()]))
        clash = block.clashes()
        if len(clash):
            parts.append(_rows(len(clash), ids.type, block=[me] * len(clash), clash=clash.view(np.int64).tolist()))
        return pa.concat_tables(parts)

    return run


def segments(block: Block, reference: np.ndarray) -> dict[int, list[tuple[int, bytes]]]:
    """By block to go to: this block's distinct phrases that go there, at their first places, as runs (first word, words)."""
    out: dict[int, list[tuple[int, bytes]]] = {}
    has = np.flatnonzero(reference >= 0)
    has = has[np.argsort(block.least[has])]
    place, to = block.phrases.place[block.least[has]], reference[has]
    cuts = [0, *(np.flatnonzero((np.diff(place) != 1) | (np.diff(to) != 0)) + 1).tolist(), len(has)]
    for x, y in zip(cuts, cuts[1:], strict=False):
        if x < y:
            out.setdefault(int(to[x]), []).append((int(place[x]), block.phrases.words(place[x], place[y - 1] + block.phrases.length)))
    return out


class Sent(Phrases):
    """Phrases of rows that blocks sent, with the block and the place there of each."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]], length: int):
        texts = [t.split(b"\n") for _, _, t in rows]
        super().__init__([x for t in texts for x in t], length)
        starts = np.concatenate([np.frombuffer(s, np.int64) for _, s, _ in rows]) if rows else np.zeros(0, np.int64)
        block = np.repeat(np.array([b for b, _, _ in rows], np.int64), [len(t) for t in texts])
        of = np.searchsorted(self.first, self.place, side="right") - 1
        self.block, self.at = block[of], starts[of] + self.place - self.first[of]


FACTORS = "block long, start long, n_words long, reference long, at long, clash long"


def _verify(length: int):
    """Factors what came for a block against the block's own words."""

    def run(key, rows):
        me = key[0].as_py()
        every = list(zip(*(rows.column(c).to_pylist() for c in ("block", "starts", "phrases")), strict=True))
        own, come = Sent([r for r in every if r[0] == me], length), Sent([r for r in every if r[0] != me], length)
        order = np.argsort(own.hash, kind="stable")
        at = np.searchsorted(own.hash, come.hash, sorter=order)
        at = order[np.minimum(at, max(0, len(order) - 1))] if len(order) else np.zeros(len(at), np.int64)
        i = np.flatnonzero(own.hash[at] == come.hash) if len(order) else np.zeros(0, np.int64)
        good = np.zeros(len(come.hash), bool)
        good[i] = same_words(come, i, own, at[i])
        i = np.flatnonzero(good)
        p, q = come.place[i], own.place[at[i]]
        cuts = [0, *(np.flatnonzero((np.diff(p) != 1) | (np.diff(q) != 1)) + 1).tolist(), len(i)]
        spans = [(x, y) for x, y in zip(cuts, cuts[1:], strict=False) if x < y]
        head = i[[x for x, _ in spans]] if spans else i[:0]
        bad = np.unique(come.hash[~good]).view(np.int64)
        none = [None] * len(bad)
        return pa.table({
            "block": pa.array([*come.block[head].tolist(), *none], pa.int64()), "start": pa.array([*come.at[head].tolist(), *none], pa.int64()),
            "n_words": pa.array([*(y - x - 1 + length for x, y in spans), *none], pa.int64()), "reference": pa.array([*([me] * len(head)), *none], pa.int64()),
            "at": pa.array([*own.at[at[head]].tolist(), *none], pa.int64()), "clash": pa.array([*([None] * len(head)), *bad.tolist()], pa.int64()),
        })

    return run


# --- clashes --------------------------------------------------------------------------------------------------


def _hashes_sent(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("block", "starts", "phrases")), strict=True):
                h = np.unique(Sent([row], length).hash).view(np.int64)
                yield pa.RecordBatch.from_pydict({"block": pa.array([row[0]] * len(h), pa.int64()), "clash": pa.array(h, pa.int64())})

    return run


def _texts(length: int):
    """(block, clash, words, n): the different words behind each hash that clashes, and their number of places in the block."""

    def run(key, docs, wanted):
        block = Block(docs.column("raw").to_pylist(), length)
        ph, seen = block.phrases, {}
        for k in np.flatnonzero(np.isin(ph.hash, np.array(wanted.column("clash").to_pylist(), np.int64).view(np.uint64))).tolist():
            item = (int(ph.hash[k : k + 1].view(np.int64)[0]), ph.words(ph.place[k], ph.place[k] + length))
            seen[item] = seen.get(item, 0) + 1
        return pa.table({
            "block": pa.array([key[0].as_py()] * len(seen), pa.int64()), "clash": pa.array([h for h, _ in seen], pa.int64()),
            "words": pa.array([w for _, w in seen], pa.binary()), "n": pa.array(list(seen.values()), pa.int64()),
        })

    return run


def _again(length: int, with_text: bool):
    """The documents of a block, with what its clashing phrases turned out to be in the place of what their hashes said."""

    def run(key, docs, facts):
        block = Block(docs.column("raw").to_pylist(), length)
        ph, settled = block.phrases, {}
        for bits, h, words, repeats in zip(*(facts.column(c).to_pylist() for c in ("found", "clash", "words", "repeats")), strict=True):
            if h is None:
                found = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(ph.place)).astype(bool)
            else:
                settled[h, words] = repeats
        for k in np.flatnonzero(np.isin(ph.hash, np.array([h for h, _ in settled], np.int64).view(np.uint64))).tolist():
            found[k] = settled[int(ph.hash[k : k + 1].view(np.int64)[0]), ph.words(ph.place[k], ph.place[k] + length)]
        reach = runs(going_on(ph.place, ph.place, found))
        return _of_block(key[0].as_py(), docs, documents(block, found, reach, with_text)).select(["id", "m", "block", "n_words", "n_removed", "n_factors", "kept", "spans"])

    return run


def _counted(slim: DataFrame, n_rows: int, keep: Written) -> DataFrame:
    """(id, raw, m), m the rows that one stands for: two rows stand for all copies of a row that very many repeat, as their words can't tell more.

    There are fewer than HOT_KEYS such rows, so their table is broadcast.
    """
    by = [F.xxhash64("raw").alias("k"), F.octet_length("raw").alias("n")]
    hot = keep(slim.groupBy("id", *by).agg(F.count("*").alias("m")).where(F.col("m") > max(HOT_ROWS, n_rows // HOT_KEYS)))
    one = slim.withColumn("m", F.lit(1).cast("long"))
    if hot.isEmpty():
        return one
    of = F.broadcast(hot.select(F.col("id").alias("hot"), "k", "n"))
    same = F.col("id").eqNullSafe(F.col("hot")) & F.xxhash64("raw").eqNullSafe(F.col("k")) & F.octet_length("raw").eqNullSafe(F.col("n"))
    many = one.join(of, same, "left_semi").groupBy("id", "raw").agg(F.count("*").alias("m"))
    two = F.explode(F.when(F.col("m") > 1, F.array(F.lit(1).cast("long"), F.col("m") - 1)).otherwise(F.array("m")))
    return one.join(of, same, "left_anti").union(many.select("id", "raw", two))


def parse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = PHRASE, with_text: bool = True) -> tuple[DataFrame, DataFrame]:
    """Two tables: a row a document (id_col, n_words, n_removed, n_factors, kept, spans), and the factors between blocks.

    kept: the words that stay joined by one space, or their SHA-256 (lowercase hex) without with_text. spans: the
    words that go, start:end. A factor says that the n_words words from `start` of a block are those from `at` of the
    block `reference`; places count the words of the documents of a block that have a phrase, in order of their words.
    """
    spark = docs.sparkSession
    keep = Written(spark)
    size, n_rows = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0)), F.count("*")).first()
    block_bytes = min(BLOCK_BYTES[1], max(BLOCK_BYTES[0], int(64 * math.sqrt(size))))
    n_blocks = max(1, -(-size // block_bytes))
    n_buckets = max(64, -(-size * 2 // (BUCKETS_PER_BLOCK_BYTES * block_bytes)))  # a phrase starts every six bytes and takes eight
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("raw"))
    slim = _counted(slim, n_rows, keep)
    dealt = slim.withColumn("block", F.pmod(F.xxhash64("id", "raw", "m"), F.lit(n_blocks))).repartition(-(-n_blocks // TASK_BLOCKS), "block")
    index = dealt.groupBy("block").applyInArrow(_index(n_buckets, length), "bucket long, block long, phrases binary")
    index = index.repartition(-(-n_buckets // TASK_BLOCKS), "bucket")
    answers = index.groupBy("bucket").applyInArrow(_merge, "block long, bucket long, found binary, reference binary, asked binary, least binary")
    id_type = slim.schema["id"].dataType.simpleString()
    parsed = keep(dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_parse(n_buckets, length, with_text), f"id {id_type}, {PARSED}"))
    sent = parsed.where("reference is not null").select("block", "reference", "starts", "phrases")
    verified = keep(sent.repartition(-(-n_blocks // TASK_BLOCKS), "reference").groupBy("reference").applyInArrow(_verify(length), FACTORS))
    columns = ["id", "m", "n_words", "n_removed", "n_factors", "kept", "spans"]
    done, out = parsed.where("n_words is not null"), verified.where("clash is null").drop("clash")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), "m"))
    named = lambda df: df.select(F.col("id").alias(id_col), *columns[2:], copies.alias("nth")).drop("nth")
    within = parsed.where("clash is not null").select("block", "clash")
    if verified.where("clash is not null").isEmpty() and within.isEmpty():
        return named(done), out
    failed = verified.where("clash is not null").select("clash").union(within.select("clash")).distinct()
    holders = sent.mapInArrow(_hashes_sent(length), "block long, clash long").join(failed, "clash", "left_semi").select("block", "clash")
    wanted = keep(holders.union(within).distinct())
    blocks = keep(wanted.select("block").distinct())
    some = dealt.join(blocks, "block", "left_semi")
    texts = keep(some.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(_texts(length), "block long, clash long, words binary, n long"))
    total = texts.groupBy("words").agg((F.sum("n") > 1).alias("repeats"))
    none = F.lit(None)
    facts = texts.join(total, "words").select("block", none.cast("binary").alias("found"), "clash", "words", "repeats")
    bits = parsed.where("found is not null").join(blocks, "block", "left_semi").select("block", "found", none.cast("long").alias("clash"), none.cast("binary").alias("words"), none.cast("boolean").alias("repeats"))
    again = some.groupBy("block").cogroup(facts.union(bits).groupBy("block")).applyInArrow(_again(length, with_text), f"id {id_type}, m long, block long, n_words long, n_removed long, n_factors long, kept string, spans string")
    return named(done.join(blocks, "block", "left_anti").select(*columns).union(again.select(*columns))), out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = PHRASE, with_text: bool = True) -> DataFrame:
    """The documents of parse()."""
    return parse(docs, id_col, text_col, length, with_text)[0]


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
