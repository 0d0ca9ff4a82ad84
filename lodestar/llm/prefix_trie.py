"""Conversation prefix trie by an LCP-aware external mergesort.

A turn becomes a token of 20 bytes: 16 of the SHA-256 of its role and text, then the text's code points. A conversation is the
bytes of its first tokens; equal ones are counted together before they are sorted. Tasks sort runs, each key with its longest
common prefix (LCP) with the key before it, and write them to the shared folder. The runs are dealt by ranges of keys; a task
merges the slices it gets with a loser tree, which compares two heads by their LCPs with the last winner and looks at tokens only
past equal LCPs. The merged stream keeps the open path on a stack and emits each node once the stream has left it.

A node that other tasks may hold too (a prefix of a range's first or last key) is emitted as a part; Spark adds the parts
of the same node up, and sums over their subtrees by pointer doubling. Sequences are sorted by their first `FIRST` turns. Those
that share all of these go on in a next level, with longer pieces; one that is alone from there on is a chain of nodes with
one member, made from its rows. So nothing holds a whole long conversation, and no key's rows meet in one task: turns
are numbered inside ranges of (conversation, turn), members' ids are joined in pieces before the pieces are hashed in order.

Defined results: rows with a null conversation id belong to none and are left out; a null role or text is empty; turns are
ordered with null first, equal ones by their token, and repeated rows are turns of their own. An empty table has no nodes. Texts
count whole. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import Written, table

TOKEN = 20
GROUP, HEADS = 100, 6  # a conversation takes h < HEADS turns of the first of its GROUP
FIRST, GROWTH = 64, 8  # turns of the first level's pieces, at least HEADS - 1, and how much longer those of the next are
RUN_BYTES = 4 << 20
MERGE_BYTES = 8 << 20  # of keys, for one merging task
PIECE = 4096  # ids joined into one string
NONE = hashlib.sha256(b"").hexdigest()


# --- rows ---


def turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, token); tokens are hexadecimal here, so that they join as strings."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.substring(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256), 1, 2 * (TOKEN - 4))
    token = F.concat(digest, F.lpad(F.hex(F.char_length(t).cast("long")), 8, "0"))
    return rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), token.alias("token"))


def numbered(rows: DataFrame, keep: Written) -> DataFrame:
    """(conv_id, pos, token): turns numbered from 1. A conversation may span many ranges, whose counts give the offsets."""
    salt = F.xxhash64(F.monotonically_increasing_id())  # repeated rows are dealt out too
    ranged = keep(rows).withColumn("salt", salt).repartitionByRange("conv_id", "turn", "token", "salt")
    ranged = keep(ranged.select("conv_id", "turn", "token", F.spark_partition_id().alias("part")))
    n = ranged.groupBy("part", "conv_id").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = n.select("part", "conv_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "token"))
    return ranged.withColumn("own", own).join(offset, ["part", "conv_id"]).select("conv_id", (F.col("own") + F.col("offset")).alias("pos"), "token")


def rebuilt(rows: DataFrame) -> DataFrame:
    """(conv_id, head, h, k, len): the tokens taken from the group's first conversation, the own turns they stand for, their number, all turns."""
    n = rows.groupBy("conv_id").agg(F.max("pos").alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    n = n.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    first = rows.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < HEADS))
    first = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("first"))
    head = F.coalesce(F.slice("first.token", F.lit(1), F.col("h")), F.array().cast("array<string>"))
    out = n.join(first, "base", "left").withColumn("head", head).withColumn("k", F.size("head"))
    return out.select("conv_id", "head", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))


def _path(tokens: Column) -> Column:
    return F.unhex(F.array_join(tokens, ""))


def first_level(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv_id, key, more): the first FIRST turns, and whether any follow."""
    tail = rows.where(F.col("pos") <= FIRST + HEADS).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("tail"))
    own = F.transform(F.filter("tail", lambda x: x["pos"] > F.col("h")), lambda x: x["token"])
    return plan.join(tail, "conv_id").select("conv_id", _path(F.slice(F.concat("head", own), 1, FIRST)).alias("key"), (F.col("len") > FIRST).alias("more"))


def digest(key: Column) -> Column:
    return F.unhex(F.substring(F.sha2(key, 256), 1, 32))


# --- sorting ---


def common(a: bytes, b: bytes, g: int, at: int = -1) -> int:
    """Equal tokens at the start of two keys, of which `at` are known to be; -1 if their first g bytes, the group, differ."""
    if at < 0:
        if a[:g] != b[:g]:
            return -1
        at = 0
    i, end = g + at * TOKEN, min(len(a), len(b))
    while i < end and a[i : i + TOKEN] == b[i : i + TOKEN]:
        i += TOKEN
    return (i - g) // TOKEN


VALUES = ["n", "low", "n_end", "end_low", "n_more", "more_low"]
RUNS = "run long, i long, lcp int, key binary, " + ", ".join(f"{c} long" for c in VALUES)


def sort_runs(g: int):
    """Runs of some RUN_BYTES of keys, sorted, each key with its LCP with the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            held.sort()
            keys = [h[0] for h in held]
            lcp = [-1, *(common(a, b, g) for a, b in zip(keys, keys[1:]))]
            cols = [pa.array([(task << 32) + n] * len(held), pa.int64()), pa.array(range(len(held)), pa.int64()), pa.array(lcp, pa.int32()), pa.array(keys, pa.binary())]
            cols += [pa.array([h[k] for h in held], pa.int64()) for k in range(1, 7)]
            return pa.RecordBatch.from_arrays(cols, names=["run", "i", "lcp", "key", *VALUES])

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ["key", *VALUES]), strict=True)
            size += batch.column("key").nbytes
            if size >= RUN_BYTES:
                yield out()
                n, held, size = n + 1, [], 0
        if held:
            yield out()

    return run


class LoserTree:
    """Merges sorted runs of (key, LCP with the key before). Of each run's head it knows the LCP with the key that won last;
    the head with the longer one is smaller, and a loser keeps its LCP with whatever beat it."""

    def __init__(self, runs: list[list[tuple[bytes, int]]], g: int):
        self.runs, self.g, k = runs, g, len(runs)
        self.at, self.key, self.lcp = [0] * k, [r[0][0] for r in runs], [-1] * k
        self.compared = 0
        self.loser, winner = [0] * k, [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.loser[node] = (a, b) if self.beats(a, b) else (b, a)
        self.winner = winner[1] if k > 1 else 0

    def beats(self, a: int, b: int) -> bool:
        x, y = self.key[a], self.key[b]
        if x is None or y is None:
            return y is None
        if self.lcp[a] != self.lcp[b]:
            return self.lcp[a] > self.lcp[b]
        self.compared += 1
        same, first = common(x, y, self.g, self.lcp[a]), x < y or x == y and a < b
        self.lcp[b if first else a] = same
        return first

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """(run, place in it, LCP with the key before), in the order of keys."""
        k = len(self.runs)
        while self.key[w := self.winner] is not None:
            yield w, self.at[w], self.lcp[w]
            self.at[w] += 1
            self.key[w], self.lcp[w] = self.runs[w][self.at[w]] if self.at[w] < len(self.runs[w]) else (None, -1)
            node = (w + k) // 2
            while node:
                if self.beats(self.loser[node], w):
                    w, self.loser[node] = self.loser[node], w
                node //= 2
            self.winner = w


# --- nodes ---

NODE = ["open", "digest", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_end", "end_low", "chars"]
NODES = "open boolean, digest binary, parent binary, " + ", ".join(f"{c} long" for c in NODE[3:])


class Open:
    """A node on the path: what its members seen so far add up to, and the children that wait for its smallest member."""

    __slots__ = ("hasher", "digest", "depth", "chars", "shared", "n", "low", "children", "leaves", "saved", "n_end", "end_low", "waiting")

    def __init__(self, hasher, digest, depth: int, chars: int, shared: bool):
        self.hasher, self.digest, self.depth, self.chars, self.shared = hasher, digest, depth, chars, shared
        self.n = self.children = self.leaves = self.saved = self.n_end = 0
        self.low = self.end_low = None
        self.waiting: list[list] = []

    def take(self, n: int, low: int) -> None:
        self.n += n
        self.low = low if self.low is None else min(self.low, low)


def nodes(stream: Iterator[tuple[bytes, int, tuple]], g: int, start: int) -> Iterator[list]:
    """The nodes of a stream of (key, LCP, values) in order; shared ones (`open`) as far as this stream knows them."""
    path: list[Open] = []

    def close() -> Iterator[list]:
        top = path.pop()
        above = path[-1] if path else None
        if not top.shared:
            top.leaves = top.leaves or 1
            top.saved += (top.n - 1) * top.chars
            above.children, above.leaves, above.saved = above.children + 1, above.leaves + top.leaves, above.saved + top.saved
        own = above is not None or g == 0  # the top of a deeper level has its members from the level before
        row = [top.shared, top.digest, above and above.digest, start + top.depth if own else None, top.low if own else None, None, top.n if own else 0, top.children, top.leaves, top.saved, top.n_end, top.end_low, top.chars if own else None]
        for child in top.waiting:
            child[5] = None if top.shared else top.low
            yield child
        if above is not None:
            above.take(top.n, top.low)
        if top.shared or above.shared:
            yield row
        else:
            above.waiting.append(row)

    first = True
    for key, same, (n, low, n_end, end_low, n_more, _) in stream:
        while path and path[-1].depth > same:
            yield from close()
        if not path:  # a new group; the range's first key may go on from the range before
            hasher = hashlib.sha256(key[:g])
            path.append(Open(hasher, key[:g] if g else hasher.digest()[:16], 0, 0, True))
        for i in range(g + path[-1].depth * TOKEN, len(key), TOKEN):
            hasher = path[-1].hasher.copy()
            hasher.update(key[i : i + TOKEN])
            path.append(Open(hasher, hasher.digest()[:16], path[-1].depth + 1, int.from_bytes(key[i + TOKEN - 4 : i + TOKEN], "big"), first))
        top, first = path[-1], False
        top.take(n, low)
        top.n_end, top.end_low = n_end, end_low
        if n_more == 1:
            top.children, top.leaves = top.children + 1, top.leaves + 1
        elif n_more:
            for x in path:
                x.shared = True
    for x in path:
        x.shared = True
    while path:
        yield from close()


def merge(g: int, start: int):
    """Merges the slices of runs that a task gets, and turns the stream into nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, tuple[list, list]] = {}
        for batch in batches:
            names = ["run", "key", "lcp", *VALUES]
            for r, key, lcp, *values in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                keys, rest = runs.setdefault(r, ([], []))
                keys.append((key, lcp))
                rest.append(values)
        if not runs:
            return
        slices, values = [k for k, _ in runs.values()], [v for _, v in runs.values()]
        stream = ((slices[r][i][0], same, values[r][i]) for r, i, same in LoserTree(slices, g))
        held: list[list] = []
        types = [pa.bool_(), pa.binary(), pa.binary(), *[pa.int64()] * 10]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=NODE)

        for row in nodes(stream, g, start):
            held.append(row)
            if len(held) >= 8192:
                yield out()
                held = []
        if held:
            yield out()

    return run


# --- members' ids ---


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (digest, conv_id) rows become pieces of at most PIECE ids."""
    last, ids = None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([",".join(map(str, ids))])], names=["digest", "first", "n", "ids"])

    for batch in batches:
        for d, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (d != last or len(ids) >= PIECE):
                yield out()
                ids = []
            last = d
            ids.append(c)
    if ids:
        yield out()


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over a node's pieces in order, held one at a time."""
    last, hasher = None, None
    for batch in batches:
        found = []
        for d, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if d == last:
                hasher.update(b"," + ids.encode())
                continue
            if last is not None:
                found.append((last, hasher.hexdigest()))
            last, hasher = d, hashlib.sha256(ids.encode())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.binary(), pa.string()), strict=True)], names=["digest", "ends_sha256"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([hasher.hexdigest()])], names=["digest", "ends_sha256"])


def ends(members: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of nodes at which several conversations end. members: (digest, conv_id)."""
    pieces = members.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(_pack, "digest binary, first long, n long, ids string")
    return pieces.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(_hash, "digest binary, ends_sha256 string")


# --- the whole ---


def subtree_sums(skeleton: DataFrame, keep: Written) -> DataFrame:
    """(digest, leaves, saved) summed over subtrees: after k rounds a node has the sums of what is less than 2**k below it."""
    now = keep(skeleton.select("digest", F.col("parent").alias("jump"), "leaves", "saved"))
    while not now.where("jump is not null").isEmpty():
        add = now.where("jump is not null").groupBy(F.col("jump").alias("digest")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        up = now.select(F.col("digest").alias("jump"), F.col("jump").alias("next"))
        total = [(F.col(c) + F.coalesce(d, F.lit(0))).alias(c) for c, d in (("leaves", "l"), ("saved", "s"))]
        now = keep(now.join(add, "digest", "left").join(up, "jump", "left").select("digest", F.col("next").alias("jump"), *total))
    return now.drop("jump")


OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def trie(spark: SparkSession, conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a node: OUT and ends_sha256."""
    keep = Written(spark)
    rows = keep(numbered(turns(conversations, conv, turn, role, text), keep))
    plan = keep(rebuilt(rows))
    at = F.col("pos") - F.col("h") + F.col("k")  # a turn's place in the rebuilt conversation
    found, members, chains = [], [], []
    seqs, g, start, size = keep(first_level(rows, plan)), 0, 0, FIRST
    while True:
        ends_here, goes_on = ~F.col("more"), F.col("more")
        count = lambda c: F.count(F.when(c, 1))
        least = lambda c: F.min(F.when(c, F.col("conv_id")))
        keys = keep(
            seqs.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("low"), count(ends_here).alias("n_end"), least(ends_here).alias("end_low"), count(goes_on).alias("n_more"), least(goes_on).alias("more_low"))
        )
        runs = keep(keys.mapInArrow(sort_runs(g), RUNS))
        state = runs.agg(F.sum(F.octet_length("key")).alias("bytes"), F.max("n_more").alias("more")).first()
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((state.bytes or 0) / MERGE_BYTES))
        found.append(runs.repartitionByRange(parts, "key").sortWithinPartitions("run", "i").mapInArrow(merge(g, start), NODES))
        members.append(seqs.where(ends_here).select(digest(F.col("key")).alias("digest"), "conv_id"))
        end = start + size
        if state.more:
            alone = keys.where("n_more = 1").select(F.col("more_low").alias("conv_id"), F.col("low").alias("above")).join(plan, "conv_id")
            rest = rows.where(F.col("pos") > end).join(alone, "conv_id").withColumn("depth", at.cast("long")).where(F.col("depth") > end)
            last = F.col("depth") == F.col("len")
            chains.append(
                rest.select("conv_id", "depth", F.when(F.col("depth") == end + 1, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), (~last).cast("long").alias("n_children"),
                    F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NONE).alias("ends_sha256"))
            )
        if (state.more or 0) < 2:
            break
        group = keys.where("n_more >= 2").select("key", digest(F.col("key")).alias("group"))
        together = seqs.where(goes_on).join(group, "key").select("conv_id", "group").join(plan, "conv_id")
        start, size = end, size * GROWTH
        piece = rows.where(F.col("pos") > start).join(together, "conv_id").withColumn("depth", at).where(F.col("depth").between(start + 1, start + size))
        piece = piece.groupBy("conv_id", "group", "len").agg(F.sort_array(F.collect_list(F.struct("depth", "token"))).alias("piece"))
        seqs, g = keep(piece.select("conv_id", F.concat("group", _path(F.col("piece.token"))).alias("key"), (F.col("len") > start + size).alias("more"))), 16

    union = lambda parts: parts[0] if len(parts) == 1 else union([parts[0].union(parts[1]), *parts[2:]])
    every = keep(union(found))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "n_end")]
    skeleton = keep(every.where("open").groupBy("digest").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums, F.min("end_low").alias("end_low"), F.max("chars").alias("chars")))
    kids = skeleton.where("parent is not null").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("kids"))
    skeleton = skeleton.join(kids, "digest", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)))
    own = skeleton.select("digest", "parent", (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("leaves"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    totals = subtree_sums(own, keep)
    lows = skeleton.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_low"))
    shared = skeleton.drop("n_leaves", "saved_tokens").join(totals, "digest").withColumnsRenamed({"leaves": "n_leaves", "saved": "saved_tokens"}).withColumn("parent_conv_id", F.lit(None).cast("long"))
    cols = [*OUT, "parent", "digest", "n_end", "end_low"]
    most = every.where("not open and parent_conv_id is not null").select(*cols)
    below = every.where("not open and parent_conv_id is null").select(*cols).union(shared.select(*cols)).join(lows, "parent", "left").withColumn("parent_conv_id", F.col("parent_low")).select(*cols)
    ended = ends(union(members))
    all_nodes = most.union(below)
    many = all_nodes.where("n_end > 1").join(ended, "digest").select(*OUT, "ends_sha256")
    few = all_nodes.where("n_end <= 1").select(*OUT, F.when(F.col("n_end") == 1, F.sha2(F.col("end_low").cast("string"), 256)).otherwise(NONE).alias("ends_sha256"))
    return union([few, many, *chains])


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark, table(spark, sf_dir, "conversations"))


SQL = r"""with recursive t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
  numbered as (select conv_id, dense_rank() over (order by role, text) as token, length(text) as chars, row_number() over (partition by conv_id order by turn nulls first, sha256(strlen(role) || ':' || role || text)[:32]) as pos from t),
  lists as (select conv_id, list(struct_pack(token := token, chars := chars) order by pos) as own from numbered group by conv_id),
  bits as (select range as i, 0 as step, range as c from range(256) union all select i, step + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where step < 8),
  crc as (select conv_id, conv_id::varchar as s, 1 as k, 4294967295 as c from lists
    union all select conv_id, s, k + 1, xor(b.c, crc.c >> 8) from crc join bits b on b.step = 8 and b.i = xor(crc.c & 255, ascii(s[k])) where k <= length(s)),
  heads as (select conv_id, xor(c, 4294967295) % 6 as h from crc where k = length(s) + 1),
  full_ as (select l.conv_id, coalesce(b.own[:h], []) || l.own[h + 1:] as path from lists l join heads using (conv_id) left join lists b on b.conv_id = l.conv_id - l.conv_id % 100),
  each as (select conv_id, path[:d] as p, d, d = len(path) as ends from (select conv_id, path, unnest(range(0, len(path) + 1)) as d from full_)),
  nodes as (select p, any_value(d) as depth, min(conv_id) as conv_id, count(*) as n, coalesce(string_agg(conv_id, ',' order by conv_id) filter (ends), '') as members, (count(*) - 1) * coalesce(p[len(p)].chars, 0) as saved from each group by p),
  kids as (select p[:len(p) - 1] as p, count(*) as n_children from nodes where depth > 0 group by 1),
  full_nodes as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join kids using (p)),
  subtree as (select up as p, sum((n_children = 0)::int) as n_leaves, sum(saved) as saved_tokens from (select n_children, saved, p[:unnest(range(0, depth + 1))] as up from full_nodes) group by up)
select n.conv_id, n.depth::bigint as depth, a.conv_id as parent_conv_id, n.n as n_convs, n.n_children, n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, sha256(n.members) as ends_sha256
  from full_nodes n join subtree using (p) left join nodes a on n.depth > 0 and a.p = n.p[:len(n.p) - 1]"""
