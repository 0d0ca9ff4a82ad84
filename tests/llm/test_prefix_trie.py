"""The prefix trie against a plain version that holds every prefix, at several piece lengths; merging; awkward rows."""

import collections
import hashlib
import random
import zlib

import pytest

from lodestar.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def token(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32], len(text)


def plain(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn, *token(role or "", text or "")))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1] or 0, x[2]))] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = (abs(c) - abs(c) % 100) * (1 if c >= 0 else -1)
        full[c] = tuple(own.get(base, [])[:h] + v[h:])
    members, ends = collections.defaultdict(set), collections.defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].add(c)
        ends[full[c]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * (p[-1][1] if p else 0)
    out = []
    for p, m in members.items():
        ids = hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ids))
    return collections.Counter(out)


def built(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, k, "x", 0.5) for k, r in enumerate(rows)], SCHEMA + ", n long, token string, depth double").repartition(parts)
    found = pt.trie(spark, df)
    assert found.columns == [*pt.OUT, "ends_sha256"]
    return collections.Counter(map(tuple, found.collect()))


def chat(rng, n_conv, vocabulary, longest, ids):
    rows = []
    for c in rng.sample(ids, n_conv):
        rows += [(c, k, rng.choice("ua"), rng.choice(vocabulary)) for k in range(rng.randint(1, longest))]
    return rows


@pytest.mark.parametrize(("first", "growth"), [(5, 1), (6, 2), (64, 8)])
def test_random_conversations_equal_the_plain_version(spark, monkeypatch, first, growth):
    monkeypatch.setattr(pt, "FIRST", first)
    monkeypatch.setattr(pt, "GROWTH", growth)
    rng = random.Random(first)
    rows = chat(rng, 150, ["a", "bb"], 9, range(-120, 420)) + chat(rng, 6, ["a"], 30, range(-100, 500, 100)) + chat(rng, 40, ["same"], 25, range(500, 600))
    assert built(spark, rows) == plain(rows)


def test_awkward_rows(spark):
    rows = [(None, 1, "u", "lost"), (0, None, None, None), (0, None, "u", "first"), (0, 1, "u", ""), (0, 1, "u", ""), (0, 3, "u", "z" * 100_000), (100, 5, "u", "alone"), (207, 1, "u", "no base"), (-3, 2, "a", "minus"), (-100, 1, "a", "base of minus")]
    rows += [(k, t, "u", f"text {t}") for k in range(1, 60) for t in (3, 1, 2, 2)]
    assert built(spark, rows) == plain(rows)
    assert built(spark, rows, 7) == built(spark, rows, 1)


def test_an_empty_table_has_no_nodes(spark):
    assert built(spark, []) == collections.Counter() and built(spark, [(None, 1, "u", "x")]) == collections.Counter()


def test_one_turn_and_turnless_conversations(spark):
    shorter = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 0][:20]  # their turn is replaced by what is absent
    rows = [(c, 1, "u", "hello") for c in shorter]
    got = built(spark, rows)
    assert got == plain(rows) and got[(shorter[0], 0, None, 20, 0, 1, 0, hashlib.sha256(",".join(map(str, shorter)).encode()).hexdigest())] == 1


def test_long_conversations_and_long_copies(spark, monkeypatch):
    monkeypatch.setattr(pt, "GROWTH", 3)
    rows = [(101, k, "u", f"t{k}") for k in range(3000)] + [(c, k, "u", f"s{k}") for c in (300, 301, 302) for k in range(500 + c)]
    got, n = built(spark, rows), plain
    # The plain version is quadratic in the length: long ones are told by their closed forms.
    assert sum(got.values()) == len({(r[3]) for r in rows if r[0] != 101}) + 3000 - zlib.crc32(b"101") % 6 + 1 + sum(zlib.crc32(str(c).encode()) % 6 > 800 for c in (300, 301, 302))
    root = next(r for r in got if r[1] == 0)
    assert root[3] == 4 and root[4] == 2 and root[5] == 2
    assert n(rows[:40]) == built(spark, rows[:40])


def test_one_conversation_holds_most_rows(spark):
    rows = [(5, k % 40, "u", f"t{k % 7}") for k in range(400)] + [(c, 1, "u", "hi") for c in range(100, 130)]
    assert built(spark, rows) == plain(rows)


def test_ids_of_many_members_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(pt, "PIECE", 7)
    rows = [(c, 9, "u", "same") for c in range(0, 40000, 100)]  # each is the first of its group
    got = built(spark, rows)
    assert got == plain(rows)


def keys(rng, n, g=0):
    return sorted({bytes(rng.choice("ab").encode() * g) + b"".join(rng.choice([b"x", b"y"]) * pt.TOKEN for _ in range(rng.randint(0 if not g else 1, 6))) for _ in range(n)})


@pytest.mark.parametrize("g", [0, 16])
@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_loser_tree_merges_and_gives_lcps(g, k):
    rng = random.Random(k)
    all_keys = keys(rng, 200, g)
    dealt = [[] for _ in range(k)]
    for key in all_keys:
        rng.choice(dealt).append(key)
    runs = [[(x, pt.common(r[i - 1], x, g) if i else -1) for i, x in enumerate(r)] for r in dealt if r]
    tree = pt.LoserTree(runs, g)
    got = [(runs[r][i][0], same) for r, i, same in tree]
    assert [x for x, _ in got] == all_keys
    assert [s for _, s in got[1:]] == [pt.common(a, b, g) for a, b in zip(all_keys, all_keys[1:])]
    assert k == 1 or tree.compared < len(all_keys) * k  # equal LCPs only; others need no look at tokens


def test_a_run_holds_lcps_of_its_neighbours(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, 1, 1, 1, 1, 0, None) for k in keys(rng, 300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key binary, " + ", ".join(f"{c} long" for c in pt.VALUES)).repartition(3)
    runs = collections.defaultdict(list)
    for r in df.mapInArrow(pt.sort_runs(0), pt.RUNS).collect():
        runs[r.run].append((r.i, bytes(r.key), r.lcp))
    assert sum(map(len, runs.values())) == len(rows)
    for r in runs.values():
        r.sort()
        assert [x[1] for x in r] == sorted(x[1] for x in r)
        assert all(b[2] == pt.common(a[1], b[1], 0) for a, b in zip(r, r[1:]))
