"""The filter audit against a plain simulation of every order, on awkward rows too."""

import collections
import itertools
import random
import re

import pytest

from lodestar.llm import filter_audit as fa

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, labels):
    """docs: (id, text, part); labels: (id, quality, toxic)."""
    docs = [(i, t or "", p or "") for i, t, p in docs]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t] = min(i, least.get(t, i))

    def fails(i, t):
        words = WORD.findall(t)
        out = {"A"} if len(words) < 100 else set()
        out |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        out |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        out |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        return out | ({"E"} if i is not None and i > least[t] else set())

    rows = [(p, fails(i, t), i in good, i in toxic) for i, t, p in docs]
    out = {}
    for part in {p for p, *_ in rows}:
        shapley = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            here = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in here if f in r[1]]
                stay = [r for r in here if f not in r[1]]
                every = sum(r[0] == part and f in r[1] for r in rows)
                alone = sum(r[0] == part and r[1] == {f} for r in rows)
                out[part, order, step] = [len(stay), len(gone), every - len(gone), alone, sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[f] += len(gone)
                here = stay
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, docs, labels, kind="long"):
    d = spark.createDataFrame(docs, f"doc_id {kind}, text string, lang string")
    d = d.selectExpr("*", "1 as key", "2 as mask", "'x' as id", "3 as n", "4 as part", "5 as label")
    found = fa.audit(spark, d, spark.createDataFrame(labels, f"doc_id {kind}, quality int, toxic int"))
    rows = [tuple(r) for r in found.collect()]
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert len({r[:3] for r in rows}) == len(rows)
    return {r[:3]: r[3:] for r in rows}


AWKWARD = [
    (1, None, None), (2, "", "en"), (3, "", ""), (None, "same text", "en"), (None, "same text", "en"), (4, "same text", "de"), (5, "same text", "en"), (5, "same text", "en"), (0, "other", None),
    (6, " ".join(f"w{k}" for k in range(120)), "en"), (7, " ".join(f"w{k}" for k in range(120)), "en"), (8, "A|B " * 200, "en"), (9, "é Ü ñ " * 50, "de"), (9, "another text of the same id", "de"),
    (10, "long " + " ".join(f"v{k % 5000}" for k in range(400_000)), "en"), (11, "x" * 3_000_000, "en"),
]
LABELS = [(1, 1, 1), (2, 0, 1), (5, 1, None), (5, 0, 1), (None, 1, 1), (7, 1, 0), (8, None, None), (99, 1, 1)]


def test_awkward_rows_equal_the_plain_version(spark):
    assert audited(spark, AWKWARD, LABELS) == plain(AWKWARD, LABELS)


def test_random_rows_equal_the_plain_version(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["a", "Bb", "C", "#", "word", *map(str, range(200))], k=rng.choice([3, 90, 150]))) for _ in range(30)]
    docs = [(k, rng.choice(texts), rng.choice(["en", "de", None])) for k in rng.sample(range(1000), 300)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k, *_ in docs[::2]]
    assert audited(spark, docs, labels) == plain(docs, labels)


def test_string_ids_compare_as_strings(spark):
    docs = [(str(k), "t" if k % 2 else "u", "en") for k in range(1, 30)]
    labels = [(str(k), 1, 1) for k in range(9)]
    assert audited(spark, docs, labels, "string") == plain(docs, labels)


def test_empty_tables_and_many_parts(spark):
    assert audited(spark, [], LABELS) == {}
    docs = [(k, f"text {k % 7}", f"part {k % 150}") for k in range(300)]
    assert audited(spark, docs, []) == plain(docs, [])


@pytest.mark.parametrize("order", [0, 17, 119])
def test_table_of_first_failures(order):
    t = fa.first_failures()
    for mask in range(32):
        steps = [s for s, f in enumerate(fa.ORDERS[order]) if mask >> "ABCDE".index(f) & 1]
        assert t[mask, order] == (steps[0] if steps else 5)


def test_pieces_hold_the_words_of_the_whole():
    raw = ("ab cd\tef " * 300_000 + "x" * 2_000_000 + " end").encode()
    assert fa._words(raw) == (len(raw.split()), len(set(raw.split())))
