"""The factorization machine: its sum against all pairs, what it learns that linear weights can't, held-out rows, awkward rows."""

import itertools
import random
import zlib

import numpy as np
import pytest

from lodestar.llm import toxicity as tox

P = tox.ToxicityParams()


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def test_score_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(3)
    m = tox.ToxicityModel(np.array([2, 5, 9, 11]), rng.normal(size=4), rng.normal(size=(4, 3)), 0.3, 1.7, -0.2)
    ids, x = np.array([1, 2, 9, 11, 40]), rng.random(5)
    known = [(int(np.searchsorted(m.ids, i)), v) for i, v in zip(ids, x) if i in m.ids]
    z = m.w0 + sum(m.w[k] * v for k, v in known) + sum(m.v[a] @ m.v[b] * va * vb for (a, va), (b, vb) in itertools.combinations(known, 2))
    assert m.raw(ids, x) == pytest.approx(z)
    assert m.score(ids, x) == pytest.approx(1 / (1 + np.exp(-(1.7 * z - 0.2))))
    assert m.raw(ids[:0], x[:0]) == pytest.approx(0.3)


def test_gradient_steps_lower_the_loss_of_pairs():
    """An insult is toxic beside a mention only: no linear weights tell the four cases apart as well."""
    rng = random.Random(4)
    cases = [(i, m) for i in (0, 1) for m in (0, 1)]
    ids, y = [], []
    for _ in range(600):
        i, m = rng.choice(cases)
        ids.append(np.unique([100] * i + [200] * m + rng.sample(range(1000, 1050), 5)).astype(np.int64))
        y.append(float(i and m))
    values, p = [np.ones(len(i)) for i in ids], tox.ToxicityParams(association=0.0, rounds=200)
    model, flat = tox.train(ids, values, np.array(y), p), tox.train(ids, values, np.array(y), tox.ToxicityParams(association=0.0, rounds=200, factors=0))
    both, one = model.raw(np.array([100, 200]), np.ones(2)), max(model.raw(np.array([k]), np.ones(1)) for k in (100, 200))
    at = {int(k): n for n, k in enumerate(model.ids)}
    assert both > one + 1 and model.v[at[100]] @ model.v[at[200]] > 0.5
    loss = lambda m: np.mean([np.log1p(np.exp(-(2 * t - 1) * (m.a * m.raw(i, x) + m.b))) for i, x, t in zip(ids, values, y)])
    assert loss(model) < loss(flat)


def test_chosen_terms_are_those_that_differ_or_are_common():
    ids = [np.array([1, 2, 3] if k % 2 else [2, 4] if k % 4 else [2, 5]) for k in range(400)]
    y = np.array([k % 2 for k in range(400)], float)
    p = tox.ToxicityParams(common=0.9)
    assert tox.chosen_terms(ids, [np.ones(len(i)) for i in ids], y, p).tolist() == [1, 2, 3, 4, 5]
    y = np.array([k // 2 % 2 for k in range(400)], float)
    assert tox.chosen_terms(ids, [np.ones(len(i)) for i in ids], y, p).tolist() == [2, 4, 5]


def test_terms_fold_case_and_punctuation():
    one, two = tox.terms("You IDIOT, you!".encode(), P), tox.terms(b"you idiot you", P)
    assert one[0].tolist() == two[0].tolist() and one[1].tolist() == two[1].tolist()
    assert len(tox.terms(b" .,! \n", P)[0]) == len(tox.terms(b"", P)[0]) == 0
    with_stem = set(tox.terms(b"worthlessly", P)[0]) & set(tox.terms(b"worthless", P)[0])
    assert len(with_stem) == len(P.stems)


def test_held_out_accuracy_on_the_labelled_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    ids = labels.select("doc_id")
    got = {r.doc_id: r for r in tox.score(docs.join(ids, "doc_id"), tox.fit(docs, labels)).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(got) == len(truth) and all(got[k].held_out == held(k) for k in got)
    out = [k for k in got if held(k)]
    assert sum(got[k].predicted for k in out if truth[k]) >= 0.85 * sum(truth[k] for k in out)
    assert sum(got[k].predicted for k in out if not truth[k]) <= 0.01 * sum(not truth[k] for k in out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


def labelled(spark, kind="long"):
    rng = random.Random(9)
    neutral = [f"word{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choices(neutral, k=40) + ["scum"] * (3 * (k % 2)))) for k in range(300)]
    as_id = str if kind == "string" else int
    docs = spark.createDataFrame([(as_id(k), t) for k, t in rows], f"doc_id {kind}, text string")
    return docs, spark.createDataFrame([(as_id(k), k % 2) for k, _ in rows], f"doc_id {kind}, toxic int")


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = labelled(spark)
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - toxic, toxic) as toxic")
    one, two = tox.fit(docs, labels), tox.fit(docs.repartition(5), turned)
    assert one.w0 == two.w0 and (one.w == two.w).all() and (one.v == two.v).all() and (one.a, one.b) == (two.a, two.b)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_awkward_rows(spark, kind):
    docs, labels = labelled(spark, kind)
    as_id = str if kind == "string" else int
    odd = [(None, " ".join(f"word{k}" for k in range(40)) + " scum" * 3), (as_id(900), None), (as_id(901), ""), (as_id(902), " ".join(f"word{k}" for k in range(40)) * 10_000 + " scum" * 30_000), (as_id(903), "word2"), (as_id(903), "word2")]
    odd = spark.createDataFrame([(*r, 0.1, 7, "x") for r in odd], f"doc_id {kind}, text string, score double, id int, y string")
    more = spark.createDataFrame([(None, 1), (as_id(0), None), (as_id(777), 1), (as_id(1), 0)], f"doc_id {kind}, toxic int")
    model = tox.fit(docs.unionByName(odd.select("doc_id", "text")), labels.union(more))
    rows = tox.score(odd, model).collect()
    assert len(rows) == 6 and list(rows[0].asDict()) == ["doc_id", "held_out", "score", "predicted"]
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[None][0].predicted == 1 and by[None][0].held_out is False and by[as_id(902)][0].predicted == 1
    assert by[as_id(900)][0].score == by[as_id(901)][0].score and by[as_id(903)][0].score == by[as_id(903)][1].score < 0.7


def test_empty_tables_and_no_model(spark):
    docs, labels = labelled(spark)
    assert tox.fit(docs.limit(0), labels) is None and tox.fit(docs, labels.limit(0)) is None
    assert {(r.score, r.predicted) for r in tox.score(docs, None).collect()} == {(0.0, 0)}
    assert tox.score(docs.limit(0), tox.fit(docs, labels)).count() == 0
