"""The inverted file against a full comparison."""

import numpy as np
import pytest

from lodestar.operators import ivf


def brute(vectors, queries, k):
    ids = np.array([i for i, _ in vectors])
    v = np.array([x for _, x in vectors])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for qid, q in queries:
        s = np.round(v @ (np.array(q) / np.linalg.norm(q)), 9)
        out[qid] = [int(i) for i in ids[np.lexsort((ids, -s))][:k]]
    return out


def frame(spark, rows, a="id", b="embedding"):
    return spark.createDataFrame([(int(i), None if x is None else [None if c is None else float(c) for c in x]) for i, x in rows], f"{a} long, {b} array<double>").repartition(3)


def clustered(n, width, groups, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, width))
    return [(k, centre[rng.integers(groups)] + 0.35 * rng.normal(size=width)) for k in range(n)]


def found(df):
    out = {}
    for r in df.orderBy("qid", df.score.desc(), "id").collect():
        out.setdefault(r.qid, []).append((r.id, r.score))
    return {q: [i for i, _ in sorted(v, key=lambda x: (-round(x[1], 9), x[0]))] for q, v in out.items()}


def test_probes_reach_the_recall_and_exact_search_is_exact(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ivf, "PIECE_VALUES", 16 * 40)
    monkeypatch.setattr(ivf, "QUERIES", 7)
    rows = clustered(2500, 16, 30, 1)
    rows += [(5000 + k, rows[3][1]) for k in range(300)]  # copies of one vector fill many pieces
    queries = rows[::50]
    ivf.build(frame(spark, rows), str(tmp_path / "i"))
    index = ivf.load(spark, str(tmp_path / "i"))
    assert index.lists.count() == len(rows) and index.pieces.max() > 5 and index.lists.groupBy("list", "piece").count().agg({"count": "max"}).first()[0] < 120
    want = brute(rows, queries, 10)
    asked = frame(spark, queries, "qid", "q")
    got = found(ivf.nearest(index, asked, 10, probes=8))
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.95 * 10 * len(want)
    assert found(ivf.nearest(index, asked, 10, probes=2, exact=True)) == want


def test_awkward_vectors_and_queries(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [1.0, 0.0]), (9, [float("inf"), 1.0])]
    ivf.build(frame(spark, rows), str(tmp_path / "i"))
    index = ivf.load(spark, str(tmp_path / "i"))
    asked = frame(spark, [(1, [2.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [0.1, 1.0])], "qid", "q")
    assert found(ivf.nearest(index, asked, 5, 1, exact=True)) == {1: [1, 8, 2], 5: [2, 1, 8]}
    ivf.build(frame(spark, [(1, None)]), str(tmp_path / "none"))
    assert ivf.nearest(ivf.load(spark, str(tmp_path / "none")), asked, 3).count() == 0


@pytest.mark.parametrize("k", [1, 5, 40])
def test_centroids_are_unit_and_as_many_as_asked(k):
    rows = np.array([x for _, x in clustered(30, 4, 5, k)])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    centre = ivf.kmeans(rows, k)
    assert len(centre) == min(k, 30) and np.allclose(np.linalg.norm(centre, axis=1), 1)
