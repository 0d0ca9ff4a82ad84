"""The trigram index gives the rows of a scan, from few candidates."""

import random

import pytest

from lodestar.operators import graph, trigram

SCHEMA = "key string, label string, qualname string, path string, name string, dotted_name string"


@pytest.fixture(scope="module")
def nodes(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdeÉ_/.%", k=rng.randint(0, 9)))
    rows = [(f"k{k:04d}", "File", word(), word(), word() if k % 3 else None, None) for k in range(400)]
    rows += [("odd", "File", None, None, None, None), ("long", "Module", "x" * 50_000 + "needle", None, "", "pkg.Needle"), ("twice", "File", "aabbé", None, None, None), ("twice", "File", "aabbÉ", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def path(nodes, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("index") / "i")
    graph.index_nodes(nodes, at)
    return at


@pytest.mark.parametrize("query", ["abc", "AAB", "aabbé", "needle", "a", "", "b/", "%", "É_/", "zzz", "xxxxneedle", "pkg.n", "abc" * 5, "a.b"])
def test_rows_are_those_of_a_scan(spark, nodes, path, query):
    scan = [tuple(r) for r in graph.search_nodes(nodes, query, 1000).collect()]
    assert sorted(map(repr, scan)) == sorted(repr(tuple(r)) for r in graph.search_index(spark, path, query, 1000).select(*nodes.columns, "shown_length").collect())


def test_candidates_are_few(spark, nodes, path):
    found = trigram.candidates(spark, path, "xxneedle")
    assert [r.key for r in found.collect()] == ["long"] and trigram.candidates(spark, path, "ab") is None
    plan = graph.search_index(spark, path, "xxneedle")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and trigram.candidates(spark, path, "needlez").count() == 0


def test_a_null_key_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="key is null"):
        graph.index_nodes(spark.createDataFrame([(None, "File", "a", None, None, None)], SCHEMA), str(tmp_path / "i"))


def test_postings_are_dealt_whatever_the_files_of_the_rows(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i}", f"name {i:05d} of many") for i in range(300)], "key string, name string").coalesce(1)
    trigram.build(rows, ["name"], f"{tmp_path}/index")
    tasks = {f.name.split("-")[1] for f in (tmp_path / "index" / "postings").glob("bucket=*/part-*")}
    assert len(tasks) > trigram.BUCKETS // 4
    assert trigram.search(spark, f"{tmp_path}/index", "NAME 00123 of", ["name"]).count() == 1
