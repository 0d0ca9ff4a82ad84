"""Bounds, guards and explanations."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import graph, impact, retrieval
from lodestar.plans import requests

EDGES = [("handler", "run", "CALLS", 0.95), ("run", "get", "CALLS", 0.95), ("tick", "run", "CALLS", 0.95), ("tick", "get", "CALLS", 0.95)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, type string, confidence double")


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(k, "Function", k, k, None, None) for k in ("handler", "run", "tick", "get")], "key string, label string, name string, qualname string, path string, dotted_name string")


@pytest.mark.parametrize(("what", "value", "fine"), [("graph.limit", 5000, True), ("graph.limit", 5001, False), ("search.limit", 0, False), ("debt.offset", 10**9, True), ("debt.offset", -1, False), ("depth", 6, False), ("debt.min_confidence", 1.0, True), ("debt.min_confidence", 1.1, False)])
def test_bounds(what, value, fine):
    if fine:
        assert requests.bounded(what, value) == value
    else:
        with pytest.raises(requests.Refused, match=what):
            requests.bounded(what, value)


def test_pages_say_whether_there_is_more(nodes, edges):
    rows, more = requests.graph_page(nodes, edges, "calls", 3)
    assert rows.count() == 3 and more and not requests.graph_page(nodes, edges, "calls", 4)[1]
    found, more = requests.reached(nodes, edges, "get", False, 2, 1)
    assert [r.node for r in found.collect()] == ["run"] and more
    items, more = requests.impact_page(nodes, edges, "get")
    assert items.count() == 3 and not more
    for wrong in (lambda: requests.graph_page(nodes, edges, "all"), lambda: requests.search(nodes, ""), lambda: requests.search(nodes, "r", 201)):
        with pytest.raises(requests.Refused):
            wrong()
    with pytest.raises(graph.NodeNotFound):
        requests.reached(nodes, edges, "nobody", True)
    assert [r.key for r in requests.search(nodes, "T", 2).collect()] == ["get", "tick"]


def test_debt_needs_a_complete_parse_and_known_kinds(spark):
    jobs = spark.createDataFrame([(1, "a", "2024-01-01", "failed"), (2, "a", "2024-01-02", "complete"), (3, "b", "2024-01-03", "running")], "id long, repo string, started_at string, status string")
    finding = spark.createDataFrame([("x", s, f"s{k}", "p", 1, f"k{k}", "w", {"a": "b"}, 1.0) for k, s in enumerate(["low", "high", "medium"])], "kind string, severity string, subject string, path string, line_start int, key string, why string, metrics map<string,string>, confidence double")
    detectors = {"x": lambda: finding, "broken": lambda: finding.select("nothing")}
    page, failed = requests.debt_page(jobs, "a", detectors, limit=1, offset=1)
    assert [r.severity for r in page.collect()] == ["medium"] and list(failed) == ["broken"]
    assert requests.debt_page(jobs, "a", detectors, ["x"], "medium")[0].count() == 2
    for repo in ("b", "c"):
        with pytest.raises(requests.NotReady):
            requests.debt_page(jobs, repo, detectors)
    with pytest.raises(requests.Refused, match="unknown kinds y"):
        requests.debt_page(jobs, "a", detectors, ["y"])
    with pytest.raises(requests.Refused, match="severity"):
        requests.debt_page(jobs, "a", detectors, min_severity="worst")


def test_only_what_has_an_address_is_fetched_again(spark):
    repos = spark.createDataFrame([("a", "https://h/a"), ("b", None)], "repo string, url string")
    assert requests.reparse_source(repos, "a") == "https://h/a"
    with pytest.raises(requests.NotReady):
        requests.reparse_source(repos, "b")
    with pytest.raises(graph.NodeNotFound):
        requests.reparse_source(repos, "c")


def test_explanations_are_kept_by_key_depth_and_commit(spark, edges):
    asked = []
    explainer = requests.Explainer(lambda prompt: asked.append(prompt) or f"answer {len(asked)}", 2)
    items = lambda root: impact.impact(edges, spark.createDataFrame([(root,)], "node string")).withColumn("label", F.lit("Function")).withColumn("description", F.col("node"))
    alone = explainer.explain("r", "handler", items("handler"))
    assert alone.affected == 0 and "handler" in alone.text and not asked
    first = explainer.explain("r", "get", items("get"), commit="c1")
    again = explainer.explain("r", "get", items("get"), commit="c1")
    assert (first.text, first.cached, first.affected, again.text, again.cached) == ("answer 1", False, 3, "answer 1", True) and "3 node(s) reach it" in asked[0]
    assert not explainer.explain("r", "get", items("get"), commit="c2").cached and not explainer.explain("r", "run", items("run")).cached
    assert not explainer.explain("r", "get", items("get"), commit="c1").cached  # the oldest has gone
    silent = requests.Explainer(lambda prompt: "")
    assert silent.explain("r", "get", items("get")).text and not silent.held


def test_providers_keep_their_contract(spark):
    width = lambda texts: [(i, [float(len(t)), 1.0]) for i, t in reversed(list(enumerate(texts)))]
    rows = spark.createDataFrame([(1, "abc"), (2, None), (3, " "), (4, "")], "id int, text string")
    assert {r.id: r.embedding for r in retrieval.embed_with(rows, "w", width, 2, batch=2).collect()} == {1: [3.0, 1.0], 2: None, 3: [1.0, 1.0], 4: [1.0, 1.0]}
    for broken, message in ((lambda t: [], "0 vectors for 1"), (lambda t: [(0, [1.0])], "1 dimensions, not 2"), (lambda t: 1 / 0, "ZeroDivisionError")):
        with pytest.raises(retrieval.ProviderError, match=message):
            retrieval.embed_batch("w", broken, ["x"], 2)
