"""Traversals, impact and risk against closed forms and brute force."""

import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import scoring
from lodestar.operators import bitmaps, cochange, graph, impact, resolve, risk
from lodestar.plans import projections as p

EDGE = "src string, dst string, type string, confidence double"


def edges(spark, rows):
    return spark.createDataFrame([(a, b, t, c) for a, b, c, t in rows], EDGE)


def roots(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "node string")


DIAMOND = [("handler", "run", 0.95, "CALLS"), ("run", "get", 0.95, "CALLS"), ("tick", "run", 0.95, "CALLS"), ("tick", "get", 0.95, "CALLS")]


def test_diamond(spark):
    got = {r.node: r for r in impact.impact(edges(spark, DIAMOND), roots(spark, "get"), 3, 0.6).collect()}
    assert {k: (r.hops, r.score) for k, r in got.items()} == {"run": (1, 0.95), "tick": (1, 0.95), "handler": (2, 0.5415)}
    assert got["handler"].route == ["get", "run", "handler"] and got["handler"].via == ["CALLS", "CALLS"]
    s = impact.summarize(impact.impact(edges(spark, DIAMOND), roots(spark, "get")).withColumn("label", F.lit("Function"))).first()
    assert (s.total, s.direct, s.max_hops, s.top_score, s.by_hop, s.by_type) == (3, 2, 2, 0.95, "1:2,2:1", "Function:3")


def test_bounds_are_checked(spark):
    e = edges(spark, DIAMOND)
    with pytest.raises(ValueError):
        graph.dependents(e, roots(spark, "get"), 6)
    with pytest.raises(ValueError):
        impact.impact(e, roots(spark, "get"), 3, 0.0)
    with pytest.raises(graph.NodeNotFound):
        graph.get_node(e.withColumnRenamed("src", "key"), "nobody")


def best(rows, root, depth, decay):
    """All trails backwards, by hand."""
    found = {}
    todo = [(root, 1.0, 0, frozenset(), (root,))]
    while todo:
        node, c, h, used, route = todo.pop()
        for k, (a, b, conf, _) in enumerate(rows):
            if b == node and k not in used and h < depth:
                nxt = (a, c * conf, h + 1, used | {k}, (*route, a))
                todo.append(nxt)
                if a != root:
                    key = (-round(nxt[1] * decay**h, 9), h + 1)
                    found[a] = min(found.get(a, key), key)
    return found


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.sampled_from("abcdef"), st.sampled_from([1.0, 0.95, 0.9, 0.85, 0.5])), min_size=1, max_size=14), st.sampled_from([1.0, 0.6, 0.1]))
def test_impact_is_the_best_trail(spark, rows, decay):
    rows = [(*r, "CALLS") for r in rows]
    got = {r.node: (-r.score, r.hops) for r in impact.impact(edges(spark, rows), roots(spark, "a"), 4, decay).collect()}
    want = best(rows, "a", 4, decay)
    assert set(got) == set(want) and all(abs(got[k][0] - want[k][0]) < 1e-4 for k in want)


def test_neighbours_leave_seeds_out(spark):
    got = {r.node: (r.hops, r.seed) for r in graph.neighbours(edges(spark, DIAMOND), roots(spark, "run", "tick"), 1).collect()}
    assert set(got) == {"handler", "get"} and got["handler"] == (1, "run")


def test_sweep_and_upsert(spark):
    old = spark.createDataFrame([("a", "File", "r1"), ("b", "File", None), ("repo", "Repo", "r1")], "key string, label string, run_id string")
    new = spark.createDataFrame([("a", "File", "r2")], old.schema)
    kept, swept = graph.sweep(graph.upsert(old, new, ["key"]), "r2")
    assert {r.key for r in kept.collect()} == {"a", "repo"} and {r.key for r in swept.collect()} == {"b"}


def test_scoring(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert [value(scoring.saturate(F.lit(x), 8.0)) for x in (8, 24, -3)] == [0.5, 0.75, 0.0]
    plain = spark.createDataFrame([("k", "p", 0, 0, 0, 0, 0.0, None, 0)], "key string, path string, dependents long, direct_dependents long, dependencies long, co_partners long, max_jaccard double, change_count long, test_references long")
    r = risk.score(plain).first()
    assert r.score == pytest.approx(26.7) and r.band == "moderate" and abs(sum(r.weights.values()) - 1) < 1e-3 and "coupling" not in r.weights
    with_history = risk.score(plain.withColumn("change_count", F.lit(0).cast("long"))).first()
    assert with_history.score == 20.0 and with_history.weights["churn"] == 0.1
    for path, yes in [("tests/x.py", True), ("a/test/x.py", True), ("Test_a.py", True), ("a_test.py", True), ("conftest.py", True), ("a/b/test_x.py", True), ("TESTS/a.txt", True), ("contest.py", False), ("src/a.py", False), ("latest/x.py", False), ("attest_.py", False), ("testing/a.py", False)]:
        assert value(scoring.is_test_path(F.lit(path))) == yes, path


@pytest.mark.parametrize(("values", "want"), [([1, 2, 3, 4, 5, 6], 5.0), ([], 0.0), ([7], 7.0), ([1] * 10 + [40], 1.0), (list(range(1, 12)), 10.0)])
def test_percentile_is_nearest_rank(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "v int")
    assert scoring.percentile_rank(df, "v", 0.9).first().p == want


def test_cochange(spark):
    rows = [(0, "c", "2024-01-03", ["a", "b"]), (1, "d", "2024-01-02", ["b", "a", "a"]), (2, "e", "2024-01-01", ["b"]), (3, "f", "2024-01-01", ["b"]), (4, "g", "2023-12-31", [f"f{i}" for i in range(50)]), (5, "h", "2023-12-30", [])]
    commits = spark.createDataFrame(rows, "ord int, sha string, authored_at string, paths array<string>")
    r = cochange.co_change(commits).collect()
    assert [(x.left_path, x.right_path, x.shared, x.jaccard, x.last_together) for x in r] == [("a", "b", 2, 0.5, "2024-01-03")]
    s = cochange.window_stats(commits).first()
    assert (s.commits_read, s.commits_used, s.commits_skipped) == (6, 4, 1)
    assert {x.path for x in cochange.partner_index(cochange.co_change(commits)).collect()} == {"a", "b"}


def test_cochange_of_known_files_only(spark):
    rows = [(0, "2024-01-03", ["a", "b", "gone"]), (1, "2024-01-02", ["b", "a", "a", *[f"x{k}" for k in range(50)]]), (2, "2024-01-01", ["gone"]), (3, "2023-01-01", ["a", "b", "c"])]
    commits = spark.createDataFrame(rows, "ord int, authored_at string, paths array<string>")
    known = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "path string")
    got = {(r.ord, r.n_files, tuple(r.files or ())) for r in cochange.sized_commits(commits, known, 2).collect()}
    assert got == {(0, 2, ("a", "b")), (1, 2, ("a", "b")), (3, 3, ())}
    assert {(r.left_path, r.right_path, r.shared) for r in cochange.co_change(commits, known, 2).collect()} == {("a", "b", 2)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sets(st.sampled_from("abcde"), max_size=5), min_size=1, max_size=12))
def test_cochange_counts_pairs(spark, commits):
    df = spark.createDataFrame([(k, str(k), str(k), sorted(c)) for k, c in enumerate(commits)], "ord int, sha string, authored_at string, paths array<string>")
    got = {(r.left_path, r.right_path): r.shared for r in cochange.co_change(df, max_files=4, min_shared=1).collect()}
    want = {}
    for c in commits:
        if len(c) <= 4:
            for pair in itertools.combinations(sorted(c), 2):
                want[pair] = want.get(pair, 0) + 1
    assert got == want


def test_lookup_follows_two_reexports_and_stops(spark):
    symbols = spark.createDataFrame(
        [("d.py", "d", "f", "f", "function", None, 1), ("c.py", "c", "g", "g", "function", None, 1), ("c.py", "c", "A.h", "h", "method", "A", 2), ("c.py", "c", "B.h", "h", "method", "B", 3)],
        "path string, module string, qualname string, name string, kind string, parent string, ord int",
    )
    bound = spark.createDataFrame(
        [("a.py", "f", "b.py", "f"), ("b.py", "f", "c.py", "f"), ("c.py", "f", "d.py", None), ("b.py", "x", "c.py", "g"), ("b.py", "h", "c.py", "h"), ("e.py", "f", "e.py", "f"), ("a.py", "math", None, None)],
        "path string, bound_name string, target_path string, imported_name string",
    )
    asked = [
        ("1", "d.py", "f", "d.py", "f", False),  # at once
        ("2", "c.py", "f", "d.py", "f", False),  # one re-export, without a name of its own
        ("3", "b.py", "f", "d.py", "f", False),  # two
        ("4", "a.py", "f", None, None, False),  # three are too many
        ("5", "b.py", "x", "c.py", "g", False),  # renamed on the way
        ("6", "b.py", "h", None, None, True),  # two methods of one name
        ("7", "c.py", "A.h", "c.py", "A.h", False),
        ("8", "b.py", "A.h", None, None, False),  # dotted names are not followed
        ("9", "e.py", "f", None, None, False),  # a file that imports from itself
        ("10", "a.py", "math", None, None, False),
    ]
    rows = spark.createDataFrame([a[:3] for a in asked], "look_id string, look_path string, look_name string")
    found = {r.look_id: (r.dst_path, r.q, r.ambiguous) for r in resolve.lookup_in_file(rows, symbols, bound).selectExpr("look_id", "dst_path", "dst.qualname as q", "ambiguous").collect()}
    assert found == {a[0]: a[3:] for a in asked}


def test_merge_keeps_what_other_steps_set(spark):
    old = spark.createDataFrame([("r", "a", "x", 3), ("r", "b", "y", 4)], "repo string, key string, name string, change_count int")
    new = spark.createDataFrame([("r", "a", None), ("r", "c", "z")], "repo string, key string, name string")
    got = {(r.key, r.name, r.change_count) for r in graph.merge_properties(old, new, ["repo", "key"]).collect()}
    assert got == {("a", None, 3), ("b", "y", 4), ("c", "z", None)}
    assert [r.key for r in graph.repeated_keys(new.union(new.limit(1))).collect()] and graph.repeated_keys(new).isEmpty()


def test_sweep_leaves_other_repositories(spark):
    rows = spark.createDataFrame([("r", "a", "1"), ("q", "a", "1"), ("r", "b", "2")], "repo string, key string, run_id string")
    kept, gone = graph.sweep(rows, "2", None, rows.where("repo = 'r'").select("repo"))
    assert {(r.repo, r.key) for r in kept.collect()} == {("q", "a"), ("r", "b")} and {(r.repo, r.key) for r in gone.collect()} == {("r", "a")}


def test_enclosing_class_by_parents(spark):
    rows = [("m", "A", "class", None), ("m", "A.f", "method", "A"), ("m", "A.f.g", "function", "A.f"), ("m", "A.f.B", "class", "A.f"), ("m", "A.f.B.h", "method", "A.f.B"), ("m", "C", "class", None), ("m", "C.gone.k", "function", "C.gone"), ("m", "top", "function", None), ("m", "top.x", "function", "top")]
    symbols = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "path string, qualname string, kind string, parent string, ord int")
    assert {r.caller: r.owner for r in resolve.enclosing_classes(symbols).collect()} == {"A.f": "A", "A.f.g": "A", "A.f.B": "A", "A.f.B.h": "A.f.B"}


def test_dependents_by_bitmaps_against_brute_force(spark):
    import random

    rng = random.Random(12)
    for n, m, depth in ((15, 40, 2), (40, 60, 5), (3, 6, 3)):
        rows = {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)}
        near = {k: {a for a, b in rows if b == k and a != b} for k in {x for r in rows for x in r}}
        want = {}
        for k in near:
            seen, edge = set(), {k}
            for _ in range(depth):
                edge = set().union(*(near[x] for x in edge))
                seen |= edge
            if seen - {k}:
                want[k] = len(seen - {k})
        got = bitmaps.dependents_within(spark.createDataFrame(sorted(rows), "src string, dst string"), depth).collect()
        assert {r.key: r.dependents for r in got} == want and len(got) == len(want)


def test_a_hub_between_very_many_makes_no_pairs(spark):
    n = 50_000
    star = spark.range(n).selectExpr("concat('a', id) as src", "'hub' as dst").union(spark.range(n).selectExpr("'hub' as src", "concat('z', id) as dst"))
    got = bitmaps.dependents_within(star, 2).groupBy("dependents").count().collect()
    assert {r.dependents: r["count"] for r in got} == {n: 1, n + 1: n}


@pytest.mark.parametrize("light", [0, 1, 4, 4096])
def test_dependents_of_both_kinds_of_sets(spark, monkeypatch, light):
    import random

    monkeypatch.setattr(bitmaps, "LIGHT", light)
    rng = random.Random(light)
    rows = {(f"n{rng.randrange(12)}", f"n{rng.randrange(12) ** 2 // 11}") for _ in range(22)}
    near = {(a, b) for a, b in rows if a != b}
    for depth in (1, 3):
        reach = set(near)
        for _ in range(depth - 1):
            reach |= {(a, c) for a, b in near for b2, c in reach if b == b2}
        want = {}
        for b in (b for a, b in reach if a != b):
            want[b] = want.get(b, 0) + 1
        got = bitmaps.dependents_within(spark.createDataFrame(sorted(rows), "src string, dst string"), depth).collect()
        assert {r.key: r.dependents for r in got} == want


def test_sets_of_a_sparse_graph_cost_their_numbers_and_not_blocks(spark):
    """Four far numbers reach each node within two edges: they travel as arrays, whatever blocks they are in."""
    from lodestar.plans.written import Written

    n, keep = 300_000, Written(spark)
    step = keep(spark.range(1, n + 1).selectExpr("id as s", f"1 + (id * 7919) % {n} as d").union(spark.range(1, n + 1).selectExpr("id as s", f"1 + (id * 104729) % {n} as d")))
    small, large = bitmaps._hop(step, None, None, keep)
    small, large = bitmaps._hop(step, keep(small), keep(large), keep)
    assert large.isEmpty()
    assert small.selectExpr("sum(size(ids))").first()[0] <= 6 * n


def test_each_further_way_to_a_class_is_made_once(spark):
    rows = [("", "m", f"C{a}", "m", f"C{b}", (a - b, [0] * (a - b))) for a in range(12) for b in range(max(0, a - 4), a + 1)]
    now = spark.createDataFrame(rows, "repo string, path string, owner string, at_path string, at_qualname string, rank struct<level:int,rank:array<int>>")
    got = [(r.owner, r.at_qualname, r["rank"].level) for r in resolve._further(now, 4, 8).collect()]
    assert sorted(got) == sorted((f"C{a}", f"C{b}", a - b) for a in range(12) for b in range(a) if 4 < a - b < 8)


def breadth_first(bases, owner):
    """{class: (level, positions)} by hand: the first place where a class is met counts."""
    found, edge = {owner: (0, ())}, [owner]
    while edge:
        met = [(b, (found[a][0] + 1, (*found[a][1], i))) for a in edge for i, b in enumerate(bases.get(a, []))]
        edge = []
        for b, rank in met:
            if b not in found:
                found[b] = rank
                edge.append(b)
    return found


def test_classes_are_looked_up_at_any_depth(spark):
    """A chain of 40 classes, a ring of 13 below it, a diamond whose ways are 12 and 13 long: all are found unless levels are given."""
    bases = {f"C{k}": [f"C{k + 1}"] for k in range(39)} | {f"R{k}": [f"R{(k + 1) % 13}"] for k in range(13)}
    bases["R5"] = ["R6", "C30"]
    bases |= {"D": ["A1", "B1"], "B12": ["Z"], "A11": ["Y"], "Y": ["Z"]} | {f"A{k}": [f"A{k + 1}"] for k in range(1, 11)} | {f"B{k}": [f"B{k + 1}"] for k in range(1, 12)}
    names = sorted(set(bases) | {b for bs in bases.values() for b in bs})
    rows = spark.createDataFrame([("m", a, i, "m", b) for a, bs in bases.items() for i, b in enumerate(bs)], "path string, qualname string, position int, base_path string, base_qualname string")
    classes = spark.createDataFrame([("m", k) for k in names], "path string, qualname string")
    want = {(a, b): rank for a in names for b, rank in breadth_first(bases, a).items()}
    for levels in ((), (10,), (1,)):
        got = resolve.class_lookup_order(rows, classes, *levels).collect()
        found = {(r.owner, r.at_qualname): (r["rank"].level, tuple(r["rank"].rank)) for r in got}
        assert len(found) == len(got) and found == {k: v for k, v in want.items() if not levels or v[0] < levels[0]}


def test_parts_are_looked_up_at_any_depth(spark, tmp_path):
    import duckdb

    from lodestar.plans import queries_graph

    def bases(k):
        return [b for b in dict.fromkeys((k // 2, k // 3)) if b > 0]

    keys, edge = set(), {3_000_000}
    while edge:
        keys |= edge
        edge = {b for k in edge for b in bases(k)}
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(tuple(r) for r in queries_graph.class_lookup(spark, str(tmp_path)).collect())
    graph_ = {k: bases(k) for k in keys}
    want = sorted((f"C{a}", f"C{b}", level, ",".join(map(str, rank))) for a in keys for b, (level, rank) in breadth_first(graph_, a).items())
    assert got == want and max(r[2] for r in got) > 12
    con = duckdb.connect()
    con.execute(f"create view part as select * from read_parquet('{tmp_path}/part.parquet/*.parquet')")
    assert got == sorted(con.execute(queries_graph.ORACLE_SQL["class_lookup"]).fetchall())


def test_pairs_of_the_tables_are_counted_without_sorting_texts(spark, sf):
    plan = p.co_changed(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "min_by" in plan


def test_numbers_stand_for_names_whatever_the_key(spark, tmp_path):
    keys = [0, 1, 7, 99999999, 100000000, 123456789, 123456780, -5, -6, -123, -1234567, -12345678, None]
    df = spark.createDataFrame([(k,) for k in keys], "k long").select(F.concat(F.lit("p"), F.lpad(F.col("k").cast("string"), 8, "0")).alias("path"), p.number(F.lpad(F.col("k").cast("string"), 8, "0")).alias("n"))
    rows = df.withColumn("back", p.name(F.col("n"), "p")).collect()
    assert all(r.path == r.back for r in rows)
    some = [r for r in rows if r.n is not None]
    assert [r.path for r in sorted(some, key=lambda r: r.n)] == sorted(r.path for r in some)
    spark.createDataFrame([(o, k) for o in (1, 2, 3) for k in keys], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("select o_orderkey, timestamp'1995-03-04 00:00:00' as o_orderdate from values (1L), (2L), (4L) as t(o_orderkey)").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(tuple(r) for r in p.co_changed(spark, str(tmp_path)).collect())
    want = sorted(tuple(r) for r in cochange.co_change(p.commits(spark, str(tmp_path)), max_pairs=None).collect())
    names = len({r.path for r in some})
    assert got == want and len(got) == names * (names - 1) // 2 and {r[2] for r in got} == {2} and {r[6] for r in got} == {"1995-03-04"}


def test_pairs_of_one_file_are_all_its_pairs(spark):
    rows = [(-i, f"2020-01-{i + 1:02d}", [f"f{(i * k) % 7}" for k in range(1, 5)]) for i in range(20)]
    commits = spark.createDataFrame(rows, "ord long, authored_at string, paths array<string>")
    every = cochange.co_change(commits, max_pairs=None)
    for path in ("f1", "f6", "none"):
        got = cochange.co_change(commits, max_pairs=None, ordered=False, of=spark.createDataFrame([(path,)], "path string"))
        assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in every.collect() if path in r[:2])
    assert "Union" not in cochange.partner_index(every)._jdf.queryExecution().optimizedPlan().toString()
