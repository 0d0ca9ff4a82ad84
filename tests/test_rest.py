"""Debt, chunks, retrieval, limits, validation, streaming and sources on small inputs."""

import io
import json
import random
import subprocess
import uuid
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.functions import keys, text
from lodestar.operators import chunking, cochange, conversation, debt, graph, impact, retrieval
from lodestar.operators import cycles as graph_cycles
from lodestar.plans import cli, lifecycle
from lodestar.sources import extract, sinks, tree
from lodestar.streaming import token_bucket

SYMBOL = "path string, module string, name string, qualname string, kind string, line_start int, line_end int, complexity int, docstring string, key string"


def test_detectors(spark):
    rows = [("a.py", "a", f"f{i}", f"f{i}", "function", 1, 3, 1, "doc", f"k{i}") for i in range(10)] + [("a.py", "a", "big", "big", "function", 5, 30, 40, None, "kb"), ("a.py", "a", "_p", "C._p", "method", 1, 2, 1, None, "kp"), ("a.py", "a", "main", "main", "function", 1, 2, 1, None, "km"), ("a.py", "a", "e", "e", "function", 1, 2, 1, "", "ke")]
    s = spark.createDataFrame(rows, SYMBOL)
    found = debt.detect_complexity(s).collect()
    assert [(r.subject, r.severity, r.metrics["threshold"]) for r in found] == [("big", "high", "10.0")]
    assert [(r.subject, r.severity) for r in debt.detect_missing_docstrings(s).collect()] == [("big", "low")]
    files = spark.createDataFrame([("a.py", "fa", 900), ("b.py", "fb", 500)], "path string, key string, line_count int")
    many = s.crossJoin(spark.range(3)).drop("id")
    assert [r.path for r in debt.detect_god_files(files, many).collect()] == ["a.py"]

    def broken():
        raise RuntimeError("no table")

    all_, ran, failed = debt.run_detectors({"complexity": lambda: debt.detect_complexity(s), "dead_code": broken, "lazy": lambda: s.select(F.raise_error(F.lit("late")).alias("kind")), "missing_docstring": lambda: debt.detect_missing_docstrings(s)})
    assert ran == ["complexity", "missing_docstring"] and set(failed) == {"dead_code", "lazy"} and [r.severity for r in all_.collect()] == ["high", "low"]
    page = debt.to_markdown(all_, "shop", ran, failed, "2024-01-01")
    assert "**2 findings.**" in page and "did not run" in page and "### High (1)" in page and "| `a.py` | 2 | high |" in page


def test_a_detector_that_fails_in_its_last_row_is_named(spark):
    rows = spark.range(1000).repartition(8)
    finding = lambda why: rows.select(F.lit("x").alias("kind"), F.lit("low").alias("severity"), F.col("id").cast("string").alias("subject"), F.lit("p").alias("path"), F.lit(1).alias("line_start"), F.lit("k").alias("key"), why.alias("why"), F.create_map(F.lit("a"), F.lit("b")).alias("metrics"), F.lit(1.0).alias("confidence"))
    breaks = F.when(F.col("id") == 999, F.raise_error(F.lit("row 999"))).otherwise("fine")
    all_, ran, failed = debt.run_detectors({"good": lambda: finding(F.lit("fine")), "bad": lambda: finding(breaks)})
    assert ran == ["good"] and list(failed) == ["bad"] and all_.count() == 1000


def plain_cycles(edges, longest=6):
    step, out = {}, set()
    for a, b in edges:
        if a != b:
            step.setdefault(a, set()).add(b)

    def go(path):
        for b in step.get(path[-1], ()):
            if b == path[0] and len(path) > 1:
                out.add(tuple(path))
            elif b > path[0] and b not in path and len(path) < longest:
                go([*path, b])

    for a in step:
        go([a])
    return sorted(out, key=lambda c: (len(c), c))


def test_cycles_against_brute_force(spark):
    rng = random.Random(8)
    for n, m, limit in ((6, 14, None), (7, 30, 25), (9, 20, 1000)):
        edges = {(f"f{rng.randrange(n)}", f"f{rng.randrange(n)}") for _ in range(m)}
        df = spark.createDataFrame(sorted(edges), "src string, dst string")
        every = plain_cycles(edges)
        found = debt.cycles(df)
        assert sorted(tuple(r.files) for r in found.collect()) == sorted(every)
        kept = every if limit is None else every[:limit]
        want = {c for c in kept if not any(len(x) < len(c) and set(x) <= set(c) for x in kept)}
        got = debt.minimal_cycles(found, limit).collect()
        assert {tuple(r.files) for r in got} == want and len(got) == len(want)


def test_components_against_brute_force(spark):
    rng = random.Random(3)
    for n, m in ((12, 16), (30, 45)):
        edges = {(f"f{rng.randrange(n):02d}", f"f{rng.randrange(n):02d}") for _ in range(m)}
        reach = {a: {a} for e in edges for a in e}
        for _ in range(n):
            for a in reach:
                reach[a] |= {y for x, y in edges if x in reach[a]}
        want = {a: min(b for b in reach[a] if a in reach[b]) for a in reach if any(a in reach[b] for b in reach[a] - {a})}
        got = graph_cycles.components(spark.createDataFrame(sorted(edges), "src string, dst string")).collect()
        assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_a_long_chain_has_no_component_and_a_long_ring_one(spark):
    chain = [(f"{k:04d}", f"{k + 1:04d}") for k in range(20)]
    df = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    assert graph_cycles.components(df(chain)).count() == 0
    assert {r.component for r in graph_cycles.components(df([*chain, ("0020", "0000")])).collect()} == {"0000"}


def test_cycles(spark):
    e = lambda *p: spark.createDataFrame([(a, b) for a, b in p], "src string, dst string")
    assert [r.files for r in debt.cycles(e("ab", "ba", "ca")).collect()] == [["a", "b"]]
    nested = debt.minimal_cycles(debt.cycles(e("ab", "ba", "bc", "ca"))).collect()
    assert [r.files for r in nested] == [["a", "b"]]
    both = debt.minimal_cycles(debt.cycles(e("ab", "bc", "ca", "ac", "cb", "ba"))).collect()
    assert sorted(r.files for r in both) == [["a", "b"], ["a", "c"], ["b", "c"]]


@pytest.mark.parametrize(("name", "path", "decorators", "want"), [
    ("__eq__", "a.py", [], None), ("helper", "tests/a.py", [], None), ("x", "a/test_b.py", [], None), ("main", "a.py", [], None), ("view", "a.py", ["app.get('/x')"], None), ("f", "a.py", ["property"], None),
    ("_x", "a.py", [], 0.75), ("y", "a.py", ["lru_cache"], 0.5), ("z", "a.py", [], 0.6), ("w", None, [], 0.6),
])
def test_dead_code_verdicts(spark, name, path, decorators, want):
    c = spark.createDataFrame([("k", "Function", name, name, path, "function", 1, 4, decorators)], "key string, label string, name string, qualname string, path string, kind string, line_start int, line_end int, decorators array<string>")
    got = debt.dead_code_verdict(c).collect()
    assert [r.confidence for r in got] == ([] if want is None else [want])


def test_windows_cover_as_a_loop_would(spark):
    cases = [(s, s + n - 1, chars) for s in (1, 7) for n in (1, 9, 16, 17, 40, 300) for chars in (10, 4000, 4001, 9000, 60000, 500000)]
    df = spark.createDataFrame(cases, "s int, e int, c int").select("s", "e", "c", chunking.windows(F.col("s"), F.col("e"), F.col("c")).alias("w"))
    for r in df.collect():
        want, at, lines = [], r.s, r.e - r.s + 1
        per = max(16, 4000 // max(1, r.c // lines))
        if r.c <= 4000:
            want = [(r.s, r.e)]
        while not want or want[-1][1] < r.e:
            want.append((at, min(r.e, at + per - 1)))
            at = want[-1][1] - 8 + 1
        assert [(w.line_start, w.line_end) for w in r.w] == want, (r.s, r.e, r.c)


def test_ids(spark):
    name = "r|a.py|f|3|0"
    assert spark.range(1).select(keys.uuid5(chunking.NAMESPACE, F.lit(name))).first()[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    for given, want in [("..core.config", "core"), ("a.b", "a"), ("...", "..."), ("x", "x")]:
        assert spark.range(1).select(keys.top_level(F.lit(given))).first()[0] == want
    k = spark.range(1).select(keys.symbol_key(F.lit("r"), F.lit(""), F.lit("f"), F.lit("a.py"))).first()[0]
    assert k == "sym:r:a.py:f"


@pytest.mark.parametrize(("url", "want"), [
    ("https://github.com/o/r.git", None), ("git@github.com:o/r.git", None), ("", "empty"), ("https://x.org/" + "a" * 600, "too_long"), ("https://x.org/a\nb", "control_characters"), ("ftp://x.org/a", "scheme"), ("/local/path", "scheme"),
    ("https://", "host"), ("https://u:tok@x.org/a", "credentials"), ("ssh://git@x.org/a", None), ("http://localhost/a", "private_host"), ("http://127.0.0.1/a", "private_host"), ("http://10.1.2.3:80/a", "private_host"), ("http://8.8.8.8/a", None),
    ("http://[::1]/a", "private_host"), ("http://172.20.0.1/a", "private_host"), ("http://172.40.0.1/a", None), ("git@192.168.0.3:a/b", "private_host"), ("http://169.254.1.1/", "private_host"), ("http://0.0.0.0/", "private_host"),
])
def test_git_urls(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(text.git_url_problem(F.col("u"))).first()[0] == want


@pytest.mark.parametrize(("source", "kind", "name"), [("https://github.com/o/my repo.git", "git", "my-repo"), ("git@h:o/r.git", "git", "r"), ("/tmp/x/Archive.ZIP", "zip", "Archive"), ("/src/proj/", "local", "proj"), ("--", "local", None)])
def test_sources(spark, source, kind, name):
    df = spark.createDataFrame([(source,)], "s string")
    k = text.classify_source(F.col("s"))
    assert tuple(df.select(k, text.derive_name(F.col("s"), k)).first()) == (kind, name)


def test_hybrid_reserves_slots(spark):
    v = [(k, [1.0, 0.1 * k], f"s{k}", 0) for k in range(12)] + [(50, [0.5, 1.0], "n1", 0), (51, [1.0, 0.9], "n2", 0), (52, [1.0, 0.0], "n2", 1)]
    vectors = spark.createDataFrame(v, "id long, embedding array<double>, symbol_key string, part int")
    edges = spark.createDataFrame([("s0", "n1", "CALLS", 1.0), ("n2", "s1", "CALLS", 0.5)], "src string, dst string, type string, confidence double")
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<double>")
    got = retrieval.hybrid(vectors.where("part = 0"), edges, q, 5).collect()
    assert len(got) == 5 and sum(r.source == "graph" for r in got) == 2 and {r.symbol_key for r in got if r.source == "graph"} == {"n1", "n2"}
    assert [r.source for r in retrieval.hybrid(vectors.where("part = 0"), edges, q, 1).collect()] == ["graph"]
    with pytest.raises(ValueError):
        retrieval.top_k(vectors, q, 51)
    with pytest.raises(Exception, match="must have 3 dimensions"):
        retrieval.checked_width(vectors, "embedding", 3).collect()
    e = retrieval.hash_vector("x", 64)
    assert len(e) == 64 and abs(sum(a * a for a in e) - 1) < 1e-9 and e == retrieval.hash_vector("x", 64) != retrieval.hash_vector("y", 64)


def test_conversation(spark):
    turns = spark.createDataFrame([(1, k, "user" if k % 2 else "assistant", "" if k == 9 else f"t{k}") for k in range(1, 11)], "conv_id long, turn long, role string, text string")
    assert [r.turn for r in conversation.history(turns).orderBy("turn").collect()] == [3, 4, 5, 6, 7, 8, 10]
    assert conversation.titles(turns).first().title == "t1"
    hits = spark.createDataFrame([(1, "a.py", 3, "function", "f", "f", "graph", "body", 0.5), (2, "b.py", 1, "module", None, "b.py", "vector", "x", 0.9)], "id long, path string, line_start int, kind string, qualname string, name string, source string, text string, score double")
    assert conversation.context_prompt(hits.withColumn("g", F.lit(1)), ["g"]).first().prompt == "--- b.py:1 — module b.py ---\nx\n\n--- a.py:3 — function f (via call graph) ---\nbody"
    assert "No excerpts" in conversation.user_turn(None, "why?") and conversation.user_turn("e", "q", "radius").endswith("radius\n\nQuestion: q")


def test_explanations(spark):
    e = spark.createDataFrame([("sym:r:m:run", "sym:r:m:get", "CALLS", 0.95)], "src string, dst string, type string, confidence double")
    items = impact.impact(e, spark.createDataFrame([("sym:r:m:get",)], "node string"))
    assert "nothing in this repository reaches it" in impact.radius_block(items.where("false"), "get")
    block = impact.radius_block(items, "get")
    assert "1 node(s) within 3 hop(s), 1 of them direct" in block and "route: get -> run" in block
    symbols = spark.createDataFrame([("m.py", "m", "run", "function", 4, [("a", "int")], "str", True, None, "Runs.\nMore.")], "path string, module string, qualname string, kind string, line_start int, parameters array<struct<name:string,annotation:string>>, returns string, is_async boolean, base_classes array<string>, docstring string")
    told = impact.describe(items.withColumn("module", F.lit("m")).withColumn("qualname", F.lit("run")).withColumn("path", F.lit(None).cast("string")).withColumn("label", F.lit("Function")).withColumn("display", F.lit("run")), symbols)
    assert told.first().description == "m.py:4 — async def run(a: int) -> str\n    doc: Runs."
    assert "[1] hop 1, confidence 0.95, score 0.95, via CALLS" in impact.build_prompt("get", told)


def test_token_bucket_batch_and_stream(spark, tmp_path):
    rows = [("a", k, float(t)) for k, t in enumerate([0, 0, 0, 1, 30, 61])] + [("b", 10, 5.0)]
    batch = {r.id: (r.allowed, r.wait) for r in token_bucket.check(spark.createDataFrame(rows, "client string, id long, at double"), 2, 1.0).collect()}
    assert [batch[k][0] for k in range(6)] == [True, True, False, False, False, True] and batch[2][1] == 60.0 and batch[10] == (True, None)
    pd.DataFrame(rows, columns=["client", "id", "at"]).to_parquet(tmp_path / "x.parquet")
    stream = spark.readStream.schema("client string, id long, at double").parquet(str(tmp_path))
    q = token_bucket.check_stream(stream, 2, 1.0, 0).writeStream.format("memory").queryName("decided").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert {r.id: r.allowed for r in spark.table("decided").collect()} == {k: v[0] for k, v in batch.items()}


def test_stream_with_timers_decides_like_the_batch(spark, tmp_path):
    rows = [("a", k, 1e6 + t) for k, t in enumerate([0, 0, 0, 1, 30, 61])] + [("b", 10, 1e6 + 5)] + [("a", 20 + k, 1e6 + 9000 + t) for k, t in enumerate([0, 0, 0, 20])] + [(None, 30, 1e6 + 5), ("a", 40, 2e6)]
    batch = {r.id: (r.allowed, r.wait) for r in token_bucket.check(spark.createDataFrame(rows, "client string, id long, at double"), 2, 1.0).collect()}
    for name, part in (("1", rows[:7] + [rows[-2]]), ("2", rows[7:-2]), ("3", rows[-1:])):
        df = spark.createDataFrame(part, "client string, id long, at double").selectExpr("client", "id", "timestamp_micros(cast(at * 1000000 as long)) as time")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("client string, id long, time timestamp").parquet(str(tmp_path / "in"))
        decided = token_bucket.run_stream(stream, 2, 1.0, str(tmp_path / "out"), 120)  # goes on from the checkpoint
    assert {r.id: (r.allowed, r.wait) for r in decided.collect()} == batch


def test_cache_and_registry(spark):
    cache, made = lifecycle.ParseCache(2), []
    get = lambda repo, at: cache.get(repo, at, "v", lambda: made.append(repo) or len(made))[1]
    assert [get("a", 1), get("a", 1), get("a", 2), get("b", 1), get("a", 1), get("c", None), get("c", None)] == [False, True, False, False, False, False, False]
    assert cache.hit_rate == pytest.approx(1 / 7) and lifecycle.ParseCache().hit_rate == 0
    r = lifecycle.Registry("chat")
    r.register("stub", lambda: "x")
    assert r.get("stub") == "x"
    with pytest.raises(KeyError, match="known: stub"):
        r.get("nope")
    stages = lifecycle.Stages()
    with pytest.raises(ZeroDivisionError), stages("analyze"):
        1 / 0
    assert "analyze" in stages.ms


def test_trees_on_disk(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg/__init__.py").write_text("")
    (tmp_path / "pkg/a.py").write_text("x = 1\ny = 2")
    (tmp_path / "pkg/big.py").write_text("#" * (2 * 1024 * 1024 + 1))
    files, skipped = tree.walk(tree.enforce_size(tree.read_tree(spark, str(tmp_path))))
    assert {(r.path, r.module, r.line_count) for r in files.collect()} == {("pkg/__init__.py", "pkg", 0), ("pkg/a.py", "pkg.a", 2)}
    assert {(r.path, r.reason) for r in skipped.collect()} == {("pkg/big.py", "too_large")}
    with pytest.raises(tree.IngestError):
        tree.enforce_size(tree.read_tree(spark, str(tmp_path)), 1)
    (tmp_path / "z").mkdir()
    with zipfile.ZipFile(tmp_path / "z/ok.zip", "w") as z:
        z.writestr("top/m.py", "def f(): pass\n")
    got = tree.read_zips(spark, str(tmp_path / "z/ok.zip")).collect()
    assert [(r.path, bytes(r.content)) for r in got] == [("m.py", b"def f(): pass\n")]
    evil = io.BytesIO()
    with zipfile.ZipFile(evil, "w") as z:
        z.writestr("../out.py", "")
    (tmp_path / "z/evil.zip").write_bytes(evil.getvalue())
    with pytest.raises(Exception, match="unsafe path"):
        tree.read_zips(spark, str(tmp_path / "z/evil.zip")).collect()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.py").write_text("class A:\n    def f(self): pass\n")
    (tmp_path / "b.txt").write_text("x")
    assert cli.main([str(tmp_path), "--symbols", "--json"], spark) == 0
    assert '"qualname":"A.f"' in capsys.readouterr().out
    assert cli.main([str(tmp_path), "--show-skipped"], spark) == 0
    assert "unsupported_extension" in capsys.readouterr().out
    assert cli.main([str(tmp_path / "none")], spark) == 1


def test_search_modes(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "a", 0, "function"), (2, [0.0, 1.0], "b", 0, "class")], "id long, embedding array<double>, symbol_key string, part int, kind string")
    edges = spark.createDataFrame([("a", "b", "CALLS", 1.0)], "src string, dst string, type string, confidence double")
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<double>")
    assert [r.id for r in retrieval.search(vectors, edges, q, 2, kinds=["class"]).collect()] == [2]
    assert {r.source for r in retrieval.search(vectors, edges, q, 2).collect()} == {"vector"}
    with pytest.raises(ValueError):
        retrieval.search(vectors, edges, q, 2, depth=3)


def test_partitions_are_replaced_by_repository(spark, tmp_path):
    at = str(tmp_path / "t")
    sinks.replace_partitions(spark.createDataFrame([("a", 1), ("b", 2)], "repo string, v int"), at)
    sinks.replace_partitions(spark.createDataFrame([("a", 9)], "repo string, v int"), at)
    assert {(r.repo, r.v) for r in sinks.read(spark, at).collect()} == {("a", 9), ("b", 2)}
    assert sinks.as_json(spark.createDataFrame([("a", None)], "repo string, v int")).first().json == '{"repo":"a","v":null}'


def test_extraction_edge_cases():
    got = extract.parse("class A(B[int], metaclass=m()):\n    @d(1)\n    def f(self, a, b=g(), *args, c: int = h(), **kw):\n        return [x for x in a if x if b] or self.z.y()()\n    x = k()\n")
    assert [s["qualname"] for s in got["symbols"]] == ["A", "A.f"] and got["symbols"][1]["complexity"] == 5
    assert [(c["callee"], c["caller"]) for c in got["calls"]] == [("m", None), ("d", None), ("g", None), ("self.z.y", "A.f"), ("self.z.y", "A.f"), ("k", None)]
    assert [(p["name"], p["kind"], p["default"]) for p in got["symbols"][1]["parameters"]] == [("self", "positional_or_keyword", None), ("a", "positional_or_keyword", None), ("b", "positional_or_keyword", "g()"), ("args", "var_positional", None), ("c", "keyword_only", "h()"), ("kw", "var_keyword", None)]
    assert extract.parse(b"\x00")["error"] and extract.parse(None)["error"] and extract.parse("def (")["error"].startswith("SyntaxError")


def two_trees(spark, second="def f():\n    return 1\n"):
    rows = [("one", "a.py", "from b import f\n\n\ndef g():\n    return f()\n"), ("one", "b.py", "def f():\n    return 1\n"), ("two", "a.py", "from b import f\n\n\ndef g():\n    return f()\n"), ("two", "c.py", second)]
    return spark.createDataFrame([(r, p, bytearray(c.encode()), len(c)) for r, p, c in rows], "repo string, path string, content binary, size_bytes long")


def test_repositories_do_not_resolve_into_each_other(spark):
    made = lifecycle.parse_many(two_trees(spark))
    calls = {(r.repo, r.path, r.callee): (r.dst_path, r.reason) for r in made.calls.collect()}
    assert calls == {("one", "a.py", "f"): ("b.py", None), ("two", "a.py", "f"): (None, "unresolved")}
    assert {(r.repo, r.label, r.name) for r in made.nodes.where("label in ('Repo', 'Module')").collect()} == {("one", "Repo", "one"), ("two", "Repo", "two"), ("two", "Module", "b")}
    assert {(r.repo, r.path) for r in made.chunks.where("qualname = 'g'").collect()} == {("one", "a.py"), ("two", "a.py")} and made.chunks.select("id").distinct().count() == made.chunks.count()


def test_files_of_two_repositories_never_change_together(spark):
    commits = spark.createDataFrame([("one", 0, "d", ["a", "b"]), ("one", 1, "c", ["a", "b"]), ("two", 0, "d", ["a", "c"]), ("two", 1, "c", ["b"])], "repo string, ord int, authored_at string, paths array<string>")
    assert [(r.repo, r.left_path, r.right_path, r.shared, r.left_commits) for r in cochange.co_change(commits).collect()] == [("one", "a", "b", 2, 2)]
    assert {(r.repo, r.path): r.change_count for r in cochange.churn(commits).collect()} == {("one", "a"): 2, ("one", "b"): 2, ("two", "a"): 1, ("two", "c"): 1, ("two", "b"): 1}


def test_history_that_fails_is_a_warning(spark):
    broken = spark.range(1).select(F.lit("one").alias("repo"), F.lit(0).alias("ord"), F.lit("d").alias("authored_at"), F.raise_error(F.lit("no log")).cast("array<string>").alias("paths"))
    made = lifecycle.parse_many(two_trees(spark), broken)
    assert made.pairs is None and made.warnings[0].startswith("cochange: ") and made.nodes.count() > 0


def test_graph_is_written_merged_and_swept(spark, tmp_path):
    path = str(tmp_path / "graph")
    first = lifecycle.parse_many(two_trees(spark))
    assert sinks.write_graph(first.nodes, first.edges, path, "1")["swept"] == 0
    sinks.set_properties(first.nodes.where("label = 'File'").select("repo", "key", F.lit(7).alias("change_count")), path)
    again = lifecycle.parse_many(two_trees(spark, "def other():\n    return 1\n").where("repo = 'two'"))
    done = sinks.write_graph(again.nodes, again.edges, path, "2")
    nodes, edges = sinks.read_graph(spark, path)
    assert done["swept"] == 1 and nodes.where("qualname = 'other'").count() == 1 and nodes.where("repo = 'two' and qualname = 'f'").isEmpty()
    assert nodes.where("label = 'File' and change_count = 7").count() == 4 and graph.repeated_keys(nodes).isEmpty()
    assert {(r.repo, r.run_id) for r in edges.select("repo", "run_id").distinct().collect()} == {("one", "1"), ("two", "2")}
    vectors = str(tmp_path / "vectors")
    wrote = sinks.write_vectors(first.chunks, vectors, "hash", "1", 8)
    n = first.chunks.count()
    assert wrote["rows"] == wrote["embedded"] == n
    unchanged = sinks.write_vectors(first.chunks, vectors, "hash", "2", 8)
    assert (unchanged["embedded"], unchanged["swept"], unchanged["cost"]) == (0, 0, 0.0) and sinks.read_vectors(spark, vectors).count() == n
    changed = sinks.write_vectors(again.chunks, vectors, "hash", "3", 8)
    assert changed["rows"] == again.chunks.count() and 0 < changed["embedded"] < changed["rows"]
    assert {(r.repo, r.run_id) for r in sinks.read_vectors(spark, vectors).select("repo", "run_id").distinct().collect()} == {("one", "2"), ("two", "3")}
    assert sinks.write_vectors(again.chunks, vectors, "hash", "4", 16)["embedded"] == changed["rows"]  # another width
    sinks.vacuum(spark, vectors)
    assert sinks.read_vectors(spark, vectors).where("size(embedding) = if(repo = 'one', 8, 16)").count() == sinks.read_vectors(spark, vectors).count() > 0


NODE, EDGE = "repo string, key string, label string", "repo string, src string, dst string"


def small_graph(spark, repo, *keys):
    return spark.createDataFrame([(repo, k, "File") for k in keys], NODE), {"E": spark.createDataFrame([(repo, a, b) for a, b in zip(keys, keys[1:])], EDGE)}


def held(spark, path):
    nodes, edges = sinks.read_graph(spark, path)
    return {(r.repo, r.key, r.run_id) for r in nodes.collect()}, {(r.repo, r.src, r.dst, r.run_id) for r in edges.collect()}


def test_names_of_repositories_stay_strings(spark, tmp_path):
    path = str(tmp_path / "g")
    for run, keys in (("1", "ab"), ("2", "ac")):
        for repo in ("007", "7", "2024-01-01"):
            sinks.write_graph(*small_graph(spark, repo, *keys), path, run)
    nodes, edges = held(spark, path)
    assert nodes == {(r, k, "2") for r in ("007", "7", "2024-01-01") for k in "ac"} and edges == {(r, "a", "c", "2") for r in ("007", "7", "2024-01-01")}
    sinks.delete_repositories(spark.createDataFrame([("7",)], "repo string"), path)
    assert {r for r, *_ in held(spark, path)[0]} == {"007", "2024-01-01"}
    assert sinks.vacuum(spark, path) > 0 and {r for r, *_ in held(spark, path)[0]} == {"007", "2024-01-01"}
    part = str(tmp_path / "p")
    for v in (1, 2):
        sinks.replace_partitions(spark.createDataFrame([("007", v)], "repo string, v int"), part)
    assert [(r.repo, r.v) for r in sinks.read(spark, part, "007").collect()] == [("007", 2)]


@pytest.mark.parametrize("dies_at", [1, 2, 3, 4])
def test_a_run_that_dies_shows_the_one_before(spark, tmp_path, monkeypatch, dies_at):
    path = str(tmp_path / "g")
    sinks.write_graph(*small_graph(spark, "one", "a", "b"), path, "1")
    before, puts, real = held(spark, path), [], sinks._put

    def put(df, at):
        puts.append(at)
        if len(puts) == dies_at:
            raise RuntimeError("killed")
        real(df, at)

    monkeypatch.setattr(sinks, "_put", put)
    if dies_at == 4:  # all is written, and the rename doesn't come
        monkeypatch.setattr(sinks, "_files", lambda s, at, f=sinks._files: (_ for _ in ()).throw(RuntimeError("killed")) if ".new-" in at else f(s, at))
    with pytest.raises(RuntimeError):
        sinks.write_graph(*small_graph(spark, "one", "a", "c", "d"), path, "2")
    monkeypatch.undo()
    assert held(spark, path) == before
    sinks.write_graph(*small_graph(spark, "one", "a", "c", "d"), path, "3")
    assert held(spark, path) == ({("one", k, "3") for k in "acd"}, {("one", "a", "c", "3"), ("one", "c", "d", "3")})


def test_the_later_of_two_writers_fails(spark, tmp_path):
    path = str(tmp_path / "g")
    lines = spark.createDataFrame([("one", "x", "x", None)], sinks.MANIFEST)
    sinks._commit(spark, path, lines, 0)
    with pytest.raises(sinks.ConcurrentWrite):
        sinks._commit(spark, path, lines, 0)


def test_native_embedding_equals_the_plain_one(spark):
    texts = ["", "a", "é😀", "x" * 5000, None]
    for dimensions in (8, 16, 17, 40):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", retrieval.hash_embedding(F.col("t"), dimensions).alias("e")).collect()
        for r in rows:
            assert r.e is None if r.t is None else r.e == pytest.approx(retrieval.hash_vector(r.t, dimensions), abs=1e-12)


def test_clone_folders_and_command_line(spark, tmp_path, capsys):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def f():\n    pass\n")
    (src / "b.txt").write_text("")
    git = lambda *a: subprocess.run(["git", "-C", str(src), "-c", "user.name=n", "-c", "user.email=e@e", *a], check=True, capture_output=True)
    git("init", "-b", "main"), git("add", "."), git("commit", "-m", "x")
    to = tmp_path / "work" / "src"
    tree.clone(f"file://{src}", str(to))
    assert tree.head_of(str(to))["branch"] == "main" and len(tree.head_of(str(to))["sha"]) == 40 and tree.head_of(str(tmp_path / "none")) == {"sha": None, "branch": None}
    (to / "a.py").chmod(0o400)
    with pytest.raises(tree.IngestError, match="not empty"):
        tree.clone(f"file://{src}", str(to))
    tree.clone(f"file://{src}", str(to), force=True)
    assert cli.main([str(to), "--json", "--symbols"], spark) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["file_count"] == 1 and found["files"][0]["path"] == "a.py" and found["symbols"][0]["qualname"] == "f" and found["skipped_by_reason"]["unsupported_extension"] == 1
    assert cli.main([str(to), "--limit", "0"], spark) == 0 and "a.py" in capsys.readouterr().out
    assert cli.main([str(tmp_path / "absent")], spark) == 1


def test_sources_are_spread_and_copies_share_one_parse(spark):
    rows = [("r", f"{k}.py", f"m{k}", code.encode()) for k, code in enumerate(["def f():\n    g()\n", "def (", "", "def f():\n    g()\n", "import a\n"])] + [("r", "gone.py", "gone", None)]
    files = spark.createDataFrame(rows, "repo string, path string, module string, content binary").coalesce(1)
    out = extract.extract(files)
    assert out.rdd.getNumPartitions() == tree.tasks(spark) > 1
    got = {r.path: r for r in out.collect()}
    for _, path, module, content in rows:
        alone = extract.parse(content, path)
        assert got[path].module == module and got[path].error == alone["error"]
        assert [s.qualname for s in got[path].symbols] == [s["qualname"] for s in alone["symbols"]]
        assert [c.callee for c in got[path].calls] == [c["callee"] for c in alone["calls"]] and len(got[path].imports) == len(alone["imports"])


def test_written_sources_are_never_broadcast(spark):
    code = b"class A:\n    def f(self):\n        return self.f()\n"
    source = spark.createDataFrame([("r", f"p{k}.py", code, len(code)) for k in range(3)], "repo string, path string, content binary, size_bytes long")
    made = lifecycle.parse_many(source)
    plan = made.calls.join(made.symbols, ["repo", "path"]).groupBy("repo").count().join(made.bases, "repo")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {(r.path, r.dst_qualname, r.resolution) for r in made.calls.collect()} == {(f"p{k}.py", "A.f", "attribute_self") for k in range(3)}


def test_found_cycles_are_made_once(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("c", "d")], "src string, dst string")
    found = graph_cycles.cycles(df)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # minimal_cycles() reads it three times
    assert sorted((r.files, r.hops) for r in found.collect()) == [(["a", "b"], 2), (["a", "b", "c"], 3)]


def test_texts_that_have_their_vector_are_not_written_again(spark, tmp_path, monkeypatch):
    kept = []

    class Watched(sinks.Written):
        def __call__(self, df):
            kept.append(super().__call__(df))
            return kept[-1]

    monkeypatch.setattr(sinks, "Written", Watched)
    rows = [("r", str(i), f"text {i}", 1) for i in range(20)] + [("r", "3", "text 3", 1), ("r", "n", None, 1)]
    write = lambda rows, k: sinks.write_vectors(spark.createDataFrame(rows, "repo string, id string, text string, tokens long"), str(tmp_path), "hash", k, 4)
    assert write(rows, "1")["embedded"] == 22
    kept.clear()
    done = write([*rows[1:20], rows[20], ("r", "new", "text new", 1)], "2")
    assert (done["rows"], done["embedded"], done["swept"]) == (21, 1, 2)
    texts = [r.text for df in kept if "text" in df.columns for r in df.collect() if r.text is not None]
    assert texts == ["text new"]
