"""Debt, listing, conversation, chunking, retrieval, limits and validation queries, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestar.functions.text import classify_source, derive_name, git_url_problem, human_size, url_host
from lodestar.operators import chunking, conversation, debt, ivf, listing, retrieval
from lodestar.plans import lifecycle
from lodestar.plans import projections as p
from lodestar.plans.written import shared_dir
from lodestar.sources import sinks
from lodestar.streaming import token_bucket

LINE_FLOOR, SYMBOL_FLOOR = 400, 20


def _shown(findings):
    return findings.select("kind", "severity", "subject", "path", "line_start", "key", "why", "confidence")


def _complexity(spark, sf_dir):
    return debt.detect_complexity(p.symbols(spark, sf_dir))


def _docstrings(spark, sf_dir):
    return debt.detect_missing_docstrings(p.symbols(spark, sf_dir))


def _god_files(spark, sf_dir):
    return debt.detect_god_files(p.document_files(spark, sf_dir), p.symbols(spark, sf_dir), LINE_FLOOR, SYMBOL_FLOOR)


def _all(spark, sf_dir):
    return _complexity(spark, sf_dir).unionByName(_docstrings(spark, sf_dir)).unionByName(_god_files(spark, sf_dir))


def debt_complexity(spark, sf_dir):
    return _shown(_complexity(spark, sf_dir))


def debt_god_files(spark, sf_dir):
    return _shown(_god_files(spark, sf_dir))


def debt_missing_docstring(spark, sf_dir):
    return _shown(_docstrings(spark, sf_dir))


def debt_rollup(spark, sf_dir):
    return debt.rollup_by_file(_all(spark, sf_dir))


def debt_tally(spark, sf_dir):
    return debt.tally(_all(spark, sf_dir), "severity").select("name", "n").union(debt.tally(_all(spark, sf_dir)))


def debt_filtered(spark, sf_dir):
    return _shown(debt.filter_findings(_all(spark, sf_dir), ["complexity", "missing_docstring"], "low", 0.5))


def debt_summary(spark, sf_dir):
    found = _all(spark, sf_dir)
    return debt.summary(found, debt.filter_findings(found, None, "medium"))


def import_cycles_minimal(spark, sf_dir):
    return debt.minimal_cycles(debt.cycles(p.module_imports(spark, sf_dir))).select(F.array_join("files", ">").alias("files"), "hops")


def circular_imports(spark, sf_dir):
    return _shown(debt.detect_circular_imports(p.module_imports(spark, sf_dir), limit=None))


def dead_code(spark, sf_dir):
    """Parts that no returned line leads to; names of some are private, entry points or decorated."""
    part = p.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    nodes = part.select(
        F.concat(F.lit("p"), k.cast("string")).alias("key"), F.lit("Function").alias("label"), F.when(k % 7 == 0, F.concat(F.lit("_p"), k.cast("string"))).when(k % 11 == 0, "main").otherwise(F.concat(F.lit("p"), k.cast("string"))).alias("name"),
        F.lit(False).alias("is_external"), F.col("p_brand").alias("module"), F.concat("p_brand", F.lit("."), k.cast("string")).alias("qualname"), F.lit("function").alias("kind"), F.lit(1).alias("line_start"), F.col("p_size").alias("line_end"),
    )
    symbols = part.select(F.col("p_brand").alias("module"), F.concat("p_brand", F.lit("."), k.cast("string")).alias("qualname"), F.when(k % 5 == 0, F.array(F.lit("app.route('/x')"))).when(k % 3 == 0, F.array(F.lit("cached"))).otherwise(F.array().cast("array<string>")).alias("decorators"), F.when(k % 13 == 0, "tests/test_x.py").otherwise("src/x.py").alias("path"), F.lit(1).alias("line_start"))
    none = p.call_edges(spark, sf_dir).where("false")
    left = debt.dead_code_candidates(nodes, p.call_edges(spark, sf_dir), none, None)
    return _shown(debt.dead_code_verdict(debt.enrich(left, symbols)))


# --- lists ----------------------------------------------------------------------------------------------------


def files_page(spark, sf_dir):
    return listing.with_total(p.document_files(spark, sf_dir), listing.page(listing.list_files(p.document_files(spark, sf_dir), "_c1"), 5, 2)).select("path", "line_count", "total")


def files_filtered(spark, sf_dir):
    """Paths that hold a literal, in any case."""
    return listing.client_filter(p.document_files(spark, sf_dir), "C1").select("path", "line_count")


def symbols_page(spark, sf_dir):
    return listing.page(listing.list_symbols(p.symbols(spark, sf_dir), "d1", "function"), 50, 10).select("module", "qualname", "line_end")


def jobs_latest(spark, sf_dir):
    return listing.latest_job(p.jobs(spark, sf_dir))


def jobs_page(spark, sf_dir):
    return listing.page(listing.list_jobs(p.jobs(spark, sf_dir)), 100, 50).select("id", "repo", "started_at", "status")


def _conversations(spark, sf_dir):
    return p.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("turn") < 0).alias("never")).select("conv_id", (-F.col("conv_id")).alias("created_at"))


def conversations_page(spark, sf_dir):
    messages = p.table(spark, sf_dir, "conversations").where("role <> 'system'")
    return conversation.conversation_list(_conversations(spark, sf_dir), messages)


def conversation_detail(spark, sf_dir):
    return conversation.conversation_detail(p.table(spark, sf_dir, "conversations"), 1).select("conv_id", "turn", "role", "text")


def history_last8(spark, sf_dir):
    return conversation.history(p.table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "text")


def conversation_title(spark, sf_dir):
    return conversation.titles(p.table(spark, sf_dir, "conversations"))


def stub_chat(spark, sf_dir):
    return conversation.stub_chat(p.table(spark, sf_dir, "conversations")).select("conv_id", "answer")


def repository_deleted(spark, sf_dir):
    left = listing.delete_repository({"jobs": p.jobs(spark, sf_dir)}, "1")["jobs"]
    return left.groupBy("repo").agg(F.count("*").alias("n"))


# --- chunks ---------------------------------------------------------------------------------------------------


def _lined(spark, sf_dir):
    docs = p.table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.col("source").alias("module"), F.split("text", "\n").alias("lines"))


def chunk_windows(spark, sf_dir):
    d = _lined(spark, sf_dir).withColumn("w", F.explode(chunking.windows(F.lit(1), F.size("lines"), F.length(F.array_join("lines", "\n")))))
    return d.select("path", "w.part", "w.part_count", "w.line_start", "w.line_end")


def chunk_hash(spark, sf_dir):
    d = _lined(spark, sf_dir).withColumn("w", F.explode(chunking.windows(F.lit(1), F.size("lines"), F.length(F.array_join("lines", "\n")))))
    body = chunking.slice_lines(F.col("lines"), F.col("w.line_start"), F.col("w.line_end"))
    return d.select("path", "w.part", F.sha2(body, 256).alias("sha256"), chunking.estimated_tokens(body).alias("tokens"))


def module_leftover(spark, sf_dir):
    files = _lined(spark, sf_dir)
    covered = files.select("path", F.lit(2).alias("line_start"), (F.floor(F.size("lines") / 2) + 1).cast("int").alias("line_end"))
    return chunking.leftover(files, covered).select("path", "line_start", "line_end", F.sha2("text", 256).alias("sha256"))


def chunk_uuid5(spark, sf_dir):
    chunks = chunking.chunk(p.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.col("source").alias("module"), "text"), _no_symbols(spark), "repo")
    return chunks.select("path", "id", "part", "tokens")


def _no_symbols(spark):
    return spark.createDataFrame([], "path string, module string, qualname string, name string, kind string, parent string, line_start int, line_end int, is_async boolean, parameters array<struct<name:string>>, base_classes array<string>")


# --- vectors --------------------------------------------------------------------------------------------------


def vector_topk(spark, sf_dir):
    return retrieval.top_k(p.vectors(spark, sf_dir), p.first_vector(spark, sf_dir), 10).select("id", F.round("score", 4).alias("score"))


def vector_topk_kind(spark, sf_dir):
    return retrieval.top_k(p.vectors(spark, sf_dir), p.first_vector(spark, sf_dir), 10, [1, 3]).select("id", "kind", F.round("score", 4).alias("score"))


def search_kinds(spark, sf_dir):
    """A search that a filter on kinds forces into vector mode."""
    found = retrieval.search(p.vectors(spark, sf_dir), p.call_edges(spark, sf_dir), p.first_vector(spark, sf_dir), 12, "hybrid", 1, [1, 3])
    return found.select("id", "symbol_key", F.round("score", 4).alias("score"), "source")


def vector_knn(spark, sf_dir):
    """The ten nearest vectors of every 50th one, through the inverted file."""
    path = f"{shared_dir(spark)}/ivf-{uuid.uuid4().hex}"
    vectors = p.table(spark, sf_dir, "embeddings")
    ivf.build(vectors, path, id_col="vec_id")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return ivf.nearest(ivf.load(spark, path), asked, 10, exact=True).select("qid", "id", F.round("score", 5).alias("score"))


def hybrid_slots(spark, sf_dir):
    found = retrieval.hybrid(p.vectors(spark, sf_dir), p.call_edges(spark, sf_dir), p.first_vector(spark, sf_dir), 8, 1)
    return found.select("id", "symbol_key", F.round("score", 4).alias("score"), "source", "hops", "seed")


def hash_embedding(spark, sf_dir):
    """Embeddings told by their ends and a weighted sum of all values."""
    e = p.table(spark, sf_dir, "conversations").select("conv_id", "turn", retrieval.hash_embedding(F.col("text"), 64).alias("e"))
    weighed = F.aggregate(F.zip_with("e", F.sequence(F.lit(1), F.lit(64)), lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    return e.select("conv_id", "turn", F.size("e").alias("dimensions"), F.round(retrieval.dot(F.col("e"), F.col("e")), 6).alias("norm"), F.round(F.element_at("e", 1), 6).alias("first"), F.round(F.element_at("e", 64), 6).alias("last"), F.round(weighed, 5).alias("weighed"))


# --- sinks ----------------------------------------------------------------------------------------------------


def _parts(spark, sf_dir):
    """Parts as nodes of repositories named by their size, 001 and on."""
    part = p.table(spark, sf_dir, "part")
    return part.select(F.lpad(F.col("p_size").cast("string"), 3, "0").alias("repo"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), F.lit("Function").alias("label"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))


def graph_sink_runs(spark, sf_dir):
    """Two runs written and read back. The second is about the repositories of small parts, holds the dear ones and their sure calls."""
    path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    nodes, calls = _parts(spark, sf_dir), p.call_edges(spark, sf_dir).select("src", "dst", "type", "confidence")
    inner = lambda nodes: calls.join(nodes.select("repo", F.col("key").alias("src")), "src").join(nodes.select(F.col("repo").alias("r"), F.col("key").alias("dst")), "dst").where("repo = r").drop("r")
    sinks.write_graph(nodes, {"CALLS": inner(nodes)}, path, "1")
    sinks.set_properties(nodes.select("repo", "key", F.length("name").alias("change_count")), path)
    dear = nodes.where("repo < '026' and price >= 1200").drop("price")
    sinks.write_graph(dear, {"CALLS": inner(dear).where("confidence >= 0.9")}, path, "2")
    kept, edges = sinks.read_graph(spark, path)
    counts = kept.groupBy("repo").agg(F.max("run_id").alias("run_id"), F.count("*").alias("nodes"), F.count("price").alias("priced"), F.sum("change_count").alias("changes"))
    return counts.join(edges.groupBy("repo").agg(F.count("*").alias("n")), "repo", "left").select("repo", "run_id", "nodes", "priced", "changes", F.coalesce("n", F.lit(0)).alias("edges"))


def vector_sink_runs(spark, sf_dir):
    """Three runs over documents: all; without the bad ones and with toxic ones rewritten; the same again, which embeds nothing."""
    path = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    labels = p.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = p.table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(F.coalesce("lang", F.lit("")).alias("repo"), F.col("doc_id").cast("string").alias("id"), "text", "quality", "toxic", F.ceil(F.length("text") / 4).alias("tokens"))
    row = ["repo", "id", "text", "tokens"]
    second = docs.where("coalesce(quality, 1) = 1").withColumn("text", F.when(F.col("toxic") == 1, F.concat("text", F.lit(" (cut)"))).otherwise(F.col("text"))).select(*row)
    runs = [sinks.write_vectors(d, path, "hash", str(k), 16) for k, d in enumerate((docs.select(*row), second, second), 1)]
    done = [F.lit(int(r[c])).cast("long").alias(f"{c}_{k}") for c in ("embedded", "swept") for k, r in enumerate(runs, 1)]
    found = sinks.read_vectors(spark, path).groupBy("repo").agg(F.count("*").alias("n"), F.count_if(F.size("embedding") == 16).alias("wide"), F.countDistinct("id").alias("ids"))
    return found.select("repo", "n", "wide", "ids", *done)


# --- limits, times, names -------------------------------------------------------------------------------------


def token_bucket_decisions(spark, sf_dir):
    e = p.table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return token_bucket.check(e, 4, 0.0012).groupBy("client").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))


def token_bucket_stream(spark, sf_dir):
    """The same decisions by a stream over the events, with a state for each client."""
    source = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{source[:-1]}[t]")  # a pattern, so that it may be a file or a folder
    requests = events.select(F.col("user_id").alias("client"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("time"))
    decided = token_bucket.run_stream(requests, 4, 0.0012, f"{shared_dir(spark)}/buckets-{uuid.uuid4().hex}")
    return decided.groupBy("client").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))


def stage_percentages(spark, sf_dir):
    return lifecycle.stage_percentages(p.jobs(spark, sf_dir))


def endpoint_median(spark, sf_dir):
    return lifecycle.endpoint_times(p.jobs(spark, sf_dir))


def url_validation(spark, sf_dir):
    urls = p.table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("https://u:secret@"), F.regexp_replace("url", "^https?://", ""))).when(F.col("page_id") % 7 == 0, F.regexp_replace("url", "//[^/]+", "//10.0.0.1")).when(F.col("page_id") % 11 == 0, F.regexp_replace("url", "^https?", "ftp")).otherwise(F.col("url")).alias("url"))
    return urls.select("page_id", git_url_problem(F.col("url")).alias("problem"), url_host(F.col("url")).alias("host"))


def url_names(spark, sf_dir):
    urls = p.table(spark, sf_dir, "pages")
    return urls.select("page_id", classify_source(F.col("url")).alias("kind"), derive_name(F.col("url"), classify_source(F.col("url"))).alias("name"), human_size(F.octet_length("html")).alias("size"))


QUERIES = {f.__name__: f for f in (
    debt_complexity, debt_god_files, debt_missing_docstring, debt_rollup, debt_tally, debt_filtered, debt_summary, import_cycles_minimal, circular_imports, dead_code, files_page, files_filtered, symbols_page, jobs_latest, jobs_page,
    conversations_page, conversation_detail, history_last8, conversation_title, stub_chat, repository_deleted, chunk_windows, chunk_hash, module_leftover, chunk_uuid5, vector_topk, vector_topk_kind, search_kinds, vector_knn, hybrid_slots, hash_embedding, graph_sink_runs, vector_sink_runs,
    token_bucket_decisions, token_bucket_stream, stage_percentages, endpoint_median, url_validation, url_names,
)}


def _rank(value: str, rows: str) -> str:
    """SQL: the nearest-rank 90th percentile, half to even."""
    return f"(select coalesce(list_sort(list({value}))[cast(greatest(0, least(count(*) - 1, round_even(0.9::double * (count(*) - 1), 0))) as bigint) + 1], 0)::double from {rows})"


_RATIO = "case when {r} >= 3 then 'high' when {r} >= 2 then 'medium' when {r} >= 1 then 'low' else 'info' end"
_COMPLEXITY = f""", ct as (select greatest(10.0::double, {_rank('complexity', 'symbols')}) as threshold), cx as (
  select 'complexity' as kind, {_RATIO.format(r='complexity / threshold')} as severity, qualname as subject, path, line_start, key,
    complexity || ' independent paths through ' || (line_end - line_start + 1) || ' lines — the repository''s 90th percentile is ' || printf('%.0f', threshold) as why, 1.0::double as confidence from symbols, ct where complexity >= threshold)"""
_DOCS = """, md as (select 'missing_docstring' as kind, case when line_end >= 15 or complexity >= 5 then 'low' else 'info' end as severity, qualname as subject, path, line_start, key,
    'public function, ' || line_end || ' lines, complexity ' || complexity || ', no docstring' as why, 1.0::double as confidence from symbols where not has_doc)"""
_GOD = f""", fl as (select path, sum(line_end)::bigint as line_count, count(*) as symbols from symbols group by path),
  gt as (select greatest({LINE_FLOOR}.0::double, {_rank('line_count', 'fl')}) as lt, greatest({SYMBOL_FLOOR}.0::double, {_rank('symbols', 'fl')}) as st), gf as (
  select 'god_file' as kind, {_RATIO.format(r='greatest(line_count / lt, symbols / st)')} as severity, path as subject, path, 1 as line_start, 'file:' || path as key,
    line_count || ' lines holding ' || symbols || ' symbols — past this repository''s 90th percentile of ' || printf('%.0f', lt) || ' lines and ' || printf('%.0f', st) || ' symbols' as why, 1.0::double as confidence
  from fl, gt where line_count >= lt and symbols >= st)"""
_ALL = "with " + p.SQL_SYMBOLS + _COMPLEXITY + _DOCS + _GOD + ", every as (select * from cx union all select * from md union all select * from gf), ranked as (select *, case severity when 'high' then 0 when 'medium' then 1 when 'low' then 2 else 3 end as rank from every)"
_COLS = "kind, severity, subject, path, line_start, key, why, confidence"
_LINES = "lined as (select 'd' || doc_id as path, source as module, string_split(text, chr(10)) as lines, length(text) as chars from documents)"
_WINDOWS = (
    "with " + _LINES + """, measured as (select *, len(lines) as n, greatest(16, 4000 // greatest(1, chars // greatest(len(lines), 1))) as per from lined),
counted as (select *, case when chars <= 4000 or n <= per then 1 else cast(ceil((n - 8)::double / (per - 8)) as bigint) end as part_count from measured),
cut as (select path, lines, n, per, part_count, unnest(range(0, part_count)) as part from counted),
w as (select path, lines, part, part_count, case when part_count = 1 then 1 else 1 + part * (per - 8) end as line_start, case when part_count = 1 then n else least(n, part * (per - 8) + per) end as line_end from cut)"""
)
_URLS = """urls as (select page_id, case when page_id % 5 = 0 then 'https://u:secret@' || regexp_replace(url, '^https?://', '') when page_id % 7 = 0 then regexp_replace(url, '//[^/]+', '//10.0.0.1')
  when page_id % 11 = 0 then regexp_replace(url, '^https?', 'ftp') else url end as url from pages)"""

ORACLE_SQL = {
    "search_kinds": """with q as (select arg_min(embedding, vec_id)::double[] as q from embeddings), s as (select vec_id as id, 'p' || (vec_id + 1) as symbol_key, list_cosine_similarity(embedding::double[], q) as score from embeddings, q where label in (1, 3))
      select id, symbol_key, round(score, 4) as score, 'vector' as source from s order by round(s.score, 9) desc, id limit 12""",
    "vector_knn": """with v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null), s as (select q.vec_id as qid, v.vec_id as id, list_cosine_similarity(q.e, v.e) as score from v q, v where q.vec_id % 50 = 0),
      r as (select *, row_number() over (partition by qid order by round(score, 9) desc, id) as nth from s) select qid, id, round(score, 5) as score from r where nth <= 10""",
    "chunk_uuid5": """with l as (select 'd' || doc_id as path, source as module, string_split(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n$', ''), chr(10)) as lines from documents),
      n as (select path, module, i, lines[i] as t from (select *, unnest(range(1, len(lines) + 1)) as i from l) where trim(lines[i]) <> ''),
      c as (select path, min(i) as line_start, 'File: ' || path || chr(10) || case when any_value(module) <> '' then 'Module: ' || any_value(module) || chr(10) else '' end || 'module-level code' || chr(10) || chr(10) || left(string_agg(t, chr(10) order by i), 4000) as body from n group by path),
      h as (select *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('repo|' || path || '||' || line_start || '|0')) as h from c where length(trim(body)) >= 24)
      select path, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substring('89ab89ab89ab89ab', strpos('0123456789abcdef', h[17]), 1) || h[18:20] || '-' || h[21:32] as id, 0::int as part, greatest(1, length(body) // 4)::int as tokens from h""",
    "hybrid_slots": "with " + p.SQL_CALLS + """, q as (select arg_min(embedding, vec_id)::double[] as q from embeddings),
      s as (select vec_id as id, 'p' || (vec_id + 1) as symbol_key, list_cosine_similarity(embedding::double[], q) as score from embeddings, q), hits as (select * from s order by round(score, 9) desc, id limit 10),
      seeds as (select distinct symbol_key from (select * from hits order by round(score, 9) desc, id limit 5)),
      both_ways as (select src, dst, confidence from calls union all select dst, src, confidence from calls),
      near as (select dst as node, src as seed, confidence, row_number() over (partition by dst order by round(-confidence, 9), src) as nth from both_ways where src <> dst and src in (select symbol_key from seeds) and dst not in (select symbol_key from seeds)),
      g as (select id, symbol_key, score * 0.6::double * confidence as score, seed from s join near on node = symbol_key and nth = 1 where symbol_key not in (select symbol_key from hits) order by round(score * 0.6::double * confidence, 9) desc, id limit 3),
      r as (select *, row_number() over (order by round(score, 9) desc, id) as nth from hits)
      select id, symbol_key, round(score, 4) as score, 'vector' as source, null::int as hops, null::varchar as seed from r where nth <= 8 - (select count(*) from g)
      union all select id, symbol_key, round(score, 4), 'graph', 1, seed from g""",
    "hash_embedding": """with h as (select conv_id, turn, list_reduce(list_transform(range(4), lambda k: sha256(encode(text) || unhex(format('{:08x}', k)))), lambda a, b: a || b) as d from conversations),
      v as (select conv_id, turn, list_transform(range(64), lambda i: ('0x' || substring(d, (4 * i + 1)::int, 4))::int / 32768.0::double - 1) as v from h), n as (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from v)
      select conv_id, turn, 64::int as dimensions, round(list_sum(list_transform(v, lambda x: x / n * (x / n))), 6) as norm, round(v[1] / n, 6) as first, round(v[64] / n, 6) as last,
        round(list_sum(list_transform(v, lambda x, i: x / n * i)), 5) as weighed from n""",
    "graph_sink_runs": "with " + p.SQL_CALLS + """, parts as (select lpad(p_size::varchar, 3, '0') as repo, 'p' || p_partkey as key, p_name, p_retailprice as price from part),
      kept as (select *, repo < '026' and exists (select 1 from parts x where x.repo = parts.repo and x.price >= 1200) as second from parts), final as (select * from kept where not second or price >= 1200),
      inner_ as (select a.repo from calls join final a on a.key = src join final b on b.key = dst and a.repo = b.repo where not a.second or confidence >= 0.9),
      e as (select repo, count(*) as n from inner_ group by repo)
      select repo, case when bool_or(second) then '2' else '1' end as run_id, count(*) as nodes, count(price) as priced, sum(length(p_name))::bigint as changes, coalesce(any_value(n), 0) as edges from final left join e using (repo) group by repo""",
    "vector_sink_runs": """with l as (select doc_id, min(quality) as quality, max(toxic) as toxic from labels group by doc_id), d as (select coalesce(lang, '') as repo, coalesce(quality, 1) = 1 as stays, coalesce(toxic, 0) = 1 as toxic from documents left join l using (doc_id)),
      t as (select count(*) as embedded_1, count_if(stays and toxic) as embedded_2, 0::bigint as embedded_3, 0::bigint as swept_1, count_if(not stays) as swept_2, 0::bigint as swept_3 from d)
      select repo, count(*) as n, count(*) as wide, count(*) as ids, any_value(columns(t.*)) from d, t where stays group by repo""",
    "import_cycles_minimal": "with recursive " + p.SQL_CYCLES + " select array_to_string(files, '>') as files, hops::int as hops from minimal",
    "circular_imports": "with recursive " + p.SQL_CYCLES + """, shown as (select *, array_to_string(list_append(files, files[1]), ' -> ') as ring from minimal)
      select 'circular_import' as kind, case when hops = 2 then 'high' else 'medium' end as severity, ring as subject, files[1] as path, 1::int as line_start, files[1] as key, ring || ' closes a ring of ' || hops || ' imports' as why, 1.0::double as confidence from shown""",
    "debt_complexity": "with " + p.SQL_SYMBOLS + _COMPLEXITY + f" select {_COLS} from cx",
    "debt_god_files": "with " + p.SQL_SYMBOLS + _GOD + f" select {_COLS} from gf",
    "debt_missing_docstring": "with " + p.SQL_SYMBOLS + _DOCS + f" select {_COLS} from md",
    "debt_rollup": _ALL + """, per as (select path, kind, count(*) as n, min(rank) as rank from ranked group by path, kind)
      select path, sum(n)::bigint as findings, case min(rank) when 0 then 'high' when 1 then 'medium' when 2 then 'low' else 'info' end as worst, string_agg(kind || ':' || n, ',' order by n desc, kind) as by_kind from per group by path order by min(rank), findings desc, path limit 15""",
    "debt_tally": _ALL + " select severity as name, count(*) as n from every group by 1 union all select kind, count(*) from every group by 1",
    "debt_filtered": _ALL + f" select {_COLS} from ranked where kind in ('complexity', 'missing_docstring') and rank <= 2",
    "debt_summary": _ALL + " select count_if(rank <= 1) as total, count_if(rank = 0) as high, count_if(rank = 1) as medium, 0 as low, 0 as info, count(*) as scanned_total from ranked",
    "dead_code": "with " + p.SQL_CALLS + """, c as (select *, case when p_partkey % 7 = 0 then '_p' || p_partkey when p_partkey % 11 = 0 then 'main' else 'p' || p_partkey end as name, 'p' || p_partkey as key, p_partkey % 3 = 0 as decorated,
        case when p_partkey % 13 = 0 then 'tests/test_x.py' else 'src/x.py' end as path from part where p_partkey % 5 <> 0 and p_partkey % 13 <> 0 and 'p' || p_partkey not in (select dst from calls))
      select 'dead_code' as kind, case when name like '\\_%' escape '\\' then 'medium' else 'low' end as severity, p_brand || '.' || p_partkey as subject, path, 1 as line_start, key,
        case when name like '\\_%' escape '\\' then 'private function of ' || p_size || ' lines that no function calls; calls made while a module loads are not seen'
          when decorated then 'nothing seen to call it, though cached may register it'
          else 'public function of ' || p_size || ' lines without caller or subclass here; others may use it' end as why,
        case when name like '\\_%' escape '\\' then 0.75::double when decorated then 0.5::double else 0.6::double end as confidence from c where name <> 'main'""",
    "files_filtered": "with " + p.SQL_SYMBOLS + " select path, sum(line_end)::bigint as line_count from symbols where contains(lower(path), 'c1') group by path",
    "files_page": "with " + p.SQL_SYMBOLS + ", fl as (select path, sum(line_end)::bigint as line_count from symbols group by path) select path, line_count, (select count(*) from fl) as total from fl where path ilike '%_c1%' order by path limit 5 offset 2",
    "symbols_page": "with " + p.SQL_SYMBOLS + " select module, qualname, line_end from symbols where qualname ilike '%d1%' order by module nulls last, line_start, qualname limit 50 offset 10",
    "jobs_latest": "select user_id as repo, event_id as id, case when event_type = 'error' then 'failed' else 'complete' end as status, ts as started_at from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1",
    "jobs_page": "select event_id as id, user_id as repo, ts as started_at, case when event_type = 'error' then 'failed' else 'complete' end as status from events order by ts desc, event_id limit 100 offset 50",
    "conversations_page": "select conv_id, -conv_id as created_at, count_if(role <> 'system') as messages from conversations group by conv_id",
    "conversation_detail": "select conv_id, turn, role, text from conversations where conv_id = 1 order by turn",
    "history_last8": "select conv_id, turn, role, text from (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations) where n <= 8 and text <> ''",
    "conversation_title": "select conv_id, left(arg_min(text, turn) filter (where role = 'user'), 120) as title from conversations group by conv_id",
    "stub_chat": "select conv_id, 'stub answer to: ' || coalesce(arg_max(text, turn) filter (where role = 'user'), '') || ' ' as answer from conversations group by conv_id",
    "repository_deleted": "select user_id as repo, count(*) as n from events where user_id <> 1 group by user_id",
    "chunk_windows": _WINDOWS + " select path, part, part_count, line_start, line_end from w",
    "chunk_hash": _WINDOWS + ", b as (select path, part, array_to_string(lines[line_start:line_end], chr(10)) as body from w) select path, part, sha256(body) as sha256, greatest(1, length(body) // 4) as tokens from b",
    "module_leftover": "with " + _LINES + """, numbered as (select path, module, lines, unnest(range(1, len(lines) + 1)) as i from lined), free as (select path, module, i, lines[i] as t from numbered where not (i between 2 and len(lines) // 2 + 1) and trim(lines[i]) <> '')
      select path, cast(min(i) as int) as line_start, cast(max(i) as int) as line_end, sha256('File: ' || path || chr(10) || 'Module: ' || any_value(module) || chr(10) || 'module-level code' || chr(10) || chr(10) || left(string_agg(t, chr(10) order by i), 4000)) as sha256 from free group by path""",
    "vector_topk": "with q as (select arg_min(embedding, vec_id)::double[] as q from embeddings) select vec_id as id, round(list_cosine_similarity(embedding::double[], q), 4) as score from embeddings, q order by round(list_cosine_similarity(embedding::double[], q), 9) desc, vec_id limit 10",
    "vector_topk_kind": "with q as (select arg_min(embedding, vec_id)::double[] as q from embeddings) select vec_id as id, label as kind, round(list_cosine_similarity(embedding::double[], q), 4) as score from embeddings, q where label in (1, 3) order by round(list_cosine_similarity(embedding::double[], q), 9) desc, vec_id limit 10",
    "token_bucket_decisions": """with recursive r as (select user_id as client, epoch_us(ts) / 1000000.0::double as sec, row_number() over (partition by user_id order by ts, event_id) as n from events),
      b as (select client, n, sec, 3.0::double as tokens, true as allowed from r where n = 1
        union all select r.client, r.n, r.sec, case when least(4.0::double, b.tokens + greatest(0.0::double, r.sec - b.sec) * (0.0012::double / 60.0::double)) >= 1 then least(4.0::double, b.tokens + greatest(0.0::double, r.sec - b.sec) * (0.0012::double / 60.0::double)) - 1
          else least(4.0::double, b.tokens + greatest(0.0::double, r.sec - b.sec) * (0.0012::double / 60.0::double)) end, least(4.0::double, b.tokens + greatest(0.0::double, r.sec - b.sec) * (0.0012::double / 60.0::double)) >= 1
        from b join r on r.client = b.client and r.n = b.n + 1)
      select cast(client as varchar) as client, count_if(allowed) as allowed, count_if(not allowed) as refused from b group by client""",
    "stage_percentages": "with s as (select event_type as stage, sum(cast(json_extract(props, '$.k') as int))::bigint as ms from events group by 1) select stage, ms, round(100.0::double * ms / (select sum(ms) from s), 1) as percent from s",
    "endpoint_median": "select event_type as endpoint, count(*) as runs, round(median(value), 4) as median_ms, max(value) as worst_ms from events group by 1",
    "url_validation": "with " + _URLS + """ select page_id, case when not regexp_matches(url, '^(https?|ssh|git)://') then 'scheme' when regexp_matches(url, '^[a-z]+://[^/@]*:[^/@]+@') then 'credentials' when regexp_matches(url, '//10[.]0[.]0[.]1(/|$)') then 'private_host' end as problem,
      lower(regexp_extract(regexp_replace(url, '^[a-z]+://([^/@]*@)?', ''), '^[^/:]*', 0)) as host from urls""",
    "url_names": """select page_id, case when regexp_matches(url, '^https?://') then 'git' else 'local' end as kind, nullif(regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '[^/:]*$', 0), '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), '') as name,
      case when strlen(html) < 1024 then strlen(html) || ' B' when strlen(html) < 1048576 then printf('%.1f KB', round(strlen(html) / 1024.0::double, 1)) else printf('%.1f MB', round(strlen(html) / 1048576.0::double, 1)) end as size from pages""",
}
ORACLE_SQL["token_bucket_stream"] = ORACLE_SQL["token_bucket_decisions"]
