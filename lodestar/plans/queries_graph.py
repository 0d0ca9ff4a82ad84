"""Graph, impact, co-change and risk queries over the projections, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import cochange, cochange_counts, graph, impact, resolve, risk
from lodestar.plans import projections as p
from lodestar.plans.written import shared_dir

LITERALS = ["S/TEST_S1", "rc/s2", "AN", "src/s1", "no such node"]
JOINED = lambda c: F.array_join(c, ">").alias(c)


def _items(spark: SparkSession, sf_dir: str, decay: float = impact.DECAY) -> DataFrame:
    return impact.impact(p.call_edges(spark, sf_dir), p.top_callee(spark, sf_dir), 3, decay)


def _shown(items: DataFrame) -> DataFrame:
    return items.select("node", "hops", "confidence", "score", JOINED("route"), JOINED("via"))


def impact_ranked(spark, sf_dir):
    return _shown(_items(spark, sf_dir))


def impact_decay1(spark, sf_dir):
    return _shown(_items(spark, sf_dir, 1.0))


def impact_summary(spark, sf_dir):
    return impact.summarize(_items(spark, sf_dir).withColumn("label", F.lit("Function")))


def impact_routes(spark, sf_dir):
    return graph.route_edges(_items(spark, sf_dir))


def impact_groups(spark, sf_dir):
    member = p.owners(spark, sf_dir).select(F.col("dst").alias("node"), F.col("src").alias("grp"))
    return graph.project_impact(_items(spark, sf_dir), member)


def _roots(spark, sf_dir, n: int) -> DataFrame:
    return p.call_edges(spark, sf_dir).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(n).select("node")


def dependencies_2hop(spark, sf_dir):
    root = p.call_edges(spark, sf_dir).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(1).select("node")
    found = graph.dependencies(p.call_edges(spark, sf_dir), root, 2)
    return found.select("node", "hops", F.round("confidence", 4).alias("confidence"), JOINED("route"), JOINED("via"))


def dependents_2hop(spark, sf_dir):
    found = graph.dependents(p.call_edges(spark, sf_dir), p.top_callee(spark, sf_dir), 2)
    return found.select("node", "hops", F.round("confidence", 4).alias("confidence"), JOINED("route"), JOINED("via"))


def neighbours_seeded(spark, sf_dir):
    found = graph.neighbours(p.call_edges(spark, sf_dir), _roots(spark, sf_dir, 3), 2)
    return found.select("node", "hops", F.round("confidence", 4).alias("confidence"), "seed")


def call_edges_agg(spark, sf_dir):
    return p.call_edges(spark, sf_dir).select("src", "dst", "confidence", "resolution", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"), F.col("count").alias("n_lines"))


def edges_serialised(spark, sf_dir):
    """Calls and imports in one form."""
    return graph.serialise_edges(p.call_edges(spark, sf_dir)).union(graph.serialise_edges(p.import_edges(spark, sf_dir)))


def resolution_counts(spark, sf_dir):
    return graph.count_relationships(p.call_edges(spark, sf_dir))


def class_lookup(spark, sf_dir):
    """Parts as classes whose bases are the parts of half and of a third of their number: in which order self.x looks in them."""
    k = F.col("p_partkey")
    part = p.table(spark, sf_dir, "part").where(k > 0).select(k.alias("k"), F.lit("m.py").alias("path"), F.concat(F.lit("C"), k.cast("string")).alias("qualname"))
    both = part.select("path", "qualname", F.posexplode(F.array_distinct(F.array(F.floor(F.col("k") / 2), F.floor(F.col("k") / 3)))).alias("position", "b")).where("b > 0")
    bases = both.select("path", "qualname", "position", F.col("path").alias("base_path"), F.concat(F.lit("C"), F.col("b").cast("string")).alias("base_qualname"))
    found = resolve.class_lookup_order(bases, part.select("path", "qualname"))
    return found.select("owner", F.col("at_qualname").alias("class"), "rank.level", F.array_join(F.col("rank.rank").cast("array<string>"), ",").alias("positions"))


def unresolved_by_caller(spark, sf_dir):
    """Lines followed by no line of their order are calls that nothing answers."""
    lines = p.table(spark, sf_dir, "lineitem")
    here = lines.select("l_orderkey", (F.col("l_linenumber") + 1).alias("n"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("caller"))
    nxt = lines.select("l_orderkey", F.col("l_linenumber").alias("n"))
    return here.join(nxt, ["l_orderkey", "n"], "left_anti").groupBy("caller").agg(F.count("*").alias("unresolved_calls"))


def _nodes(spark, sf_dir) -> DataFrame:
    none = F.lit(None).cast("string")
    parts = p.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), F.lit("Function").alias("label"), F.col("p_name").alias("name"), F.col("p_name").alias("qualname"), none.alias("path"), none.alias("dotted_name"), F.col("p_brand").alias("module"))
    files = p.supplier_files(spark, sf_dir).select("key", F.lit("File").alias("label"), F.col("path").alias("name"), none.alias("qualname"), "path", none.alias("dotted_name"), none.alias("module"))
    modules = p.table(spark, sf_dir, "nation").select(F.concat(F.lit("mod:"), "n_name").alias("key"), F.lit("Module").alias("label"), none.alias("name"), none.alias("qualname"), none.alias("path"), F.col("n_name").alias("dotted_name"), none.alias("module"))
    return parts.unionByName(files).unionByName(modules)


def node_search(spark, sf_dir):
    return graph.search_nodes(_nodes(spark, sf_dir), "1.", 25).select("key", "label", "shown_length")


def _node_index(spark, sf_dir) -> str:
    path = f"{shared_dir(spark)}/nodes-{uuid.uuid4().hex}"
    graph.index_nodes(_nodes(spark, sf_dir), path)
    return path


def node_search_indexed(spark, sf_dir):
    """Literals looked up in one trigram index: a common one, one that crosses a slash, one of two characters, one that nothing holds."""
    path, out = _node_index(spark, sf_dir), None
    for literal in LITERALS:
        found = graph.search_index(spark, path, literal, 50).select(F.lit(literal).alias("literal"), "key", "label", "shown_length")
        out = found if out is None else out.union(found)
    return out


def node_lookup(spark, sf_dir):
    """One node by its key."""
    return graph.get_node(_nodes(spark, sf_dir), "p1").select("key", "label")


def node_counts(spark, sf_dir):
    return graph.count_nodes(_nodes(spark, sf_dir))


def files_view(spark, sf_dir):
    return graph.files_view(_nodes(spark, sf_dir), p.import_edges(spark, sf_dir))


def calls_view(spark, sf_dir):
    return graph.calls_view(_nodes(spark, sf_dir), p.call_edges(spark, sf_dir))


def collapse_groups(spark, sf_dir):
    _, merged = graph.collapse(_nodes(spark, sf_dir), p.call_edges(spark, sf_dir), F.col("module"), ["Function"])
    return merged


def visible_edges(spark, sf_dir):
    shown = _nodes(spark, sf_dir).where("label = 'Function' and module in ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22')")
    return graph.inside(p.call_edges(spark, sf_dir), shown).select("src", "dst", "confidence")


def graph_upsert_sweep(spark, sf_dir):
    """Two runs: all calls, then the sure ones; what the second upserts, keeps and sweeps."""
    first = p.call_edges(spark, sf_dir).select("src", "dst", "confidence").withColumn("run_id", F.lit("run1"))
    second = first.where("confidence >= 0.9").drop("run_id").withColumn("run_id", F.lit("run2"))
    kept, swept = graph.sweep(graph.upsert(first, second, ["src", "dst"]), "run2", None)
    return kept.agg(F.count("*").alias("kept")).join(F.broadcast(swept.agg(F.count("*").alias("swept"))))


# --- co-change ------------------------------------------------------------------------------------------------


def _pairs(spark, sf_dir):
    """All pairs, mined once a session and version of the orders, as a parse stores them."""
    return p.stored(spark, sf_dir, "pairs", lambda s, d: p.co_changed(s, d, ordered=True), ("lineitem", "orders"))


def cochange_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


def cochange_for_key(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    first = pairs.orderBy(F.desc("shared"), F.desc("jaccard"), "left_path", "right_path").limit(1).select(F.col("left_path").alias("k"))
    near = pairs.join(F.broadcast(first), (F.col("left_path") == F.col("k")) | (F.col("right_path") == F.col("k"))).drop("k")  # one row
    return cochange.coupled(near, None, 2, 100)


def cochange_incremental(spark, sf_dir):
    """The window of the newest 500 orders, mined in three updates of the counts."""
    new = p.commits(spark, sf_dir, "l_suppkey", "s").select((-F.col("ord")).alias("seq"), "authored_at", "paths")
    low, high = new.agg(F.min("seq"), F.max("seq")).first()
    cuts = [] if low is None else [low - 1, low + (high - low) // 2, high - (high - low) // 8, high]
    state = cochange_counts.empty(spark)
    for a, b in zip(cuts, cuts[1:], strict=False):
        state = cochange_counts.update(state, new.where((F.col("seq") > a) & (F.col("seq") <= b)))
    return cochange_counts.co_change(state).drop("repo")


def cochange_window_stats(spark, sf_dir):
    return cochange.window_stats(p.commits(spark, sf_dir))


def partner_index(spark, sf_dir):
    return cochange.partner_index(_pairs(spark, sf_dir))


def churn(spark, sf_dir):
    return cochange.churn(p.commits(spark, sf_dir))


def cochange_edges(spark, sf_dir):
    pairs = p.co_changed(spark, sf_dir, "l_suppkey", "s")
    files = p.supplier_files(spark, sf_dir).select(F.col("key").alias("path"), "key")
    return cochange.co_change_edges(pairs, files)


# --- risk -----------------------------------------------------------------------------------------------------


def _risk(spark, sf_dir, history: bool = True) -> DataFrame:
    edges, commits = p.call_edges(spark, sf_dir), p.commits(spark, sf_dir, "l_suppkey", "s")
    files = p.supplier_files(spark, sf_dir)
    if history:
        counted = cochange.churn(commits).withColumnRenamed("path", "key")
        files = files.join(counted, "key", "left").withColumn("change_count", F.coalesce("change_count", F.lit(0)))
        partners = cochange.partner_index(p.co_changed(spark, sf_dir, "l_suppkey", "s")).select(F.col("path").alias("file"), "jaccard")
    else:
        files = files.withColumn("change_count", F.lit(None).cast("long"))
        partners = spark.createDataFrame([], "file string, jaccard double")
    nodes = edges.select(F.col("src").alias("key")).union(edges.select("dst")).distinct()
    return risk.score(risk.metrics(nodes, edges, p.owners(spark, sf_dir), files, partners))


COUNTED = ["key", "path", "dependents", "direct_dependents", "dependencies", "co_partners", "max_jaccard", "change_count", "test_references"]


def risk_metrics(spark, sf_dir):
    return _risk(spark, sf_dir).select(*COUNTED)


def risk_ranked(spark, sf_dir):
    return risk.rank(_risk(spark, sf_dir)).select("key", "score", "band", F.element_at("reasons", 1).alias("why"))


def risk_no_history(spark, sf_dir):
    return risk.rank(_risk(spark, sf_dir, False)).select("key", "score", "band", F.size("reasons").alias("n_reasons"))


def risk_node(spark, sf_dir):
    """One part scored alone: only what leads to it is walked, and only the pairs of its file are counted."""
    edges, files = p.call_edges(spark, sf_dir), p.supplier_files(spark, sf_dir)
    counted = cochange.churn(p.commits(spark, sf_dir, "l_suppkey", "s")).withColumnRenamed("path", "key")
    files = files.join(counted, "key", "left").withColumn("change_count", F.coalesce("change_count", F.lit(0)))
    mine = risk.owners(p.owners(spark, sf_dir), files).where("node = 'p1'").select(F.col("file").alias("path"))
    partners = cochange.partner_index(p.co_changed(spark, sf_dir, "l_suppkey", "s", of=mine)).select(F.col("path").alias("file"), "jaccard")
    return risk.score_node(_nodes(spark, sf_dir), "p1", edges, p.owners(spark, sf_dir), files, partners).select(*COUNTED, "score", "band")


def impact_texts(spark, sf_dir):
    """Routes as prompts and answers show them."""
    return _items(spark, sf_dir).select("node", impact.route_text(F.col("route")).alias("text"))


def risk_bands(spark, sf_dir):
    return risk.risk_colours(_nodes(spark, sf_dir).where("label = 'Function'"), _risk(spark, sf_dir)).groupBy("band").agg(F.count("*").alias("n"))


def risk_dashboard(spark, sf_dir):
    return risk.dashboard(_risk(spark, sf_dir))


def risk_bar_widths(spark, sf_dir):
    return risk.bar_widths(_risk(spark, sf_dir, False))


QUERIES = {f.__name__: f for f in (
    impact_ranked, impact_decay1, impact_summary, impact_routes, impact_groups, dependencies_2hop, dependents_2hop, neighbours_seeded, call_edges_agg, edges_serialised, resolution_counts, class_lookup, unresolved_by_caller, node_search, node_search_indexed, node_lookup, node_counts,
    files_view, calls_view, collapse_groups, visible_edges, graph_upsert_sweep, cochange_pairs, cochange_for_key, cochange_incremental, cochange_window_stats, partner_index, churn, cochange_edges,
    risk_metrics, risk_node, impact_texts, risk_ranked, risk_no_history, risk_bands, risk_dashboard, risk_bar_widths,
)}
QUERIES["impact"] = QUERIES["impact_ranked"]


def _paths(start: str, depth: int, forward: bool, edges: str = "calls") -> str:
    """SQL: all walks of up to depth edges from the rows of `start`, never back to their start."""
    near, far = ("src", "dst") if forward else ("dst", "src")
    via = "list_append(w.via, e.type)" if forward else "list_prepend(e.type, w.via)"
    return f""", walks as (
  select node as root, node, 0 as hops, 1.0::double as confidence, [node] as route, []::varchar[] as via from {start}
  union all
  select w.root, e.{far}, w.hops + 1, w.confidence * e.confidence, list_append(w.route, e.{far}), {via}
  from walks w join {edges} e on e.{near} = w.node where w.hops < {depth} and e.src <> e.dst and e.{far} not in (select node from {start}))"""


def _best(order: str, columns: str) -> str:
    return f"select {columns} from (select *, row_number() over (partition by node order by {order}) as rn from scored where hops > 0) where rn = 1"


def _impact_sql(decay: float) -> str:
    return (
        "with recursive " + p.SQL_CALLS + p.SQL_ROOT + _paths("root", 3, False) + f", scored as (select *, confidence * pow({decay}::double, hops - 1) as score from walks), items as ("
        + _best("round(-score, 9), hops, route, via", "node, hops, round(confidence, 4) as confidence, round(score, 4) as score, route, via") + ")"
    )


_SHOWN = " select node, hops, confidence, score, array_to_string(route, '>') as route, array_to_string(via, '>') as via from items"
_NEAR = "round(confidence, 4) as confidence, array_to_string(route, '>') as route, array_to_string(via, '>') as via"
_BOTH = ", both_ways as (select src, dst, type, confidence from calls union all select dst, src, type, confidence from calls)"
_NODES = """nodes as (
  select 'p' || p_partkey as key, 'Function' as label, p_name as name, p_name as qualname, null::varchar as path, null::varchar as dotted_name, p_brand as module from part
  union all select 's' || lpad(cast(s_suppkey as varchar), 8, '0'), 'File', {path}, null, {path}, null, null from supplier
  union all select 'mod:' || n_name, 'Module', null, null, null, n_name, null from nation)""".replace("{path}", "case when s_suppkey % 10 = 0 then 'tests/test_s' || s_suppkey || '.py' else 'src/s' || s_suppkey || '.py' end")


def _cochange(column: str = "l_partkey", prefix: str = "p") -> str:
    return (
        p.sql_commits(column, prefix) + """, sizes as (select ord, count(*) as n from commit_rows group by ord), used as (select c.* from commit_rows c join sizes s on c.ord = s.ord where s.n <= 40),
per_file as (select path, count(*) as n from used group by path),
shared as (select a.path as left_path, b.path as right_path, count(*) as shared, arg_min(a.authored_at, a.ord) as last_together from used a join used b on a.ord = b.ord and a.path < b.path group by 1, 2 having count(*) >= 2),
pairs as (select left_path, right_path, shared, l.n as left_commits, r.n as right_commits, round(shared::double / (l.n + r.n - shared), 4) as jaccard, last_together
  from shared join per_file l on l.path = left_path join per_file r on r.path = right_path)"""
    )


_SIDES = ", sides as (select left_path as path, right_path as partner, shared, jaccard from pairs union all select right_path, left_path, shared, jaccard from pairs)"


def _risk_sql(history: bool) -> str:
    files = """files as (select 's' || lpad(cast(s_suppkey as varchar), 8, '0') as key, case when s_suppkey % 10 = 0 then 'tests/test_s' || s_suppkey || '.py' else 'src/s' || s_suppkey || '.py' end as path, s_suppkey from supplier)"""
    changes = "coalesce(pf.n, 0)" if history else "null::bigint"
    partners = "(select path, count(*) as n, max(jaccard) as j from sides group by path)" if history else "(select null::varchar as path, 0 as n, 0.0::double as j where false)"
    w = {"blast": 0.35, "coverage": 0.2, "centrality": 0.2, "coupling": 0.15, "churn": 0.1} if history else {"blast": 0.35 / 0.75, "coverage": 0.2 / 0.75, "centrality": 0.2 / 0.75, "coupling": 0.0, "churn": 0.0}
    sat = lambda x, k: f"case when {x} <= 0 then 0.0::double else {x} / ({x} + {k}::double) end"
    return (
        "with " + p.SQL_CALLS + ", " + _cochange("l_suppkey", "s") + _SIDES + ", " + files + f""", owner as (select 'p' || l_partkey as node, 's' || lpad(cast(min(l_suppkey) as varchar), 8, '0') as file from lineitem group by l_partkey),
step as (select distinct src, dst from calls where src <> dst), reach as (select src, dst from step union select a.src, b.dst from step a join step b on a.dst = b.src where a.src <> b.dst),
nodes as (select src as key from calls union select dst from calls),
counted as (select n.key, f.path, coalesce(d.n, 0) as dependents, coalesce(i.n, 0) as direct_dependents, coalesce(o.n, 0) as dependencies, coalesce(pa.n, 0) as co_partners, coalesce(pa.j, 0.0::double) as max_jaccard,
    {changes} as change_count, coalesce(t.n, 0) as test_references
  from nodes n left join owner ow on ow.node = n.key left join files f on f.key = ow.file
  left join (select dst, count(*) as n from reach group by dst) d on d.dst = n.key left join (select dst, count(*) as n from step group by dst) i on i.dst = n.key
  left join (select src, count(*) as n from step group by src) o on o.src = n.key left join per_file pf on pf.path = ow.file left join {partners} pa on pa.path = ow.file
  left join (select dst, count(distinct src) as n from calls join owner on owner.node = src join files on files.key = owner.file where files.s_suppkey % 10 = 0 group by dst) t on t.dst = n.key),
scored as (select *, round(100.0::double * (0.0::double + ({sat('dependents', 8)}) * {w['blast']}::double + (1.0::double - ({sat('test_references', 2)})) * {w['coverage']}::double + ({sat('(direct_dependents + dependencies)', 6)}) * {w['centrality']}::double
    + (0.6::double * ({sat('co_partners', 3)}) + 0.4::double * least(max_jaccard, 1.0::double)) * {w['coupling']}::double + ({sat('coalesce(change_count, 0)', 10)}) * {w['churn']}::double), 1) as score from counted),
banded as (select *, case when score < 25 then 'low' when score < 50 then 'moderate' when score < 75 then 'high' else 'critical' end as band from scored)"""
    )


ORACLE_SQL = {
    "impact": _impact_sql(0.6) + _SHOWN,
    "impact_ranked": _impact_sql(0.6) + _SHOWN,
    "impact_decay1": _impact_sql(1.0) + _SHOWN,
    "impact_summary": _impact_sql(0.6) + """ select count(*) as total, count_if(hops = 1) as direct, coalesce(max(hops), 0) as max_hops, coalesce(max(score), 0.0) as top_score,
      (select string_agg(hops || ':' || n, ',' order by hops) from (select hops, count(*) as n from items group by hops)) as by_hop, 'Function:' || count(*) as by_type from items""",
    "impact_routes": _impact_sql(0.6) + " select distinct route[i] as src, route[i + 1] as dst from (select route, unnest(range(1, len(route))) as i from items)",
    "impact_groups": _impact_sql(0.6) + """, owner as (select 'p' || l_partkey as node, 's' || lpad(cast(min(l_suppkey) as varchar), 8, '0') as grp from lineitem group by l_partkey)
      select grp, min(hops) as hops from items join owner using (node) group by grp""",
    "dependencies_2hop": "with recursive " + p.SQL_CALLS + ", root as (select src as node from calls group by src order by count(*) desc, src limit 1)" + _paths("root", 2, True) + ", scored as (select * from walks) " + _best("hops, round(-confidence, 9), route, via", "node, hops, " + _NEAR),
    "dependents_2hop": "with recursive " + p.SQL_CALLS + p.SQL_ROOT + _paths("root", 2, False) + ", scored as (select * from walks) " + _best("hops, round(-confidence, 9), route, via", "node, hops, " + _NEAR),
    "neighbours_seeded": "with recursive " + p.SQL_CALLS + ", seeds as (select dst as node from calls group by dst order by count(*) desc, dst limit 3)" + _BOTH + _paths("seeds", 2, True, "both_ways") + ", scored as (select * from walks) " + _best("hops, round(-confidence, 9), route, via", "node, hops, round(confidence, 4) as confidence, route[1] as seed"),
    "call_edges_agg": "with " + p.SQL_CALLS + " select src, dst, confidence, resolution, array_to_string(lines, ',') as lines, len(lines) as n_lines from calls",
    "edges_serialised": "with " + p.SQL_CALLS + p.SQL_IMPORT_ROWS + """
      select type, src as source, dst as target, resolution, confidence, len(lines)::bigint as count, null::int as line from calls union all select type, src, dst, null, confidence, null, null from imports""",
    "resolution_counts": "with " + p.SQL_CALLS + " select type, resolution, count(*) as n from calls group by type, resolution",
    "class_lookup": """with recursive c as (select p_partkey as k from part where p_partkey > 0), e as (select k, 0 as position, k // 2 as b from c where k // 2 > 0 union all select k, 1, k // 3 from c where k // 3 > 0 and k // 3 <> k // 2),
      w as (select k as owner, k as place, 0 as level, []::int[] as rank from c union all select owner, b, level + 1, list_append(rank, position) from w join e on e.k = w.place),
      r as (select *, row_number() over (partition by owner, place order by level, rank) as nth from w)
      select 'C' || owner as owner, 'C' || place as class, level::int as level, array_to_string(rank, ',') as positions from r where nth = 1""",
    "unresolved_by_caller": "select 'p' || a.l_partkey as caller, count(*) as unresolved_calls from lineitem a where not exists (select 1 from lineitem b where b.l_orderkey = a.l_orderkey and b.l_linenumber = a.l_linenumber + 1) group by 1",
    "node_search": "with " + _NODES + """ select key, label, length(coalesce(qualname, path, name, '')) as shown_length from nodes
      where contains(lower(coalesce(qualname, '')), '1.') or contains(lower(coalesce(path, '')), '1.') or contains(lower(coalesce(name, '')), '1.') or contains(lower(coalesce(dotted_name, '')), '1.') order by shown_length, key limit 25""",
    "node_search_indexed": "with " + _NODES + """, q as (select unnest(""" + str(LITERALS) + """) as literal),
      hits as (select literal, key, label, length(coalesce(qualname, path, name, '')) as shown_length from nodes, q where contains(lower(coalesce(qualname, '')), lower(literal)) or contains(lower(coalesce(path, '')), lower(literal)) or contains(lower(coalesce(name, '')), lower(literal)) or contains(lower(coalesce(dotted_name, '')), lower(literal)))
      select literal, key, label, shown_length from (select *, row_number() over (partition by literal order by shown_length, key) as nth from hits) where nth <= 50""",
    "node_lookup": "with " + _NODES + " select key, label from nodes where key = 'p1'",
    "node_counts": "with " + _NODES + " select label, count(*) as n from nodes group by label",
    "files_view": "with " + _NODES + ", " + p.SQL_IMPORTS + " select key as src, dst, confidence from nodes left join imports on src = key where label = 'File'",
    "calls_view": "with " + _NODES + ", " + p.SQL_CALLS + " select src, dst, confidence from calls where src in (select key from nodes where label = 'Function')",
    "collapse_groups": "with " + _NODES + ", " + p.SQL_CALLS + " select a.module as src_group, b.module as dst_group, type, count(*) as merged from calls join nodes a on a.key = src and a.label = 'Function' join nodes b on b.key = dst and b.label = 'Function' where a.module <> b.module group by 1, 2, 3",
    "visible_edges": "with " + _NODES + ", shown as (select key from nodes where label = 'Function' and module in ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22')), " + p.SQL_CALLS + " select src, dst, confidence from calls where src in (select key from shown) and dst in (select key from shown)",
    "graph_upsert_sweep": "with " + p.SQL_CALLS + " select count_if(confidence >= 0.9) as kept, count_if(confidence < 0.9) as swept from calls",
    "cochange_pairs": "with " + _cochange() + " select * from pairs",
    "cochange_for_key": "with " + _cochange() + ", k as (select left_path as k from pairs order by shared desc, jaccard desc, left_path, right_path limit 1) select pairs.* from pairs, k where left_path = k or right_path = k order by shared desc, jaccard desc, left_path, right_path limit 100",
    "cochange_incremental": "with " + _cochange("l_suppkey", "s").replace("from commit_rows group by ord", "from commit_rows where ord in (select distinct ord from commit_rows order by ord limit 500) group by ord", 1) + " select * from pairs",
    "cochange_window_stats": "with " + _cochange() + """ select (select count(distinct o_orderkey) from orders where o_orderkey in (select l_orderkey from lineitem)) as commits_read, (select arg_max(authored_at, ord) from commit_rows) as first_date,
      (select arg_min(authored_at, ord) from commit_rows) as last_date, count_if(n <= 40) as commits_used, count_if(n > 40) as commits_skipped from sizes""",
    "partner_index": "with " + _cochange() + _SIDES + " select * from sides",
    "churn": "with " + _cochange() + " select path, n as change_count from per_file",
    "cochange_edges": "with " + _cochange("l_suppkey", "s") + " select left_path as src, right_path as dst, 'CO_CHANGED' as type, shared as commits, jaccard, left_commits, right_commits, last_together from pairs",
    "risk_metrics": _risk_sql(True) + " select key, path, dependents, direct_dependents, dependencies, co_partners, max_jaccard, change_count, test_references from counted",
    "risk_node": _risk_sql(True) + " select key, path, dependents, direct_dependents, dependencies, co_partners, max_jaccard, change_count, test_references, score, band from banded where key = 'p1'",
    "impact_texts": _impact_sql(0.6) + " select node, array_to_string(route, ' -> ') as text from items",
    "risk_ranked": _risk_sql(True) + " select key, score, band, case when dependents > 0 then 'dependents: ' || dependents || ', direct ones: ' || direct_dependents else 'no dependents' end as why from banded",
    "risk_no_history": _risk_sql(False) + " select key, score, band, 3 as n_reasons from banded",
    "risk_bands": _risk_sql(True) + " select coalesce(band, 'unscored') as band, count(*) as n from part left join banded on banded.key = 'p' || p_partkey group by 1",
    "risk_dashboard": _risk_sql(True) + " select count(*) as nodes, count_if(band = 'critical') as critical, coalesce(max(score), 0.0) as max_score from banded",
    "risk_bar_widths": _risk_sql(False) + " select key, round(100.0::double * score / max(score) over (), 2) as width from banded",
}
