"""Imports, calls and base classes of source trees resolved to their files and symbols, as joins.

Any number of repositories resolve at once: the column repo is in every key, so none resolves into another. Tables
without it are of one repository, whose name comes out empty.

files: (repo, path, module, ord), ord the order of the files. imports: (repo, path, module, name, alias, line, level,
is_from, ord). symbols: (repo, path, module, qualname, name, kind, parent, line_start, ord, base_classes).
calls: (repo, path, callee, caller, line, ord).

Chains of base classes double in length each round, each round written to the shared folder. Inputs should be tables rather than long plans, for they are read several times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.keys import with_repo
from lodestar.functions.scoring import CONFIDENCE
from lodestar.operators.graph import first_wins, last_wins
from lodestar.plans.written import Written

#: Classes that self.x of a call is looked up in, in levels: the reference follows calls no further. class_lookup_order itself has no such bound.
MAX_LEVELS = 10
MAX_HOPS = 2


def target_of() -> Column:
    """What an import names, in text: dots, module, name."""
    inner = F.concat_ws(".", F.nullif("module", F.lit("")), F.when(F.col("is_from"), F.nullif("name", F.lit(""))))
    return F.concat(F.repeat(F.lit("."), F.col("level")), inner)


def bound_name() -> Column:
    """The name an import binds: its alias, else the imported name, else the first part of the module."""
    return F.coalesce(F.nullif("alias", F.lit("")), F.when(F.col("is_from"), F.col("name")).otherwise(F.substring_index("module", ".", 1)))


def module_index(files: DataFrame) -> DataFrame:
    """(repo, module, target_path): of files with the same module the last one counts."""
    (files,) = with_repo(files)
    return files.where("module is not null and module <> ''").groupBy("repo", "module").agg(F.max_by("path", "ord").alias("target_path"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Every import with source_path, target_path or target_module, resolution, bound_name and imported_name.

    The deeper name is tried first: `from a import b` means the module a.b where there is one. Relative imports
    climb from the importing package; climbing too far makes them external under their own text.
    """
    imports, files = with_repo(imports, files)
    index = module_index(files)
    of = imports.withColumnRenamed("module", "named").join(files.select("repo", "path", F.col("module").alias("own")), ["repo", "path"], "left").withColumnRenamed("named", "module")
    parts = F.split("own", r"\.")
    package = F.when(F.endswith("path", F.lit("__init__.py")), parts).otherwise(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
    climb = F.col("level") - 1
    inside = F.coalesce(F.col("own") != "", F.lit(False)) & (climb <= F.size(package))
    left = F.array_join(F.slice(package, F.lit(1), F.greatest(F.size(package) - climb, F.lit(0))), ".")
    relative = F.nullif(F.concat_ws(".", F.nullif(left, F.lit("")), F.nullif("module", F.lit(""))), F.lit(""))
    base = F.when(F.col("level") > 0, F.when(inside, relative)).otherwise(F.nullif("module", F.lit("")))
    asked = of.withColumn("base", base).withColumn("deep", F.when(F.col("is_from") & (F.col("name") != ""), F.concat_ws(".", "base", "name"))).withColumn("deep", F.when(F.col("base").isNotNull(), F.col("deep")))
    deep, plain = index.select("repo", F.col("module").alias("deep"), F.col("target_path").alias("deep_path")), index.select("repo", F.col("module").alias("base"), F.col("target_path").alias("base_path"))
    found = asked.join(deep, ["repo", "deep"], "left").join(plain, ["repo", "base"], "left")
    resolution = (
        F.when(F.col("deep_path").isNull() & F.col("base_path").isNull(), "external")
        .when(F.col("level") > 0, "relative")
        .when(F.col("deep_path").isNotNull() | ~F.col("is_from"), "internal_module")
        .otherwise("internal_symbol")
    )
    path = F.coalesce("deep_path", "base_path")
    outside = F.when(path.isNull(), F.when((F.col("level") > 0) | F.col("base").isNull(), target_of()).otherwise(F.col("base")))
    return found.select("repo", F.col("path").alias("source_path"), path.alias("target_path"), outside.alias("target_module"), resolution.alias("resolution"), bound_name().alias("bound_name"), F.col("name").alias("imported_name"), "alias", "line", "level", "ord")


def dedupe_edges(resolved: DataFrame) -> DataFrame:
    """One import a source, target and line: the first."""
    return first_wins(resolved, ["repo", "source_path", "target_path", "target_module", "line"], ["ord"])


def bindings(resolved: DataFrame) -> DataFrame:
    """(repo, path, bound_name, target_path, imported_name): the last import that binds a name counts, in-repo or not."""
    last = last_wins(resolved.where("bound_name is not null and bound_name <> ''"), ["repo", "source_path", "bound_name"], ["ord"])
    return last.select("repo", F.col("source_path").alias("path"), "bound_name", "target_path", "imported_name")


def _by_qualname(symbols: DataFrame) -> DataFrame:
    return last_wins(symbols, ["repo", "path", "qualname"], ["ord"])


def _by_name(symbols: DataFrame) -> DataFrame:
    """(repo, path, name, n, tops, one, top): how many symbols share a name in a file, and which one a bare use means."""
    who = F.struct("qualname", "module", "kind")
    top = F.col("parent").isNull()
    return symbols.groupBy("repo", "path", "name").agg(F.count("*").alias("n"), F.count_if(top).alias("tops"), F.min_by(who, "ord").alias("one"), F.min_by(F.when(top, who), F.when(top, F.col("ord"))).alias("top"))


def _picked() -> tuple[Column, Column]:
    """The picked symbol of _by_name columns, and whether the choice is ambiguous."""
    picked = F.when(F.col("n") == 1, F.col("one")).when(F.col("tops") == 1, F.col("top"))
    return picked, (F.col("n") > 1) & (F.col("tops") != 1)


def _named(symbols: DataFrame) -> DataFrame:
    """(repo, path, name, picked, unclear): what a bare use of a name means in a file."""
    picked, unclear = _picked()
    return _by_name(symbols).select("repo", "path", "name", picked.alias("picked"), unclear.alias("unclear"))


def _meanings(known: DataFrame, names: DataFrame) -> DataFrame:
    """(repo, look_path, look_name, hit, picked, unclear): what a name means in a file. known: _by_qualname(), names: _named()."""
    exact = known.select("repo", F.col("path").alias("look_path"), F.col("qualname").alias("look_name"), F.struct("qualname", "module", "kind").alias("hit"))
    return exact.join(names.select("repo", F.col("path").alias("look_path"), F.col("name").alias("look_name"), "picked", "unclear"), ["repo", "look_path", "look_name"], "full")


def lookup_in_file(asked: DataFrame, symbols: DataFrame, bound: DataFrame) -> DataFrame:
    """Adds dst_path, dst (struct qualname, module, kind) and ambiguous to rows with look_path, look_name, look_id.

    A name is a qualname of the file, else, without dots, the picked symbol of that name, else what the file
    imports under it, followed over at most two re-exports. The first conclusive answer is final.

    One chain of joins, each by a unique key. Rows that are answered look on under a key of their own that matches
    nothing, so they neither change nor gather in one partition.
    """
    asked, symbols, bound = with_repo(asked, symbols, bound)
    return _looked_up(asked, _meanings(_by_qualname(symbols), _named(symbols)), bound)


def _looked_up(asked: DataFrame, meaning: DataFrame, bound: DataFrame) -> DataFrame:
    key = ["repo", "look_path", "look_name"]
    follow = bound.where("target_path is not null and target_path <> path").select("repo", F.col("path").alias("look_path"), F.col("bound_name").alias("look_name"), F.col("target_path").alias("next_path"), F.col("imported_name").alias("next_name"))
    none = F.lit(None).cast(meaning.schema["hit"].dataType)
    now = asked.withColumns({"dst": none, "dst_path": F.lit(None).cast("string"), "ambiguous": F.lit(False)})
    for hop in range(MAX_HOPS + 1):
        bare = ~F.contains("look_name", F.lit("."))
        hit = F.coalesce("hit", F.when(bare, F.col("picked")))
        vague = F.col("hit").isNull() & bare & F.coalesce("unclear", F.lit(False))
        seen = now.join(meaning, key, "left")
        now = seen.withColumns({"dst": F.coalesce("dst", hit), "dst_path": F.coalesce("dst_path", F.when(hit.isNotNull(), F.col("look_path"))), "ambiguous": F.col("ambiguous") | vague}).drop("hit", "picked", "unclear")
        if hop < MAX_HOPS:
            goes_on = F.col("dst").isNull() & ~F.col("ambiguous") & bare & F.col("next_path").isNotNull()
            path = F.when(goes_on, F.col("next_path")).otherwise(F.concat(F.lit("\x1f"), "look_id"))
            now = now.join(follow, key, "left").withColumns({"look_path": path, "look_name": F.when(goes_on, F.coalesce("next_name", "look_name")).otherwise("")}).drop("next_path", "next_name")
    return now


def longest_prefix(asked: DataFrame, index: DataFrame, dotted: str) -> DataFrame:
    """Adds mod_path and mod_rest: the longest proper dotted prefix that is a module, and what follows it."""
    parts = F.split(dotted, r"\.")
    cuts = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, F.lit(1), k), ".").alias("module"), F.array_join(F.slice(parts, k + 1, F.size(parts)), ".").alias("rest")))
    tries = asked.where(F.size(parts) > 1).select("repo", "look_id", F.explode(cuts).alias("t")).select("repo", "look_id", "t.*").join(index, ["repo", "module"])
    best = tries.groupBy("look_id").agg(F.max_by(F.struct(F.col("target_path"), F.col("rest")), "k").alias("b"))
    return asked.join(best, "look_id", "left").withColumn("mod_path", F.col("b.target_path")).withColumn("mod_rest", F.col("b.rest")).drop("b")


def resolve_bases(symbols: DataFrame, files: DataFrame, resolved: DataFrame) -> DataFrame:
    """(repo, path, qualname, position, base, base_path, base_qualname): in-repo bases, else external under `base`.

    Dotted names go by module prefix, else by what binds their head; bare ones by the file's own classes, then by
    what is imported. No repository-wide guess.
    """
    symbols, files, resolved = with_repo(symbols, files, resolved)
    raw = symbols.where("kind = 'class'").select("repo", "path", "qualname", F.posexplode("base_classes").alias("position", "raw")).withColumn("base", F.trim(F.substring_index("raw", "[", 1))).where("base <> ''")
    raw = raw.withColumn("look_id", F.concat_ws("\x1f", "repo", "path", "qualname", "position"))
    asked = longest_prefix(raw.select("repo", "look_id", "path", "base"), module_index(files), "base")
    bound = bindings(resolved)
    head, tail = F.substring_index("base", ".", 1), F.expr("substring(base, instr(base, '.') + 1)")
    asked = asked.withColumn("head", head).join(bound.select("repo", "path", F.col("bound_name").alias("head"), F.col("target_path").alias("b_path"), "imported_name"), ["repo", "path", "head"], "left")
    dotted = F.contains("base", F.lit("."))
    first_path = F.when(dotted, F.coalesce("mod_path", "b_path")).otherwise(F.col("path"))
    first_name = F.when(dotted, F.when(F.col("mod_path").isNotNull(), F.col("mod_rest")).otherwise(tail)).otherwise(F.col("base"))
    tries = asked.select("repo", "look_id", F.lit(0).alias("n"), first_path.alias("look_path"), first_name.alias("look_name")).union(asked.where(~dotted).select("repo", "look_id", F.lit(1), "b_path", F.coalesce("imported_name", "base")))
    exact = _by_qualname(symbols).select("repo", F.col("path").alias("look_path"), F.col("qualname").alias("look_name"), F.col("qualname").alias("eq"), F.col("kind").alias("ek"))
    picked, _ = _picked()
    loose = _by_name(symbols.where("kind = 'class'")).select("repo", F.col("path").alias("look_path"), F.col("name").alias("look_name"), picked["qualname"].alias("lq"))
    hit = tries.join(exact, ["repo", "look_path", "look_name"], "left").join(loose, ["repo", "look_path", "look_name"], "left")
    found = hit.withColumn("q", F.when(F.col("ek").isNotNull(), F.when(F.col("ek") == "class", F.col("eq"))).otherwise(F.col("lq"))).where("q is not null")
    best = found.groupBy("look_id").agg(F.min_by(F.struct(F.col("look_path"), F.col("q")), "n").alias("b"))
    return raw.join(best, "look_id", "left").select("repo", "path", "qualname", "position", "base", F.col("b.look_path").alias("base_path"), F.col("b.q").alias("base_qualname"))


def enclosing_classes(symbols: DataFrame) -> DataFrame:
    """(repo, path, caller, owner): the nearest class around a symbol along its parents; a missing parent ends the search.

    A parent is the qualname up to its last dot, as extraction makes it, so all parents of a symbol are known at once
    and one join finds them: no loop by depth.
    """
    (symbols,) = with_repo(symbols)
    return _enclosing(_by_qualname(symbols))


def _enclosing(known: DataFrame) -> DataFrame:
    parts = F.split("caller", r"\.")
    around = F.transform(F.sequence(F.size(parts) - 1, F.lit(1)), lambda k: F.struct((F.size(parts) - k).alias("up"), F.array_join(F.slice(parts, F.lit(1), k), ".").alias("owner")))
    inner = known.where("parent is not null and parent <> ''").select("repo", "path", F.col("qualname").alias("caller")).where(F.size(parts) > 1)
    up = inner.select("*", F.explode(around).alias("u")).select("repo", "path", "caller", "u.*").join(known.select("repo", "path", F.col("qualname").alias("owner"), "kind"), ["repo", "path", "owner"])
    found = up.groupBy("repo", "path", "caller").agg(F.min_by("owner", F.when(F.col("kind") == "class", F.col("up"))).alias("owner"), F.min(F.when(F.col("kind") == "class", F.col("up"))).alias("at"), F.array_sort(F.collect_set("up")).alias("met"))
    # The parents up to the class are all there if the at-th smallest distance is at itself.
    return found.where(F.col("at").isNotNull() & (F.get("met", F.col("at") - 1) == F.col("at"))).select("repo", "path", "caller", "owner")


def _further(now: DataFrame, reach: int, levels: int | None = None) -> DataFrame:
    """The ways of more than reach steps, up to twice as many and under levels if given: those of exactly reach steps, gone on from where they end."""
    on = now.where("rank.level > 0").select("repo", F.col("path").alias("at_path"), F.col("owner").alias("at_qualname"), F.col("at_path").alias("to_path"), F.col("at_qualname").alias("to"), F.col("rank").alias("then"))
    met = now.where(F.col("rank.level") == reach).join(on, ["repo", "at_path", "at_qualname"])
    if levels is not None:
        met = met.where(F.col("rank.level") + F.col("then.level") < levels)
    return met.select("repo", "path", "owner", F.col("to_path").alias("at_path"), F.col("to").alias("at_qualname"), F.struct((F.col("rank.level") + F.col("then.level")).alias("level"), F.concat("rank.rank", "then.rank").alias("rank")).alias("rank"))


def class_lookup_order(bases: DataFrame, classes: DataFrame, levels: int | None = None) -> DataFrame:
    """(repo, path, owner, at_path, at_qualname, rank): the classes self.x looks in, breadth first in order of bases: all of them, or those of the first levels.

    rank is (level, positions): of the shortest ways to a class the one whose positions come first. Ways double in length
    each round: a way of k + j steps is one of exactly k that meets one of j <= k. Both parts of a first way are first ways
    themselves, so one row a pair of classes is enough, and each further way is made once. Rounds end when no way is as long as they reach.
    """
    bases, classes = with_repo(bases, classes)
    keep = Written(bases.sparkSession, sorted_joins=True)
    one = classes.select("repo", "path", F.col("qualname").alias("owner"), F.col("path").alias("at_path"), F.col("qualname").alias("at_qualname"), F.struct(F.lit(0).alias("level"), F.array().cast("array<int>").alias("rank")).alias("rank"))
    edge = bases.where("base_path is not null").select("repo", "path", F.col("qualname").alias("owner"), F.col("base_path").alias("at_path"), F.col("base_qualname").alias("at_qualname"), F.struct(F.lit(1).alias("level"), F.array("position").alias("rank")).alias("rank"))
    known = classes.select("repo", "path", F.col("qualname").alias("owner"))
    first = lambda rows: rows.groupBy("owner", "at_qualname", "path", "at_path", "repo").agg(F.min("rank").alias("rank")).select("repo", "path", "owner", "at_path", "at_qualname", "rank")
    now, reach = keep(first(one.union(edge.join(known, ["repo", "path", "owner"], "left_semi")))), 1
    while (levels is None or reach < levels - 1) and now.agg(F.max("rank.level")).first()[0] == reach:
        now, reach = keep(first(now.union(_further(now, reach, levels)))), 2 * reach
    return now if levels is None else now.where(F.col("rank.level") < levels)


def resolve_calls(calls: DataFrame, symbols: DataFrame, files: DataFrame, resolved: DataFrame, bases: DataFrame) -> DataFrame:
    """Every call with dst_path, dst_qualname, resolution, confidence and reason.

    reason is null where the call is resolved, else module_level, ambiguous or unresolved. Bare names: the file's
    own symbol, else what is imported. self and cls: the enclosing class and its in-repo bases. Other attributes:
    the longest prefix that is a module, whatever it holds, else what binds the head.
    """
    calls, symbols, files, resolved, bases = with_repo(calls, symbols, files, resolved, bases)
    # Read several times below, so made once: in one plan each use would make it anew, and the driver would hold a plan of them all.
    keep = Written(calls.sparkSession, sorted_joins=True)
    known = keep(_by_qualname(symbols.select("repo", "path", "qualname", "module", "kind", "parent", "ord")))
    names, bound, index = keep(_named(symbols)), keep(bindings(resolved)), keep(module_index(files))
    meaning = keep(_meanings(known, names))
    all_ = calls.withColumn("look_id", F.concat_ws("\x1f", "repo", "path", F.col("ord").cast("string")))
    inner = all_.where("caller is not null and caller <> ''")
    head, tail = F.substring_index("callee", ".", 1), F.expr("substring(callee, instr(callee, '.') + 1)")
    kind = F.when(~F.contains("callee", F.lit(".")), "bare").when(head.isin("self", "cls"), "self").otherwise("attribute")
    inner = inner.withColumn("form", kind).withColumn("head", head).withColumn("tail", F.when(kind != "bare", tail))
    binding = bound.where("target_path is not null").select("repo", "path", F.col("bound_name").alias("head"), F.col("target_path").alias("b_path"), "imported_name")

    bare = inner.where("form = 'bare'").join(names.withColumnRenamed("name", "callee"), ["repo", "path", "callee"], "left")
    local = bare.where("picked is not null or unclear").select("look_id", F.when(F.col("picked").isNotNull(), F.col("path")).alias("dst_path"), F.col("picked").alias("dst"), F.coalesce("unclear", F.lit(False)).alias("ambiguous"), F.lit("local").alias("resolution"))
    through = bare.where("picked is null and not coalesce(unclear, false)").join(binding, ["repo", "path", "head"]).select("repo", "look_id", F.col("b_path").alias("look_path"), F.coalesce("imported_name", "callee").alias("look_name"), F.lit("imported").alias("resolution"))

    attribute = longest_prefix(inner.where("form = 'attribute'").select("repo", "look_id", "path", "callee", "head", "tail"), index, "callee").join(binding, ["repo", "path", "head"], "left")
    dotted = attribute.select("repo", "look_id", F.coalesce("mod_path", "b_path").alias("look_path"), F.when(F.col("mod_path").isNotNull(), F.col("mod_rest")).otherwise(F.col("tail")).alias("look_name"), F.lit("attribute_module").alias("resolution")).where("look_path is not null")
    looked = keep(_looked_up(through.union(dotted), meaning, bound).select("look_id", "dst_path", "dst", "ambiguous", "resolution"))

    order = class_lookup_order(bases, symbols.where("kind = 'class'"), MAX_LEVELS)
    methods = known.select("repo", F.col("path").alias("at_path"), F.col("qualname").alias("m"), F.struct("qualname", "module", "kind").alias("dst"))
    own = inner.where("form = 'self' and instr(tail, '.') = 0").join(_enclosing(known), ["repo", "path", "caller"]).join(order, ["repo", "path", "owner"]).withColumn("m", F.concat_ws(".", "at_qualname", "tail"))
    hits = own.join(methods, ["repo", "at_path", "m"])
    of_self = hits.groupBy("look_id").agg(F.min_by(F.struct("at_path", "dst"), F.struct("rank", "at_path", "m")).alias("b")).select("look_id", F.col("b.at_path").alias("dst_path"), F.col("b.dst").alias("dst"), F.lit(False).alias("ambiguous"), F.lit("attribute_self").alias("resolution"))

    answers = keep(local.unionByName(looked).unionByName(of_self))
    reason = F.when(F.coalesce("caller", F.lit("")) == "", "module_level").when(F.col("dst").isNotNull(), None).when(F.coalesce("ambiguous", F.lit(False)), "ambiguous").otherwise("unresolved")
    sure = F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), F.col("resolution"))
    out = all_.join(answers, "look_id", "left").withColumn("resolution", F.when(F.col("dst").isNotNull(), F.col("resolution")))
    return out.select("repo", "path", "caller", "callee", "line", "ord", "dst_path", F.col("dst.qualname").alias("dst_qualname"), F.col("dst.module").alias("dst_module"), F.col("dst.kind").alias("dst_kind"), "resolution", F.when(F.col("resolution").isNotNull(), sure).alias("confidence"), reason.alias("reason"))


def unresolved_by_caller(resolved_calls: DataFrame) -> DataFrame:
    return resolved_calls.where("reason in ('unresolved', 'ambiguous')").groupBy("repo", "path", "caller").agg(F.count("*").alias("unresolved_calls"))


def resolution_counts(resolved_calls: DataFrame) -> DataFrame:
    return resolved_calls.groupBy(F.coalesce("resolution", "reason").alias("outcome")).agg(F.count("*").alias("n"))
