"""Nodes and edges of the property graph from what extraction and resolution found, for any number of repositories (column repo)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.keys import external_class_key, file_key, module_key, repo_key, symbol_key, top_level
from lodestar.operators.graph import aggregate_calls, last_wins

LABEL = "case when kind = 'class' then 'Class' else 'Function' end"


def node_rows(repos: DataFrame, parsed: DataFrame, symbols: DataFrame, unresolved: DataFrame, inventory: DataFrame) -> DataFrame:
    """Repo, File, Class and Function nodes. repos: (repo); parsed: (repo, path, module, error); inventory: (repo, path, line_count, sha256)."""
    r = F.col("repo")
    root = repos.select("repo", repo_key(r).alias("key"), F.lit("Repo").alias("label"), r.alias("name"))
    files = parsed.join(inventory.select("repo", "path", "line_count", "sha256"), ["repo", "path"], "left").select("repo", file_key(r, "path").alias("key"), F.lit("File").alias("label"), F.substring_index("path", "/", -1).alias("name"), "path", "module", F.coalesce("line_count", F.lit(0)).alias("line_count"), "sha256", F.col("error").alias("parse_error"))
    counted = symbols.join(unresolved.select("repo", "path", F.col("caller").alias("qualname"), "unresolved_calls"), ["repo", "path", "qualname"], "left")
    own = counted.select(
        "repo", symbol_key(r, "module", "qualname", "path").alias("key"), F.expr(LABEL).alias("label"), "name", "path", "module", "qualname", "kind", "line_start", "line_end", "is_async", F.size(F.coalesce("parameters", F.array())).alias("param_count"),
        F.coalesce("unresolved_calls", F.lit(0)).alias("unresolved_calls"), F.lit(False).alias("is_external"),
    )
    # Overloads and .py/.pyi twins share a key: the last one counts.
    own = last_wins(own, ["key"], ["path", "line_start"])
    return root.unionByName(files, allowMissingColumns=True).unionByName(own, allowMissingColumns=True)


def module_rows(imports: DataFrame) -> DataFrame:
    """A node for each external module."""
    outside = imports.where("target_module is not null").select("repo", F.col("target_module").alias("dotted_name")).distinct()
    return outside.select("repo", module_key("repo", "dotted_name").alias("key"), F.lit("Module").alias("label"), F.col("dotted_name").alias("name"), "dotted_name", top_level("dotted_name").alias("top_level"), F.lit(True).alias("is_external"))


def external_class_rows(bases: DataFrame) -> DataFrame:
    outside = bases.where("base_path is null").select("repo", F.col("base").alias("name")).distinct()
    return outside.select("repo", external_class_key("repo", "name").alias("key"), F.lit("Class").alias("label"), "name", F.col("name").alias("qualname"), F.lit(True).alias("is_external"))


def import_rows(deduped: DataFrame) -> DataFrame:
    r = F.col("repo")
    dst = F.when(F.col("target_path").isNotNull(), file_key(r, "target_path")).otherwise(module_key(r, "target_module"))
    return deduped.select("repo", file_key(r, "source_path").alias("src"), dst.alias("dst"), F.lit("IMPORTS").alias("type"), F.lit(1.0).alias("confidence"), "resolution", "line", "alias", "level", (F.col("level") > 0).alias("is_relative"))


def call_rows(resolved_calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """One edge a pair of symbols."""
    r = F.col("repo")
    of = symbols.select("repo", "path", F.col("qualname").alias("caller"), "module").dropDuplicates(["repo", "path", "caller"])
    sites = resolved_calls.where("dst_qualname is not null").join(of, ["repo", "path", "caller"], "left")
    keyed = sites.select("repo", symbol_key(r, "module", "caller", "path").alias("src"), symbol_key(r, "dst_module", "dst_qualname", "dst_path").alias("dst"), "resolution", "confidence", "line")
    return aggregate_calls(keyed)


def inherit_rows(bases: DataFrame, symbols: DataFrame) -> DataFrame:
    r = F.col("repo")
    of = symbols.select("repo", "path", "qualname", "module").dropDuplicates(["repo", "path", "qualname"])
    up = of.select("repo", F.col("path").alias("base_path"), F.col("qualname").alias("base_qualname"), F.col("module").alias("base_module"))
    joined = bases.join(of, ["repo", "path", "qualname"], "left").join(up, ["repo", "base_path", "base_qualname"], "left")
    dst = F.when(F.col("base_path").isNotNull(), symbol_key(r, "base_module", "base_qualname", "base_path")).otherwise(external_class_key(r, "base"))
    return joined.select("repo", symbol_key(r, "module", "qualname", "path").alias("src"), dst.alias("dst"), F.lit("INHERITS").alias("type"), "position")


def contains_rows(parsed: DataFrame, symbols: DataFrame) -> DataFrame:
    """Repo to files, files to top-level symbols, symbols to those inside; a parent that was not extracted falls back to the file."""
    r = F.col("repo")
    files = parsed.select("repo", repo_key(r).alias("src"), file_key(r, "path").alias("dst"))
    parents = symbols.select("repo", "path", F.col("qualname").alias("parent"), symbol_key(r, "module", "qualname", "path").alias("parent_key")).dropDuplicates(["repo", "path", "parent"])
    inner = symbols.join(parents, ["repo", "path", "parent"], "left").select("repo", F.coalesce("parent_key", file_key(r, "path")).alias("src"), symbol_key(r, "module", "qualname", "path").alias("dst"))
    return files.union(inner).distinct().withColumn("type", F.lit("CONTAINS"))


MERGE_KEYS = {"CONTAINS": ["src", "dst"], "CALLS": ["src", "dst"], "IMPORTS": ["src", "dst", "line"], "INHERITS": ["src", "dst", "position"]}


def merge_edges(rows: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """Edges of one type whose ends both exist, one a merge key."""
    keys = nodes.select("key")
    both = rows.join(keys, rows.src == keys.key, "left_semi").join(keys, rows.dst == keys.key, "left_semi")
    return both.dropDuplicates(MERGE_KEYS[kind])
