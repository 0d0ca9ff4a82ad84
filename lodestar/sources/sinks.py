"""Graphs and vectors of many repositories on disk, in snapshots.

A run writes its rows into folders of its own, and then a manifest: which run's nodes, edges and vectors count for each
repository. The manifest takes effect by one rename to the next version, so readers see a run whole or not at all, whenever
the writer dies, and of two writers at once the later one fails. Repositories that a run is not about keep their rows: only
their line of the manifest is copied. Names of repositories are values of a column, never of a folder, so they stay strings.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestar.operators.graph import merge_properties, sweep
from lodestar.operators.retrieval import embedding_cost, payload
from lodestar.plans.written import Written

MANIFEST = "repo string, nodes string, edges string, vectors string"


class ConcurrentWrite(RuntimeError):
    """Another writer has committed since this one began."""


def replace_partitions(df: DataFrame, path: str, by: str = "repo") -> None:
    """Writes Parquet partitioned by `by`; only the partitions in df are replaced, each in one commit."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read(spark: SparkSession, path: str, repo: str | None = None, by: str = "repo") -> DataFrame:
    """What replace_partitions() wrote; the values of `by` are strings, also "007"."""
    found = spark.read.parquet(path).schema
    typed = StructType([StructField(f.name, StringType()) if f.name == by else f for f in found])
    df = spark.read.schema(typed).parquet(path)
    return df if repo is None else df.where(F.col(by) == repo)


# --- snapshots ---


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _files(spark, path)
    return fs.exists(p)


def version(spark: SparkSession, path: str) -> int:
    """The number of the last commit, 0 before the first."""
    fs, p = _files(spark, f"{path}/manifest")
    if not fs.exists(p):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return max((int(n[1:]) for n in names if re.fullmatch(r"v\d+", n)), default=0)


def manifest(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """(repo, nodes, edges, vectors): the runs that count, as of the last commit or of commit `at`."""
    n = version(spark, path) if at is None else at
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/v{n}") if n else spark.createDataFrame([], MANIFEST)


def _put(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def _commit(spark: SparkSession, path: str, lines: DataFrame, after: int) -> None:
    """Makes `lines` the manifest that follows version `after`: written aside, then renamed, which is one step."""
    aside = f"{path}/manifest/.new-{uuid.uuid4().hex}"
    _put(lines, aside)
    fs, source = _files(spark, aside)
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/v{after + 1}")
    if fs.exists(target) or not fs.rename(source, target):
        raise ConcurrentWrite(f"version {after + 1} of {path} is there already")


def _change(spark: SparkSession, path: str, repos: DataFrame, after: int, **runs: str) -> None:
    """Commits that these repositories have these runs; their other columns and all other repositories stay."""
    old = manifest(spark, path, after)
    columns = [c.split()[0] for c in MANIFEST.split(", ")][1:]
    changed = repos.select("repo").distinct().join(old, "repo", "left")
    changed = changed.select("repo", *[(F.lit(runs[c]) if c in runs else F.col(c)).alias(c) for c in columns])
    _commit(spark, path, old.join(repos, "repo", "left_anti").unionByName(changed), after)


def _rows(spark: SparkSession, path: str, kind: str, lines: DataFrame) -> DataFrame | None:
    """The rows of a kind that the manifest's lines name. Runs are folders, so Spark reads none that no line names."""
    if not _exists(spark, f"{path}/{kind}"):
        return None
    live = lines.where(F.col(kind).isNotNull()).select("repo", F.col(kind).alias("run"))
    every = spark.read.option("mergeSchema", "true").parquet(f"{path}/{kind}")
    return every.join(live, ["repo", "run"], "left_semi").drop("run")


def vacuum(spark: SparkSession, path: str, keep_versions: int = 1) -> int:
    """Deletes the run folders that none of the last versions needs; returns how many. No writer may be at work.

    Embeddings outlive the run that made them as long as a later one's vectors refer to them.
    """
    last, gone = version(spark, path), 0
    wanted: dict[str, set[str]] = {kind: set() for kind in ("nodes", "edges", "vectors", "embeddings")}
    runs = lambda df, c: {r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().collect()}  # noqa: E731 - names of runs only
    for n in range(max(1, last - keep_versions + 1), last + 1):
        m = manifest(spark, path, n)
        for kind in ("nodes", "edges", "vectors"):
            wanted[kind] |= runs(m, kind)
        rows = _rows(spark, path, "vectors", m)
        wanted["embeddings"] |= set() if rows is None else runs(rows, "at")
    for kind, needed in wanted.items():
        fs, p = _files(spark, f"{path}/{kind}")
        for s in fs.listStatus(p) if fs.exists(p) else []:
            if s.getPath().getName().removeprefix("run=") not in needed:
                fs.delete(s.getPath(), True)
                gone += 1
    return gone


# --- graphs ---


def _run() -> str:
    return f"r{uuid.uuid4().hex}"


def write_graph(nodes: DataFrame, edges: dict[str, DataFrame], path: str, run_id: str) -> dict[str, int]:
    """Upserts the nodes and edges of a run below path, and sweeps what its repositories no longer hold.

    Properties that other steps have set on a node stay; edges are those of the run. Other repositories are not
    touched. Returns how many nodes and edges were written and how many nodes were swept.
    """
    spark = nodes.sparkSession
    keep, after, run = Written(spark), version(spark, path), _run()
    new = keep(nodes.withColumn("run_id", F.lit(run_id)))
    repos = new.select("repo").distinct()
    old, swept, merged = _rows(spark, path, "nodes", manifest(spark, path, after).join(repos, "repo", "left_semi")), 0, new
    if old is not None:
        kept, gone = sweep(keep(merge_properties(old, new, ["repo", "key"])), run_id, None)
        swept, merged = gone.count(), kept
    _put(merged, f"{path}/nodes/run={run}")
    stamped, runs = None, {"nodes": run}
    for rows in edges.values():
        one = rows.withColumn("run_id", F.lit(run_id))
        stamped = one if stamped is None else stamped.unionByName(one, allowMissingColumns=True)
    if stamped is not None:
        _put(stamped, f"{path}/edges/run={run}")
        runs["edges"] = run
    _change(spark, path, repos, after, **runs)
    n_edges = 0 if stamped is None else spark.read.parquet(f"{path}/edges/run={run}").count()
    return {"nodes": new.count(), "edges": n_edges, "swept": swept}


def read_graph(spark: SparkSession, path: str, repo: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as the last finished run of each repository left them. Runs may have added columns."""
    lines = manifest(spark, path)
    if repo is not None:
        lines = lines.where(F.col("repo") == repo)
    nodes, edges = (_rows(spark, path, kind, lines) for kind in ("nodes", "edges"))
    none = spark.createDataFrame([], "repo string, key string, run_id string")
    return none if nodes is None else nodes, none if edges is None else edges


def set_properties(values: DataFrame, path: str) -> None:
    """Sets properties of nodes that are there, for instance their change_count. values: (repo, key, …)."""
    spark = values.sparkSession
    after, run = version(spark, path), _run()
    repos = values.select("repo").distinct()
    old = _rows(spark, path, "nodes", manifest(spark, path, after).join(repos, "repo", "left_semi"))
    held = values.join(old.select("repo", "key"), ["repo", "key"], "left_semi")
    _put(merge_properties(old, held, ["repo", "key"]), f"{path}/nodes/run={run}")
    _change(spark, path, held.select("repo"), after, nodes=run)


def delete_repositories(repos: DataFrame, path: str) -> None:
    """Takes repositories out of the next snapshot. repos: (repo)."""
    spark = repos.sparkSession
    after = version(spark, path)
    _commit(spark, path, manifest(spark, path, after).join(repos, "repo", "left_anti"), after)


# --- vectors ---


def write_vectors(chunks: DataFrame, path: str, model: str, run_id: str, dimensions: int) -> dict[str, float]:
    """Makes the chunks (repo, id, text, sha256, tokens, …) the vectors of their repositories.

    Chunks whose id, text hash, model and width a repository has already keep their vector and only the others are
    embedded; ids that are gone are swept. Rows of chunks are small and written anew; vectors are written once, and of the
    texts only those to be embedded. The names of the repositories are read from chunks in a pass of their own.
    Returns rows, embedded, swept, and the tokens and cost of what was embedded.
    """
    spark = chunks.sparkSession
    keep, after, run = Written(spark), version(spark, path), _run()
    if "sha256" not in chunks.columns:
        chunks = chunks.withColumn("sha256", F.sha2("text", 256))
    now = chunks.withColumn("model", F.lit(model)).withColumn("dimensions", F.lit(dimensions))
    same = ["repo", "id", "sha256", "model", "dimensions"]
    repos = keep(now.select("repo").distinct())
    old = _rows(spark, path, "vectors", manifest(spark, path, after).join(repos, "repo", "left_semi"))
    swept, placed = 0, now.withColumn("at", F.lit(None).cast("string"))
    if old is not None:
        placed = now.join(old.groupBy(*same).agg(F.max("at").alias("at")), same, "left").withColumn("text", F.when(F.col("at").isNull(), F.col("text")))
    placed = keep(placed)  # the texts of what is embedded, and no others
    if old is not None:
        swept = old.join(placed.select("repo", "id"), ["repo", "id"], "left_anti").count()
    fresh = placed.where("at is null").drop("at")
    made = payload(fresh.drop("model"), model, run_id, dimensions).select("repo", "id", "sha256", "embedding")
    _put(made, f"{path}/embeddings/run={run}")
    _put(placed.drop("text").withColumn("at", F.coalesce("at", F.lit(run))).withColumn("run_id", F.lit(run_id)), f"{path}/vectors/run={run}")
    _change(spark, path, repos, after, vectors=run)
    n, tokens, cost = fresh.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(embedding_cost(F.sum("tokens")), F.lit(0.0))).first()
    return {"rows": placed.count(), "embedded": n, "swept": swept, "tokens": tokens, "cost": cost}


def read_vectors(spark: SparkSession, path: str, repo: str | None = None) -> DataFrame:
    """The chunks of the last finished run of each repository, each with its vector."""
    lines = manifest(spark, path)
    if repo is not None:
        lines = lines.where(F.col("repo") == repo)
    rows = _rows(spark, path, "vectors", lines)
    if rows is None:
        return spark.createDataFrame([], "repo string, id string, run_id string, embedding array<double>")
    made = spark.read.parquet(f"{path}/embeddings").withColumnRenamed("run", "at")
    return rows.join(made, ["repo", "id", "sha256", "at"]).drop("at")


def to_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text a row, with nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
