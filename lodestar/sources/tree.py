"""Source trees as DataFrames: staging, the inventory of files, what was skipped and why."""

from __future__ import annotations

import io
import os
import shutil
import stat
import subprocess
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
IGNORED = (
    ".git .hg .svn node_modules venv .venv env .env virtualenv site-packages __pycache__ .mypy_cache .pytest_cache .ruff_cache .tox .nox .eggs "
    "build dist target out .next .nuxt .cache coverage htmlcov .idea .vscode .terraform"
).split()
LANGUAGES = {".py": "python", ".pyi": "python"}
MAX_FILE_BYTES = 2 * 1024 * 1024
SKIP_REASONS = ("symlink", "ignored_dir", "unsupported_extension", "unreadable", "too_large")


class IngestError(Exception):
    """A source cannot be staged."""


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, size_bytes) of every file below a folder, with paths relative to it.

    Spark's file sources leave empty files out, which an __init__.py often is; a listing adds those.
    """
    top = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    found = files.select(F.substring_index("path", top, -1).alias("path"), "content", F.col("length").alias("size_bytes"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    listed, empty = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, True), []
    while listed.hasNext():
        status = listed.next()
        if status.getLen() == 0:
            empty.append((status.getPath().toString().rpartition(top)[2], bytearray(), 0))
    return found.union(spark.createDataFrame(empty, found.schema))


def read_trees(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """(repo, path, content, size_bytes) of several folders, by the name of their repository."""
    trees = [read_tree(spark, root).withColumn("repo", F.lit(repo)) for repo, root in sorted(roots.items())]
    out = trees[0]
    for t in trees[1:]:
        out = out.union(t)
    return out.select("repo", "path", "content", "size_bytes")


def read_zips(spark: SparkSession, paths: str) -> DataFrame:
    """(archive, path, content, size_bytes) of the files in zip archives, one archive a task step.

    An archive with an absolute member, or one that climbs out, fails. One folder around everything is dropped.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [i.filename for i in z.infolist()]
                    bad = [n for n in names if n.startswith(("/", "\\")) or ":" in n.split("/")[0] or ".." in n.replace("\\", "/").split("/")]
                    if bad:
                        raise IngestError(f"{archive} holds an unsafe path: {bad[0]}")
                    tops = {n.split("/")[0] for n in names}
                    cut = len(tops.pop()) + 1 if len(tops) == 1 and all("/" in n for n in names) else 0
                    for i in z.infolist():
                        if not i.is_dir():
                            data = z.read(i)
                            yield pd.DataFrame({"archive": [archive], "path": [i.filename[cut:]], "content": [data], "size_bytes": [len(data)]})

    zips = spark.read.format("binaryFile").load(paths).select("path", "content")
    return zips.mapInPandas(unpack, "archive string, path string, content binary, size_bytes long")


def prepare_folder(to: str, force: bool = False) -> None:
    """Makes room for a clone. A folder that holds something is refused, or with force deleted, read-only files too."""

    def writable(remove, path, error):
        os.chmod(path, stat.S_IRWXU)
        remove(path)

    if os.path.lexists(to) and (not os.path.isdir(to) or os.listdir(to)):
        if not force:
            raise IngestError(f"{to} exists and is not empty")
        if os.path.islink(to) or not os.path.isdir(to):
            os.remove(to)
        else:
            shutil.rmtree(to, onexc=writable)
    os.makedirs(os.path.dirname(os.path.abspath(to)), exist_ok=True)


def head_of(root: str) -> dict[str, str | None]:
    """sha and branch of a checkout; null where git cannot tell."""

    def ask(*what: str) -> str | None:
        done = subprocess.run(["git", "-C", root, *what], capture_output=True, text=True, check=False)
        return done.stdout.strip() or None if not done.returncode else None

    branch = ask("rev-parse", "--abbrev-ref", "HEAD")
    return {"sha": ask("rev-parse", "HEAD"), "branch": None if branch == "HEAD" else branch}


def clone(url: str, to: str, depth: int = 500, timeout: int = 900, force: bool = False) -> None:
    """git clone into a folder; the driver does it, since it is one stream over the network."""
    prepare_folder(to, force)
    done = subprocess.run(["git", "clone", "--depth", str(depth), "--", url, to], capture_output=True, text=True, timeout=timeout, check=False)
    if done.returncode:
        raise IngestError(done.stderr.strip() or "git clone failed")


def enforce_size(files: DataFrame, max_mb: float = 500) -> DataFrame:
    """The same files; fails if they are larger together. max_mb <= 0 allows any size."""
    if max_mb > 0:
        total = files.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
        if total > max_mb * 1024 * 1024:
            raise IngestError(f"source has {total / 1024 / 1024:.0f} MB; the limit is {max_mb:g} MB")
    return files


def tasks(spark: SparkSession) -> int:
    """Into how many parts sources are dealt: enough for every core, however few bytes they have."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(32, 4 * spark.sparkContext.defaultParallelism))


def line_count(content: Column) -> Column:
    """Line feeds, and one more for a last line without one. ISO-8859-1 gives a character for every byte."""
    text = F.decode(content, "ISO-8859-1")
    feeds = F.regexp_count(text, F.lit(r"\n"))
    return F.when(F.length(content) == 0, 0).otherwise(feeds + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("int")


def extension(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def skip_reason(max_bytes: int = MAX_FILE_BYTES) -> Column:
    """Why a file is left out, in order of precedence, or null. Uses is_symlink, ignored, path, readable, size_bytes."""
    known = extension(F.col("path")).isin(*LANGUAGES)
    out = F.when(F.col("is_symlink"), "symlink").when(F.col("ignored").isNotNull(), "ignored_dir").when(~known, "unsupported_extension").when(~F.col("readable"), "unreadable")
    return out.when(F.col("size_bytes") > max_bytes, "too_large") if max_bytes else out


def ignored_dir(path: Column) -> Column:
    """The path of the outermost ignored folder above a file, or null."""
    parts = F.split(path, "/")
    at = F.array_position(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*IGNORED)), True)
    return F.when(at > 0, F.array_join(F.slice(parts, F.lit(1), at.cast("int")), "/"))


def walk(tree: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """inventory() in order of paths."""
    own = ["repo"] if "repo" in tree.columns else []
    files, skipped = inventory(tree, max_bytes)
    return files.orderBy(*own, "path"), skipped.orderBy(*own, "path")


def inventory(tree: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """The files (path, language, extension, size_bytes, line_count, sha256, module) and the skipped paths (path, reason).

    tree: (path, content, size_bytes) and, where known, is_symlink, and repo, which both results then carry, so that
    many repositories are walked at once. An ignored folder is one skipped path.
    """
    own = ["repo"] if "repo" in tree.columns else []
    rows = tree if "is_symlink" in tree.columns else tree.withColumn("is_symlink", F.lit(False))
    rows = rows.withColumn("ignored", ignored_dir(F.col("path"))).withColumn("readable", F.col("content").isNotNull()).withColumn("reason", skip_reason(max_bytes))
    skipped = rows.where("reason is not null").select(*own, F.when(F.col("reason") == "ignored_dir", F.col("ignored")).otherwise(F.col("path")).alias("path"), "reason").distinct()
    kept = rows.where("reason is null").select(*own, "path", F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), extension(F.col("path"))).alias("language"), extension(F.col("path")).alias("extension"), "size_bytes", line_count(F.col("content")).alias("line_count"), F.sha2("content", 256).alias("sha256"), "content")
    return with_modules(kept), skipped


def with_modules(files: DataFrame) -> DataFrame:
    """Adds module: the stem and the folders above it while each holds an __init__.py; the root's never counts.

    __init__ adds no part; only one directly in the root has no module.
    """
    own = ["repo"] if "repo" in files.columns else []
    packages = files.where("path like '%/__init__.py'").select(*own, F.expr("substring(path, 1, length(path) - length('/__init__.py'))").alias("dir")).distinct()
    parts = F.split("path", "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    dirs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("dir")))
    above = files.select(*own, "path", F.explode(F.when(F.size(parts) > 1, dirs).otherwise(F.array().cast("array<struct<k:int,dir:string>>"))).alias("d")).select(*own, "path", "d.k", "d.dir")
    gaps = above.join(packages.withColumn("is_package", F.lit(True)), [*own, "dir"], "left").where("is_package is null").groupBy(*own, "path").agg(F.max("k").alias("gap"))
    joined = files.join(gaps, [*own, "path"], "left").withColumn("gap", F.coalesce("gap", F.lit(0)))
    inner = F.when(F.size(parts) - 1 > F.col("gap"), F.slice(parts, F.col("gap") + 1, F.size(parts) - 1 - F.col("gap"))).otherwise(F.array().cast("array<string>"))
    dotted = F.array_join(F.concat(inner, F.when(stem == "__init__", F.array().cast("array<string>")).otherwise(F.array(stem))), ".")
    return joined.withColumn("module", F.nullif(dotted, F.lit(""))).drop("gap")


def inventory_totals(files: DataFrame, skipped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row of totals, and the number of skipped paths by reason."""
    return files.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("total_lines"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes")), skipped.groupBy("reason").agg(F.count("*").alias("n"))
