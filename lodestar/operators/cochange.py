"""Files that change together, from commits (ord, sha, authored_at, paths); ord 0 is the newest.

Commits with a column repo are of several repositories: files of different ones never change together, and pairs and
counts carry the repository.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_FILES = 40
MIN_SHARED = 2
MAX_PAIRS = 5000


def _own(df: DataFrame) -> list[str]:
    return ["repo"] if "repo" in df.columns else []


def sized_commits(commits: DataFrame, paths: DataFrame | None = None, max_files: int = MAX_FILES) -> DataFrame:
    """(ord, authored_at, n_files, files): commits with a file, files sorted and null in a commit of more than max_files.

    Repeats of a path in one commit count once; with paths: (path), only those count. Files are gathered only in
    commits that turned out small enough, so a commit that touches everything never becomes one row of its files.
    """
    own = _own(commits)
    if paths is None:
        rows = commits.select(*own, "ord", "authored_at", F.sort_array(F.array_distinct("paths")).alias("files"))
        return rows.where(F.size("files") > 0).select(*own, "ord", "authored_at", F.size("files").alias("n_files"), F.when(F.size("files") <= max_files, F.col("files")).alias("files"))
    shared = [*own, "path"] if "repo" in paths.columns else ["path"]
    rows = commits.select(*own, "ord", "authored_at", F.explode(F.array_distinct("paths")).alias("path")).join(paths.select(*shared).distinct(), shared, "left_semi")
    sizes = rows.groupBy(*own, "ord", "authored_at").agg(F.count("*").cast("int").alias("n_files"))
    small = sizes.where(F.col("n_files") <= max_files).select(*own, "ord", "authored_at")
    files = rows.join(small, [*own, "ord", "authored_at"], "left_semi").groupBy(*own, "ord", "authored_at").agg(F.array_sort(F.collect_list("path")).alias("files"))
    return sizes.join(files, [*own, "ord", "authored_at"], "left")


def used_commits(commits: DataFrame, paths: DataFrame | None = None, max_files: int = MAX_FILES) -> tuple[DataFrame, DataFrame]:
    """(ord, authored_at, path) rows of the commits that count, and a row for each commit with its number of files.

    A commit of more than max_files says nothing about coupling and is left out of all counts.
    """
    sized = sized_commits(commits, paths, max_files)
    return sized.select(*_own(sized), "ord", "authored_at", F.explode("files").alias("path")), sized.drop("files")


def pairs_of(sized: DataFrame) -> DataFrame:
    """(left_path, right_path, ord, authored_at) of each commit: at most max_files * (max_files - 1) / 2, made within its row."""
    own = _own(sized)
    left = sized.where("size(files) > 1").select(*own, "ord", "authored_at", "files", F.posexplode("files").alias("i", "left_path"))
    return left.select(*own, "left_path", F.explode(F.expr("slice(files, i + 2, size(files))")).alias("right_path"), "ord", "authored_at")


def co_change(commits: DataFrame, paths: DataFrame | None = None, max_files: int = MAX_FILES, min_shared: int = MIN_SHARED, min_jaccard: float = 0.0, max_pairs: int | None = MAX_PAIRS, ordered: bool = True, of: DataFrame | None = None) -> DataFrame:
    """(left_path, right_path, shared, left_commits, right_commits, jaccard, last_together), strongest first.

    jaccard is rounded to 4 decimals and compared rounded. last_together is the date of the newest shared commit.
    max_pairs is for each repository. ordered: False leaves all pairs in no order, for readers that need none. Paths may be
    numbers; with dates that are not text, pairs are counted in hash tables and never sorted. of: (path), one file: only its pairs are counted.
    """
    own = _own(commits)
    sized = sized_commits(commits, paths, max_files)
    per_file = sized.select(*own, F.explode("files").alias("path")).groupBy(*own, "path").agg(F.count("*").alias("n"))
    made = pairs_of(sized)
    if of is not None:
        made = made.join(F.broadcast(of.select("path")), F.col("path").isin(F.col("left_path"), F.col("right_path")), "left_semi")  # one row
    pairs = made.groupBy(*own, "left_path", "right_path").agg(F.count("*").alias("shared"), F.min_by("authored_at", "ord").alias("last_together")).where(F.col("shared") >= min_shared)
    both = pairs.join(per_file.select(*own, F.col("path").alias("left_path"), F.col("n").alias("left_commits")), [*own, "left_path"]).join(per_file.select(*own, F.col("path").alias("right_path"), F.col("n").alias("right_commits")), [*own, "right_path"])
    rated = both.withColumn("jaccard", F.round(F.col("shared") / (F.col("left_commits") + F.col("right_commits") - F.col("shared")), 4)).where(F.col("jaccard") >= min_jaccard)
    strongest = [F.desc("shared"), F.desc("jaccard"), F.col("left_path"), F.col("right_path")]
    out = rated.select(*own, "left_path", "right_path", "shared", "left_commits", "right_commits", "jaccard", "last_together")
    if max_pairs is not None and own:
        out = out.withColumn("__n", F.row_number().over(Window.partitionBy("repo").orderBy(*strongest))).where(F.col("__n") <= max_pairs).drop("__n")
    if not ordered and (max_pairs is None or own):
        return out
    out = out.orderBy(*own, *strongest)
    return out if max_pairs is None or own else out.limit(max_pairs)


def window_stats(commits: DataFrame, paths: DataFrame | None = None, max_files: int = MAX_FILES) -> DataFrame:
    """One row: commits read, used and skipped as too large, and the first and last date by log order."""
    _, sizes = used_commits(commits, paths, max_files)
    read = commits.agg(F.count("*").alias("commits_read"), F.max_by("authored_at", "ord").alias("first_date"), F.min_by("authored_at", "ord").alias("last_date"))
    used = sizes.agg(F.count_if(F.col("n_files") <= max_files).alias("commits_used"), F.count_if(F.col("n_files") > max_files).alias("commits_skipped"))
    return read.join(F.broadcast(used))  # one row each


def churn(commits: DataFrame, paths: DataFrame | None = None, max_files: int = MAX_FILES) -> DataFrame:
    """(path, change_count): the counted commits that touch each file."""
    rows, _ = used_commits(commits, paths, max_files)
    return rows.groupBy(*_own(rows), "path").agg(F.count("*").alias("change_count"))


def partner_index(pairs: DataFrame) -> DataFrame:
    """(path, partner, shared, jaccard): every pair from both sides, each made once."""
    side = lambda a, b: F.struct(F.col(a).alias("path"), F.col(b).alias("partner"))
    both = F.explode(F.array(side("left_path", "right_path"), side("right_path", "left_path")))
    return pairs.select(*_own(pairs), both.alias("s"), "shared", "jaccard").select(*_own(pairs), "s.path", "s.partner", "shared", "jaccard")


def coupled(pairs: DataFrame, path: str | None = None, min_commits: int = 1, limit: int = 100) -> DataFrame:
    """The pairs with that file on either side, or all; strongest first, each once."""
    found = pairs.where(F.col("shared") >= min_commits)
    if path is not None:
        found = found.where((F.col("left_path") == path) | (F.col("right_path") == path))
    return found.orderBy(F.desc("shared"), F.desc("jaccard"), "left_path", "right_path").limit(limit)


def co_change_edges(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """CO_CHANGED edges of pairs whose files both exist. files: (path, key)."""
    own = _own(pairs) and _own(files)
    a, b = files.select(*own, F.col("path").alias("left_path"), F.col("key").alias("src")), files.select(*own, F.col("path").alias("right_path"), F.col("key").alias("dst"))
    return pairs.join(a, [*own, "left_path"]).join(b, [*own, "right_path"]).select(*own, "src", "dst", F.lit("CO_CHANGED").alias("type"), F.col("shared").alias("commits"), "jaccard", "left_commits", "right_commits", "last_together")


def set_churn(files: DataFrame, counts: DataFrame) -> DataFrame:
    """files with change_count: 0, not null, for a file that no counted commit touches."""
    return files.drop("change_count").join(counts, [*(_own(counts) and _own(files)), "path"], "left").withColumn("change_count", F.coalesce("change_count", F.lit(0)))
