"""Co-change kept up to date: counts of pairs and files to which new commits add, and from which commits that leave the window go.

The state is three tables: the commits of the window (at most `WINDOW` a repository, with their files), how often each pair
of files was in one of them, and how often each file was. Counts are sums, so an update adds the pairs of the commits
that come in, takes away those of the ones that fall out, and drops what reaches zero; other pairs are not mined again.
The newest commit of a pair falls out last, so the date of a pair that stays is right without a look at old commits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.keys import with_repo
from lodestar.operators.cochange import MAX_FILES, MIN_SHARED, sized_commits
from lodestar.plans.written import Written

WINDOW = 500
COMMITS = "repo string, seq long, authored_at string, files array<string>"
PAIRS = "repo string, left_path string, right_path string, shared long, last_seq long, last_together string"
FILES = "repo string, path string, n long"


@dataclass(frozen=True)
class Counts:
    commits: DataFrame
    pairs: DataFrame
    files: DataFrame


def empty(spark: SparkSession) -> Counts:
    return Counts(*(spark.createDataFrame([], schema) for schema in (COMMITS, PAIRS, FILES)))


def _of(commits: DataFrame, sign: int) -> tuple[DataFrame, DataFrame]:
    """The pairs and files of commits as changes of the counts."""
    both = F.expr("flatten(transform(files, (l, i) -> transform(slice(files, i + 2, size(files)), r -> struct(l as left_path, r as right_path))))")
    some = commits.where("files is not null")
    pairs = some.where("size(files) > 1").select("repo", "seq", "authored_at", F.explode(both).alias("p"))
    newest = F.struct("seq", "authored_at")
    pairs = pairs.groupBy("repo", "p.left_path", "p.right_path").agg((F.lit(sign) * F.count("*")).alias("shared"), F.max(newest).alias("last"))
    pairs = pairs.select("repo", "left_path", "right_path", "shared", F.col("last.seq").alias("last_seq"), F.col("last.authored_at").alias("last_together"))
    files = some.select("repo", F.explode("files").alias("path")).groupBy("repo", "path").agg((F.lit(sign) * F.count("*")).alias("n"))
    return pairs, files


def update(state: Counts, new: DataFrame, window: int = WINDOW, max_files: int = MAX_FILES) -> Counts:
    """The state after new commits (repo, seq, authored_at, paths). seq grows with time and is one commit's of a repository.

    Commits that the state has already, or that are older than the whole window, change nothing. A commit of more than
    max_files fills its place in the window and counts nowhere.
    """
    keep = Written(new.sparkSession)
    (new,) = with_repo(new)
    sized = sized_commits(new.withColumn("ord", F.struct("seq")), None, max_files).select("repo", F.col("ord.seq").cast("long").alias("seq"), "authored_at", "files")
    fresh = sized.join(state.commits.select("repo", "seq"), ["repo", "seq"], "left_anti").withColumn("fresh", F.lit(True))
    # A window's worth of the new ones is enough, and Spark takes it in each task before the rows of a repository meet.
    place = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("seq")))
    fresh = fresh.withColumn("place", place).where(F.col("place") <= window).drop("place")
    touched = fresh.select("repo").distinct()  # windows of other repositories stand still
    at_hand = state.commits.join(touched, "repo", "left_semi").withColumn("fresh", F.lit(False)).unionByName(fresh)
    placed = keep(at_hand.withColumn("stays", place <= window))
    come, go = _of(placed.where("fresh and stays"), 1), _of(placed.where("not fresh and not stays"), -1)
    newest = F.max(F.struct("last_seq", "last_together")).alias("last")
    pairs = state.pairs.unionByName(come[0]).unionByName(go[0]).groupBy("repo", "left_path", "right_path").agg(F.sum("shared").alias("shared"), newest).where("shared > 0")
    files = state.files.unionByName(come[1]).unionByName(go[1]).groupBy("repo", "path").agg(F.sum("n").alias("n")).where("n > 0")
    commits = state.commits.join(touched, "repo", "left_anti").unionByName(placed.where("stays").drop("fresh", "stays"))
    return Counts(keep(commits), keep(pairs.select("repo", "left_path", "right_path", "shared", "last.last_seq", "last.last_together")), keep(files))


def co_change(state: Counts, min_shared: int = MIN_SHARED, min_jaccard: float = 0.0) -> DataFrame:
    """The pairs of the window as co_change() of all its commits gives them, in no order."""
    side = lambda c: state.files.select("repo", F.col("path").alias(f"{c}_path"), F.col("n").alias(f"{c}_commits"))
    both = state.pairs.where(F.col("shared") >= min_shared).join(side("left"), ["repo", "left_path"]).join(side("right"), ["repo", "right_path"])
    rated = both.withColumn("jaccard", F.round(F.col("shared") / (F.col("left_commits") + F.col("right_commits") - F.col("shared")), 4))
    return rated.where(F.col("jaccard") >= min_jaccard).select("repo", "left_path", "right_path", "shared", "left_commits", "right_commits", "jaccard", "last_together")
