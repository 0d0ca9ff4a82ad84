"""Commit logs as DataFrames, with renames followed to the names files have today."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.plans.written import Written

RECORD, FIELD = "\x00", "\x1f"
COMMITS = "repo string, ord int, sha string, authored_at string, author string, subject string, paths array<string>"


def read_log(root: str, max_commits: int = 500, timeout: int = 120) -> str:
    """The log of a checkout, newest first, without merges; empty where there is no commit yet."""
    form = f"%x00%H{FIELD}%aI{FIELD}%an{FIELD}%s"
    done = subprocess.run(["git", "-C", root, "log", f"--max-count={max_commits}", "--no-merges", "--name-status", "-M", f"--pretty=format:{form}"], capture_output=True, text=True, timeout=timeout, check=False)
    if done.returncode and "does not have any commits yet" not in done.stderr:
        raise RuntimeError(done.stderr.strip() or "git log failed")
    return done.stdout if not done.returncode else ""


def has_history(root: str) -> bool:
    done = subprocess.run(["git", "-C", root, "rev-parse", "--verify", "HEAD"], capture_output=True, check=False)
    return done.returncode == 0


def changes(logs: DataFrame) -> DataFrame:
    """(repo, ord, sha, authored_at, author, subject, changes) of raw logs (repo, log); changes: (n, path, was), was after a rename or copy."""
    records = logs.select("repo", F.posexplode(F.filter(F.split("log", RECORD), lambda r: F.trim(r) != "")).alias("ord", "record"))
    head, body = F.substring_index("record", "\n", 1), F.expr("case when instr(record, '\n') > 0 then substring(record, instr(record, '\n') + 1) else '' end")
    split = records.select("repo", "ord", F.split(head, FIELD).alias("h"), F.split(body, "\n").alias("lines")).where(F.size("h") >= 4)
    rows = F.transform(F.filter("lines", lambda x: F.contains(x, F.lit("\t")) & (F.trim(x) != "")), lambda x: F.split(x, "\t"))
    moved = lambda p: p[0].rlike("^[RC]") & (F.size(p) >= 3)
    entries = F.transform(rows, lambda p: F.struct(F.when(moved(p), p[2]).otherwise(p[1]).alias("path"), F.when(moved(p), p[1]).alias("was")))
    return split.select("repo", "ord", F.col("h")[0].alias("sha"), F.col("h")[1].alias("authored_at"), F.col("h")[2].alias("author"), F.col("h")[3].alias("subject"), entries.alias("changes"))


def commits(logs: DataFrame) -> DataFrame:
    """Commits with their distinct, sorted paths under today's names; ord 0 is the newest.

    A rename holds for every older mention of the old name, until an older rename of that name: an interval of places in
    the log. Every mention follows the rename whose interval it lies in to the name that has today, and goes on from there; a
    name that it had before ends the way. All mentions of all repositories take a step a round, and a rename's own new name is
    a mention too, so there are as many rounds as one file has names in a row, and no repository is one task's.
    """
    keep = Written(logs.sparkSession)
    rows = keep(changes(logs))
    each = rows.select("repo", "ord", F.posexplode("changes").alias("n", "c")).select("repo", F.struct("ord", "n").alias("at"), "c.path", "c.was")
    older = F.lead("at").over(Window.partitionBy("repo", "was").orderBy("at"))
    renames = keep(each.where("was is not null").select("repo", F.col("was").alias("name"), F.col("at").alias("since"), older.alias("until")))
    now = keep(each.select("repo", "at", F.col("path").alias("name"), F.array().cast("array<string>").alias("seen"), F.lit(False).alias("done")))
    while True:
        known = renames.join(now.where("done").select("repo", F.col("at").alias("since"), F.col("name").alias("today")), ["repo", "since"], "left")
        one = now.where("not done").join(known, ["repo", "name"], "left").where("since is null or (since < at and (until is null or at <= until))")
        # A mention outside all intervals of its name has no row left: it is done too.
        moves = one.where("since is not null").select("repo", "at", "since", "today")
        stepped = now.where("not done").join(moves, ["repo", "at"], "left")
        ends = F.col("since").isNull() | F.array_contains("seen", F.col("today"))
        goes = F.col("today").isNotNull() & ~F.coalesce(ends, F.lit(False))
        left = Observation()
        stepped = stepped.select(
            "repo", "at", F.when(goes, F.col("today")).otherwise(F.col("name")).alias("name"),
            F.when(goes, F.concat("seen", F.array("name"))).otherwise(F.col("seen")).alias("seen"), F.coalesce(ends, F.lit(False)).alias("done"),
        ).observe(left, F.count_if(~F.col("done")).alias("n"))
        now = keep(now.where("done").unionByName(stepped))
        if not left.get["n"]:
            break
    paths = now.groupBy("repo", F.col("at.ord").alias("ord")).agg(F.array_sort(F.collect_set("name")).alias("paths"))
    out = rows.drop("changes").join(paths, ["repo", "ord"], "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))
    return out.select(*[c.split()[0] for c in COMMITS.split(", ")])


def from_checkout(spark: SparkSession, root: str, repo: str, max_commits: int = 500) -> DataFrame:
    return commits(spark.createDataFrame([(repo, read_log(root, max_commits))], "repo string, log string"))
