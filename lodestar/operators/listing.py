"""Paged lists and details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page(ordered: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Rows offset.. of an ordered table."""
    return ordered.offset(offset).limit(limit)


def with_total(whole: DataFrame, shown: DataFrame) -> DataFrame:
    """The shown rows with the number of rows of the whole table beside each."""
    return shown.join(F.broadcast(whole.agg(F.count("*").alias("total"))))  # one row


def repositories(repos: DataFrame) -> DataFrame:
    return repos.orderBy(F.desc("created_at"), "id")


def list_files(files: DataFrame, search: str | None = None) -> DataFrame:
    """By path. In `search`, % and _ match as in ILIKE."""
    found = files if not search else files.where(F.col("path").ilike(f"%{search}%"))
    return found.orderBy("path")


def list_symbols(symbols: DataFrame, search: str | None = None, kind: str | None = None, path: str | None = None) -> DataFrame:
    """By module, those without one last, then line."""
    out = symbols
    if search:
        out = out.where(F.col("qualname").ilike(f"%{search}%"))
    if kind:
        out = out.where(F.col("kind") == kind)
    if path:
        out = out.where(F.col("path") == path)
    return out.orderBy(F.asc_nulls_last("module"), "line_start", "qualname")


def list_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("started_at"), "id")


def latest_job(jobs: DataFrame) -> DataFrame:
    """The newest job of each repository."""
    return jobs.groupBy("repo").agg(F.max_by(F.struct("id", "status", "started_at"), F.struct("started_at", "id")).alias("j")).select("repo", "j.*")


def client_filter(files: DataFrame, needle: str) -> DataFrame:
    """A literal, case-insensitive part of the path."""
    return files.where(F.contains(F.lower("path"), F.lower(F.lit(needle))))


def delete_repository(tables: dict[str, DataFrame], repo: str) -> dict[str, DataFrame]:
    """Every table without the rows of one repository."""
    return {name: t.where(~F.col("repo").eqNullSafe(F.lit(repo))) for name, t in tables.items()}
