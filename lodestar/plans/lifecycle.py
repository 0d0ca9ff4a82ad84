"""Running a parse: stages and their times, what is cached for it, its settings, providers by name."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.keys import with_repo
from lodestar.operators import build, chunking, cochange, resolve
from lodestar.plans.written import Written
from lodestar.sources import extract, tree


@dataclass(frozen=True)
class Settings:
    """Defaults of a parse."""

    max_repo_mb: float = 500
    max_file_bytes: int = tree.MAX_FILE_BYTES
    max_commits: int = 500
    embedding_dimensions: int = 1536
    embedding_provider: str = "hash"
    chat_provider: str = "stub"


class Stages:
    """Milliseconds by stage, recorded also where a stage fails."""

    def __init__(self) -> None:
        self.ms: dict[str, int] = {}

    @contextmanager
    def __call__(self, name: str) -> Iterator[None]:
        began = time.monotonic()
        try:
            yield
        finally:
            self.ms[name] = int((time.monotonic() - began) * 1000)


@dataclass
class Parsed:
    """What a parse makes, as lazy tables."""

    files: DataFrame
    skipped: DataFrame
    parsed: DataFrame
    symbols: DataFrame
    imports: DataFrame
    calls: DataFrame
    bases: DataFrame
    nodes: DataFrame
    edges: dict[str, DataFrame]
    chunks: DataFrame
    pairs: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)


def extract_tree(source: DataFrame, keep: Written, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files and skipped paths of a source tree, and what its files hold; files and what they hold are written once."""
    files, skipped = tree.inventory(source, settings.max_file_bytes)
    files = keep(files)
    return files, skipped.orderBy(*[c for c in ("repo",) if c in skipped.columns], "path"), keep(extract.extract(files))


def ordered_files(files: DataFrame) -> DataFrame:
    """(repo, path, module, ord) as resolution reads them: files count in order of their paths."""
    return with_repo(files)[0].select("repo", "path", "module", F.col("path").alias("ord"))


def parse_repository(source: DataFrame, repo: str, commits: DataFrame | None = None, settings: Settings = Settings()) -> Parsed:
    """parse_many() of one source tree (path, content, size_bytes), under the name repo."""
    named = lambda df: df.withColumn("repo", F.lit(repo))
    repos = source.sparkSession.range(1).select(F.lit(repo).alias("repo"))
    return parse_many(named(source), None if commits is None else named(commits), settings, repos)


def parse_many(source: DataFrame, commits: DataFrame | None = None, settings: Settings = Settings(), repos: DataFrame | None = None) -> Parsed:
    """From source trees (repo, path, content, size_bytes) to graph and chunks: all repositories in the same jobs.

    commits: (repo, ord, authored_at, paths). repos: (repo), all repositories where some may hold no file.

    What extraction and resolution find is written to the shared folder once and read from there; nodes, edges and
    chunks are lazy. A commit log that cannot be used leaves the rest whole: its failure is a warning.
    """
    keep = Written(source.sparkSession, sorted_joins=True)
    files, skipped, parsed = extract_tree(source, keep, settings)
    symbols, imports, calls = extract.symbols_of(parsed), extract.imports_of(parsed), extract.calls_of(parsed)
    index = ordered_files(files)
    resolved = keep(resolve.resolve_imports(imports, index))
    bases = keep(resolve.resolve_bases(symbols, index, resolved))
    found = keep(resolve.resolve_calls(calls, symbols, index, resolved, bases))
    deduped = resolve.dedupe_edges(resolved)
    repos = keep(source.select("repo").distinct()) if repos is None else repos
    nodes = build.node_rows(repos, parsed, symbols, resolve.unresolved_by_caller(found), files)
    nodes = nodes.unionByName(build.module_rows(deduped), allowMissingColumns=True).unionByName(build.external_class_rows(bases), allowMissingColumns=True)
    edges = {"CONTAINS": build.contains_rows(parsed, symbols), "IMPORTS": build.import_rows(deduped), "CALLS": build.call_rows(found, symbols), "INHERITS": build.inherit_rows(bases, symbols)}
    nodes = keep(nodes)
    edges = {kind: build.merge_edges(rows, nodes, kind) for kind, rows in edges.items()}
    text = files.select("repo", "path", "module", F.decode("content", "UTF-8").alias("text"))
    out = Parsed(files.drop("content"), skipped, parsed, symbols, resolved, found, bases, nodes, edges, chunking.chunk(text, symbols))
    if commits is not None:
        try:
            # Written here, so that a log that fails does so inside the try.
            out.pairs = keep(cochange.co_change(commits, files.select("repo", "path")))
        except Exception as e:  # noqa: BLE001 - history is a modifier, not a condition
            out.warnings.append(f"cochange: {e}")
    return out


class ParseCache:
    """Results of one parse kept by (repo, parsed_at, variant), the least recently used going first.

    Nothing is kept while parsed_at is missing. DataFrames are persisted while they are in and unpersisted as they go.
    """

    def __init__(self, size: int = 32):
        self.size, self.held, self.hits, self.misses = size, OrderedDict(), 0, 0

    def get(self, repo: str, parsed_at: Hashable | None, variant: Hashable, make: Callable[[], object]) -> tuple[object, bool]:
        if parsed_at is None:
            self.misses += 1
            return make(), False
        key = (repo, parsed_at, variant)
        if key in self.held:
            self.hits += 1
            self.held.move_to_end(key)
            return self.held[key], True
        self.misses += 1
        value = make()
        if isinstance(value, DataFrame):
            value = value.persist()
        self.held[key] = value
        while len(self.held) > self.size:
            self._let_go(next(iter(self.held)))
        return value, False

    def _let_go(self, key) -> None:
        value = self.held.pop(key)
        if isinstance(value, DataFrame):
            value.unpersist()

    def invalidate(self, repo: str | None = None) -> None:
        for key in [k for k in self.held if repo is None or k[0] == repo]:
            self._let_go(key)

    @property
    def hit_rate(self) -> float:
        asked = self.hits + self.misses
        return self.hits / asked if asked else 0.0


class Registry:
    """Providers by name; an unknown name lists the known ones."""

    def __init__(self, kind: str):
        self.kind, self.makers = kind, {}

    def register(self, name: str, make: Callable) -> None:
        self.makers[name] = make

    def get(self, name: str):
        if name not in self.makers:
            raise KeyError(f"unknown {self.kind} provider {name!r}; known: {', '.join(sorted(self.makers))}")
        return self.makers[name]()


def stage_percentages(jobs: DataFrame) -> DataFrame:
    """(stage, ms, percent) over all jobs' stage_ms maps, longest first."""
    per = jobs.select(F.explode("stage_ms").alias("stage", "ms")).groupBy("stage").agg(F.sum("ms").alias("ms"))
    total = per.agg(F.sum("ms").alias("total"))
    return per.join(F.broadcast(total)).select("stage", "ms", F.round(100.0 * F.col("ms") / F.col("total"), 1).alias("percent")).orderBy(F.desc("ms"), "stage")


def endpoint_times(calls: DataFrame) -> DataFrame:
    """(endpoint, runs, median_ms, worst_ms). The median is exact, over counts of each value."""
    return calls.groupBy("endpoint").agg(F.count("*").alias("runs"), F.round(F.median("ms"), 4).alias("median_ms"), F.max("ms").alias("worst_ms"))


def time_calls(run: Callable[[], object], times: int = 5) -> tuple[float, float]:
    """Median and worst milliseconds."""
    took = []
    for _ in range(times):
        began = time.monotonic()
        run()
        took.append((time.monotonic() - began) * 1000)
    return median(took), max(took)


def finish_job(spark: SparkSession, job: dict, stages: Stages, error: str | None = None) -> DataFrame:
    """A row for the table of jobs."""
    row = job | {"status": "failed" if error else "complete", "error": error, "stage_ms": stages.ms}
    return spark.createDataFrame([row], "id string, repo string, status string, error string, started_at string, stage_ms map<string,int>")
