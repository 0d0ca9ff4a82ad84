"""Command line: the inventory of a source tree, as a table, with symbols, or as JSON. Run it with spark-submit or python -m.

Rows are printed as they come, a partition at a time. A clone goes to a folder below --workspace, which on a cluster
must be one that all executors see.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import human_size
from lodestar.sources import extract, sinks, tree


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestar", description="Reads a folder, a zip archive or a git address and lists what it holds.")
    p.add_argument("source")
    p.add_argument("--symbols", action="store_true", help="list symbols instead of files")
    p.add_argument("--json", action="store_true", help="one JSON document: source, head, totals, files, skipped paths; with --symbols also the symbols")
    p.add_argument("--limit", type=int, default=50, help="rows to print; 0 for all")
    p.add_argument("--show-skipped", action="store_true", help="list what was skipped and why")
    p.add_argument("--max-size-mb", dest="max_mb", type=float, default=500)
    p.add_argument("--force", action="store_true", help="replace the folder of an earlier clone")
    p.add_argument("--workspace", help="folder for clones; a temporary one on this machine if not given, in local mode only")
    p.add_argument("--timeout", type=int, default=900, help="seconds a clone may take")
    return p


def stage(spark: SparkSession, source: str, kind: str, max_mb: float, workspace: str | None = None, force: bool = False, timeout: int = 900):
    """The files of a source as (path, content, size_bytes), and the commit they are of."""
    head = {"sha": None, "branch": None}
    if kind == "zip":
        files = tree.read_zips(spark, source).drop("archive")
    elif kind == "git":
        if workspace is None and spark.sparkContext.master.split("[")[0] != "local":
            raise tree.IngestError("a clone needs --workspace, a folder that all executors see")
        name = source.rstrip("/").rsplit("/", 1)[-1].rsplit(":", 1)[-1].removesuffix(".git")
        to = os.path.join(workspace or tempfile.mkdtemp(prefix="lodestar-clone-"), name)
        tree.clone(source, to, timeout=timeout, force=force)
        files, head = tree.read_tree(spark, to), tree.head_of(to)
    else:
        files = tree.read_tree(spark, source)
    return tree.enforce_size(files, max_mb), head


def kind_of(source: str) -> str:
    """As functions.text.classify_source, for one name on the driver."""
    if source.startswith(("https://", "http://", "git@", "ssh://", "git://")) or source.endswith(".git"):
        return "git"
    return "zip" if source.lower().endswith(".zip") else "local"


def document(source: str, kind: str, head: dict, tables: dict[str, DataFrame], totals: dict) -> Iterator[str]:
    """The pieces of one JSON document: what it is of, the totals, and every row of the tables."""
    yield json.dumps({"source": source, "kind": kind, **head, **totals})[:-1]
    for name, rows in tables.items():
        yield f', "{name}": ['
        for k, line in enumerate(sinks.as_json(rows).toLocalIterator()):
            yield (", " if k else "") + line.json
        yield "]"
    yield "}"


def print_rows(rows: DataFrame) -> None:
    print("\t".join(rows.columns))
    for r in rows.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in r))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lodestar").getOrCreate()
    try:
        kind = kind_of(a.source)
        staged, head = stage(spark, a.source, kind, a.max_mb, a.workspace, a.force, a.timeout)
        files, skipped = tree.walk(staged)
        if a.json:
            counts, by_reason = tree.inventory_totals(files, skipped)
            totals = counts.first().asDict() | {"skipped_by_reason": {r.reason: r.n for r in by_reason.collect()}}
            tables = {"files": files.drop("content"), "skipped": skipped}
            if a.symbols:
                tables["symbols"] = extract.symbols_of(extract.extract(files)).drop("repo")
            for piece in document(a.source, kind, head, tables, totals):
                sys.stdout.write(piece)
            print()
            return 0
        if a.show_skipped:
            out = skipped
        elif a.symbols:
            out = extract.symbols_of(extract.extract(files)).select("path", "line_start", "kind", "qualname", "complexity")
        else:
            out = files.select("path", "language", "line_count", human_size(F.col("size_bytes")).alias("size"), "module")
        print_rows(out if a.limit <= 0 else out.limit(a.limit))
    except Exception as e:  # noqa: BLE001 - a command reports and exits
        print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
