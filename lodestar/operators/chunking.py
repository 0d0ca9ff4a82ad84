"""Chunks of source text for embedding: symbol bodies in overlapping windows, class outlines, module leftovers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.keys import uuid5, with_repo

# Fixed values.
MAX_CHARS = 4000
OVERLAP = 8
MIN_CHARS = 24
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"  # the URL namespace of RFC 9562


def windows(start: Column, end: Column, span_chars: Column) -> Column:
    """array<struct<part, part_count, line_start, line_end>> covering lines start..end, OVERLAP lines shared.

    A span within MAX_CHARS is one window. Else lines per window follow from the average line length: the k-th
    window starts (per - OVERLAP) * k lines after the first.
    """
    lines = end - start + 1
    average = F.greatest(F.lit(1), F.floor(span_chars / F.greatest(lines, F.lit(1)))).cast("int")
    per = F.greatest(F.lit(2 * OVERLAP), F.floor(F.lit(MAX_CHARS) / average)).cast("int")
    n = F.when((span_chars <= MAX_CHARS) | (lines <= per), 1).otherwise(F.ceil((lines - OVERLAP) / (per - OVERLAP))).cast("int")
    step = F.when(n == 1, 0).otherwise(per - OVERLAP)
    stop = lambda k: F.when(n == 1, end).otherwise(F.least(end, start + k * step + per - 1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("part"), n.alias("part_count"), (start + k * step).cast("int").alias("line_start"), stop(k).cast("int").alias("line_end")))


def slice_lines(lines: Column, start: Column, end: Column) -> Column:
    """Lines start..end, counted from 1, joined."""
    first = F.greatest(start, F.lit(1))
    return F.array_join(F.slice(lines, first, F.greatest(end - first + 1, F.lit(0))), "\n")


def header(path: Column, module: Column, extra: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("File: "), path), F.concat(F.lit("Module: "), F.nullif(module, F.lit(""))), F.nullif(extra, F.lit("")))


def symbol_chunks(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks of functions and methods. files: (path, module, lines); symbols: (path, qualname, kind, line_start, line_end, …)."""
    symbols, files = with_repo(symbols, files)
    joined = symbols.where("kind <> 'class'").drop("module").join(files.select("repo", "path", "module", "lines"), ["repo", "path"])
    body = slice_lines(F.col("lines"), F.col("line_start"), F.col("line_end"))
    # The length is a column of its own, so that windows() does not build the body again at each mention.
    cut = joined.withColumn("chars", F.length(body)).withColumn("w", F.explode(windows(F.col("line_start"), F.col("line_end"), F.col("chars"))))
    part = F.when(F.col("w.part_count") > 1, F.format_string(" (part %d of %d)", F.col("w.part") + 1, F.col("w.part_count"))).otherwise("")
    text = F.concat(header(F.col("path"), F.col("module"), F.concat_ws(": ", "kind", "qualname")), part, F.lit("\n\n"), slice_lines(F.col("lines"), F.col("w.line_start"), F.col("w.line_end")))
    return cut.select("repo", "path", "module", "qualname", "name", "kind", "w.line_start", "w.line_end", "w.part", "w.part_count", text.alias("text"))


def class_outlines(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """A class up to the line before its first member, and the heads of its members."""
    symbols, files = with_repo(symbols, files)
    members = symbols.where(F.col("parent").isNotNull()).select("repo", "path", F.col("parent").alias("qualname"), F.col("line_start").alias("m"), F.concat(F.when(F.col("is_async"), "    async def ").otherwise("    def "), "name", F.lit("("), F.array_join(F.transform("parameters", lambda p: p["name"]), ", "), F.lit(")")).alias("head"))
    classes = symbols.where("kind = 'class'").drop("module").join(files.select("repo", "path", "module", "lines"), ["repo", "path"])
    grouped = classes.select("repo", "path", "qualname", F.col("line_start").alias("c")).join(members, ["repo", "path", "qualname"]).groupBy("repo", "path", "qualname").agg(F.min(F.when(F.col("m") > F.col("c"), F.col("m"))).alias("first"), F.array_sort(F.collect_list(F.struct("m", "head"))).alias("heads"))
    outlined = classes.join(grouped, ["repo", "path", "qualname"], "left").withColumn("stop", F.coalesce(F.col("first") - 1, F.col("line_end")))
    bases = F.when(F.size(F.coalesce("base_classes", F.array().cast("array<string>"))) > 0, F.concat(F.lit("("), F.array_join("base_classes", ", "), F.lit(")"))).otherwise("")
    listed = F.when(F.col("heads").isNotNull(), F.concat(F.lit("\n\n    # methods:\n"), F.array_join(F.transform("heads", lambda h: h["head"]), "\n"))).otherwise("")
    text = F.concat(header(F.col("path"), F.col("module"), F.concat(F.lit("class: "), "qualname", bases)), F.lit("\n\n"), slice_lines(F.col("lines"), F.col("line_start"), F.col("stop")), listed)
    return outlined.select("repo", "path", "module", "qualname", "name", "kind", "line_start", F.col("stop").cast("int").alias("line_end"), F.lit(0).alias("part"), F.lit(1).alias("part_count"), text.alias("text"))


def leftover(files: DataFrame, covered: DataFrame) -> DataFrame:
    """One chunk a file of the non-blank lines under no symbol, cut at MAX_CHARS. covered: (path, line_start, line_end).

    The spans of a file travel as one array to its lines, so nothing joins line by line.
    """
    files, covered = with_repo(files, covered)
    spans = covered.groupBy("repo", "path").agg(F.collect_list(F.struct("line_start", "line_end")).alias("spans"))
    numbered = F.transform("lines", lambda t, i: F.struct((i + 1).alias("number"), t.alias("text")))
    free = lambda x: (F.trim(x["text"]) != "") & ~F.exists(F.coalesce("spans", F.array().cast("array<struct<line_start:int,line_end:int>>")), lambda s: x["number"].between(s["line_start"], s["line_end"]))
    rest = files.join(spans, ["repo", "path"], "left").withColumn("free", F.filter(numbered, free)).where(F.size("free") > 0)
    body = F.left(F.array_join(F.transform("free", lambda x: x["text"]), "\n"), F.lit(MAX_CHARS))
    text = F.concat(header(F.col("path"), F.col("module"), F.lit("module-level code")), F.lit("\n\n"), body)
    name = F.substring_index("path", "/", -1)
    return rest.select("repo", "path", "module", F.lit(None).cast("string").alias("qualname"), name.alias("name"), F.lit("module").alias("kind"), F.element_at("free", 1)["number"].alias("line_start"), F.element_at("free", -1)["number"].alias("line_end"), F.lit(0).alias("part"), F.lit(1).alias("part_count"), text.alias("text"))


def chunk(files: DataFrame, symbols: DataFrame, repo: str | None = None, namespace: str = NAMESPACE) -> DataFrame:
    """All chunks with id, sha256, tokens and is_split; those of under MIN_CHARS are dropped. files: (repo, path, module, text).

    repo names the repository of tables that are of one and do not say which.
    """
    if repo is not None:
        files, symbols = files.withColumn("repo", F.lit(repo)), symbols.withColumn("repo", F.lit(repo))
    files, symbols = with_repo(files, symbols)
    split = files.select("repo", "path", "module", F.split(F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), "\n$", ""), "\n").alias("lines"))
    bodies, outlines = symbol_chunks(symbols, split), class_outlines(symbols, split)
    spans = symbols.where("kind <> 'class'").select("repo", "path", "line_start", "line_end").union(outlines.select("repo", "path", "line_start", "line_end"))
    every = bodies.unionByName(outlines).unionByName(leftover(split, spans)).where(F.length(F.trim("text")) >= MIN_CHARS)
    name = F.concat_ws("|", "repo", "path", F.coalesce("qualname", F.lit("")), F.col("line_start").cast("string"), F.col("part").cast("string"))
    return every.select("*", uuid5(namespace, name).alias("id"), F.sha2("text", 256).alias("sha256"), estimated_tokens(F.col("text")).alias("tokens"), (F.col("part_count") > 1).alias("is_split"))


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")
