"""Literal search through an inverted index of trigrams: few candidates are read and verified, instead of every row.

Each row's searched columns, in lower case, are cut into trigrams; a posting is (gram, key). Postings lie in buckets by gram and
rows in shards by key, so a query reads the buckets of a few of its grams and the shards of its candidates. The grams it takes
are its rarest `PREFIX` ones, as counted when the index was built: any row with the literal has them all, and rare ones
leave few others. What the candidates hold is compared with the literal itself, so rows are those of a scan.

A literal of under three characters has no gram and is looked for in all rows. Rows whose key is null can't be indexed and
are refused; null columns hold nothing; keys that repeat are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = 3
BUCKETS, SHARDS = 64, 64


def grams(text: Column) -> Column:
    """The distinct trigrams of a lower-cased text, from its characters, so that long texts stay linear."""
    return F.element_at(
        F.transform(F.array(F.filter(F.split(F.lower(text), ""), lambda c: c != "")), lambda cs: F.when(F.size(cs) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(cs) - 2), lambda i: F.concat(F.element_at(cs, i), F.element_at(cs, i + 1), F.element_at(cs, i + 2))))).otherwise(F.array().cast("array<string>"))),
        1,
    )


def _of_query(query: str) -> list[str]:
    q = query.lower()
    return sorted({q[i : i + 3] for i in range(len(q) - 2)})


def build(rows: DataFrame, columns: list[str], path: str, key: str = "key") -> None:
    """Writes the index of the rows' columns below path."""
    checked = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"{key} is null")).cast(rows.schema[key].dataType)).otherwise(F.col(key))
    sharded = rows.withColumn("__shard", F.pmod(F.xxhash64(checked), F.lit(SHARDS)).cast("int"))
    sharded.repartitionByRange("__shard", key).write.partitionBy("__shard").parquet(f"{path}/rows")
    every = F.array_distinct(F.flatten(F.array(*[grams(F.coalesce(c, F.lit(""))) for c in columns])))
    # A row makes many postings: rows are dealt first, so that no task holds those of a whole file of them, and repeats meet there.
    dealt = rows.repartition(SHARDS, key)
    postings = dealt.select(F.col(key).alias("key"), F.explode(every).alias("gram")).distinct()
    postings = postings.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int"))
    postings.repartitionByRange(BUCKETS, "bucket", "gram", "key").sortWithinPartitions("bucket", "gram", "key").write.partitionBy("bucket").parquet(f"{path}/postings")
    written = rows.sparkSession.read.parquet(f"{path}/postings")
    counts = written.groupBy("bucket", "gram").agg(F.count("*").alias("n"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """(key): the rows that hold the query's rarest grams; None where the query has no gram."""
    asked = _of_query(query)
    if not asked:
        return None
    of = spark.createDataFrame([(g,) for g in asked], "gram string").select("gram", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int").alias("bucket")).collect()
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    within = lambda df, rows: df.where(F.col("bucket").isin([r.bucket for r in rows]) & F.col("gram").isin([r.gram for r in rows]))
    counts = {r.gram: r.n for r in within(read("counts"), of).collect()}  # a row a gram of the query
    postings = read("postings")
    if len(counts) < len(asked):
        return postings.select("key").limit(0)
    rare = sorted(of, key=lambda r: (counts[r.gram], r.gram))[:PREFIX]
    return within(postings, rare).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(rare)).select("key")


def search(spark: SparkSession, path: str, query: str, columns: list[str], key: str = "key") -> DataFrame:
    """The indexed rows with the query as a literal, in any case, in one of the columns."""
    rows, found = spark.read.parquet(f"{path}/rows"), candidates(spark, path, query)
    if found is not None:
        found = found.select(F.col("key").alias("__key"), F.pmod(F.xxhash64("key"), F.lit(SHARDS)).cast("int").alias("__shard"))
        shards = [r[0] for r in found.select("__shard").distinct().collect()]  # SHARDS numbers at most
        some = rows.where(F.col("__shard").isin(shards))
        rows = some.join(found.select("__key"), some[key] == F.col("__key"), "left_semi")
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower(F.lit(query)))
    return rows.where(hit).drop("__shard")
