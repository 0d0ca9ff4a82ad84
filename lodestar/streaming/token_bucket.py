"""Token buckets: rate limits per client, over a table or a stream of requests (client, at seconds)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# Requests at once and per minute.
LIMITS = {"chat": (10, 4.0), "explain": (20, 6.0), "search": (60, 15.0)}


def check(requests: DataFrame, capacity: float, per_minute: float) -> DataFrame:
    """(client, id, at, allowed, wait): every request decided in order of time, then id, client by client.

    wait is in seconds and null where a request is allowed. A client's state depends on all its earlier requests,
    so they are folded in one task, as a stream: memory holds one client's state, whatever its number of requests.
    """
    rate = per_minute / 60.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, tokens, updated = object(), 0.0, 0.0
        for batch in batches:
            allowed, wait = [], []
            for c, at in zip(batch["client"].tolist(), batch["at"].tolist(), strict=True):
                if c != client:
                    client, tokens, updated = c, float(capacity), at
                tokens, updated = min(float(capacity), tokens + max(0.0, at - updated) * rate), at
                ok = tokens >= 1.0
                tokens -= ok
                allowed.append(ok)
                wait.append(None if ok else max(1.0, (1.0 - tokens) / rate) if rate else 60.0)
            yield batch.assign(allowed=allowed, wait=pd.Series(wait, dtype="float64"))

    rows = requests.select(F.col("client").cast("string").alias("client"), "id", F.col("at").cast("double").alias("at"))
    # Clients are dealt by hash and sorted by Spark, which spills; the fold then needs no group in memory.
    return rows.repartition("client").sortWithinPartitions("client", "at", "id").mapInPandas(run, "client string, id long, at double, allowed boolean, wait double")


def check_stream(requests: DataFrame, capacity: float, per_minute: float, idle_ms: int = 3_600_000) -> DataFrame:
    """The same decisions over a stream, in arrival order within a client.

    The state of clients idle for idle_ms is dropped; with 0 it is kept, which a query that is to end by itself
    needs (a timeout on processing time always schedules another batch).
    """
    rate = per_minute / 60.0

    def fold(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        tokens, updated = state.get if state.exists else (float(capacity), None)
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        out = []
        for at in rows["at"]:
            tokens = min(float(capacity), tokens + max(0.0, at - (at if updated is None else updated)) * rate)
            updated, ok = at, tokens >= 1.0
            tokens -= ok
            out.append((ok, None if ok else max(1.0, (1.0 - tokens) / rate) if rate else 60.0))
        state.update((tokens, updated))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield rows.assign(allowed=[o for o, _ in out], wait=pd.Series([w for _, w in out], index=rows.index, dtype="float64"))[["client", "id", "at", "allowed", "wait"]]

    return requests.groupBy("client").applyInPandasWithState(fold, "client string, id long, at double, allowed boolean, wait double", "tokens double, updated double", "append", "ProcessingTimeTimeout" if idle_ms else "NoTimeout")


DECISIONS = "client string, id long, at double, allowed boolean, wait double"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Buckets(StatefulProcessor):
    """A bucket for each client. A timer drops it at the event time at which it would be full again: a new bucket is full too,
    so the state of idle clients ends and no decision changes."""

    def __init__(self, capacity: float, per_minute: float):
        self.capacity, self.rate = float(capacity), per_minute / 60.0

    def init(self, handle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "tokens double, updated double, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tokens, updated, due = self.bucket.get() if self.bucket.exists() else (self.capacity, None, None)
        arrived = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        allowed, wait = [], []
        for at in arrived["at"].tolist():
            tokens = min(self.capacity, tokens + max(0.0, at - (at if updated is None else updated)) * self.rate)
            updated, ok = at, tokens >= 1.0
            tokens -= ok
            allowed.append(ok)
            wait.append(None if ok else max(1.0, (1.0 - tokens) / self.rate) if self.rate else 60.0)
        if due is not None:
            self.handle.deleteTimer(due)
        if self.rate:
            due = int((updated + self.capacity / self.rate) * 1000) + 1
            self.handle.registerTimer(due)
        self.bucket.update((tokens, updated, due))
        yield pd.DataFrame({"client": key[0], "id": arrived["id"].to_numpy(), "at": arrived["at"].to_numpy(), "allowed": allowed, "wait": pd.Series(wait, dtype="float64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.bucket.clear()
        return iter(())

    def close(self) -> None:
        pass


def decide_stream(requests: DataFrame, capacity: float, per_minute: float, late: str = "1 hour") -> DataFrame:
    """check() over a stream of (client, id, time timestamp), whose rows come at most `late` after newer ones.

    A trigger's requests of one client are decided in order of time; the trigger bounds how many these are. The query needs
    the RocksDB state store (`ROCKSDB`).
    """
    rows = requests.select(F.col("client").cast("string").alias("client"), "id", (F.unix_micros("time") / 1e6).alias("at"), "time").withWatermark("time", late)
    return rows.groupBy("client").transformWithStateInPandas(Buckets(capacity, per_minute), DECISIONS, "Append", "EventTime")


def run_stream(requests: DataFrame, capacity: float, per_minute: float, path: str, timeout: int = 600) -> DataFrame:
    """The decisions about all that a stream has now, written below path in batches that are each visible once."""
    spark, key = requests.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        query = decide_stream(requests, capacity, per_minute).writeStream.format("parquet").option("path", f"{path}/decisions").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        if not query.awaitTermination(timeout):
            query.stop()
            raise TimeoutError(f"the stream has not ended in {timeout} s")
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return spark.read.schema(DECISIONS).parquet(f"{path}/decisions")
