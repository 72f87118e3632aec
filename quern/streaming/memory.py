"""A keyed store whose state lives in a stream: the latest value of each key, its tags, overwrites and expiry.

Every key has a value state (its latest write and how often it was written) and a map state (how often each tag came), both
in the stream's state store, so a restarted query goes on from its checkpoint. Writes may arrive in any order: the latest by
their own order wins, whatever came last. With a lifetime, a timer in event time forgets a key that has not been written
for that long.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_OUT = "key string, value string, tags array<string>, micros long, id long, versions long, overwrote boolean, tag_counts map<string,long>, status string"
OUT = _OUT.replace("micros long", "at timestamp")


class Memory(StatefulProcessor):
    """Takes rows of (key, value, tags, at, id); gives a row for each key that was written, and for each that expired."""

    def __init__(self, lifetime: timedelta | None = None):
        self.lifetime = lifetime

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "value string, tags array<string>, micros long, id long, versions long")
        self.tags = handle.getMapState("tags", "tag string", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = self.now.get() if self.now.exists() else None
        best, versions = (tuple(old[:4]), old[4]) if old else (None, 0)
        counts: dict[str, int] = {}
        for r in rows:
            versions += 1
            new = (r.value, list(r.tags or []), r.micros, r.id)
            if best is None or new[2:] > best[2:]:
                best = new
            for t in set(new[1]):
                counts[t] = counts.get(t, 0) + 1
        for t, n in counts.items():
            self.tags.updateValue((t,), ((self.tags.getValue((t,))[0] if self.tags.containsKey((t,)) else 0) + n,))
        self.now.update((*best, versions))
        if self.lifetime:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(best[2] // 1000 + int(self.lifetime.total_seconds() * 1000))
        yield self._row(key[0], best, versions, "stored")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        old = self.now.get()
        row = self._row(key[0], tuple(old[:4]), old[4], "expired")
        self.now.clear()
        self.tags.clear()
        yield row

    def _row(self, key: str, best: tuple, versions: int, status: str) -> Row:
        value, tags, micros, number = best
        seen = {k[0]: v[0] for k, v in self.tags.iterator()}
        return Row(key=key, value=value, tags=list(tags), micros=micros, id=number, versions=versions, overwrote=versions > 1, tag_counts=seen, status=status)

    def close(self) -> None:
        pass


def remember(writes: DataFrame, lifetime: timedelta | None = None, late: str = "0 seconds") -> DataFrame:
    """Changes of the store, in update mode. writes: a stream of key, value, tags, at (timestamp) and id, which tells equal times apart.

    Rows without a key or a time are left out; null tags count as none. With a lifetime, writes that come later than the
    watermark allows are left out, and a key expires when the watermark passes its latest write by the lifetime. Other
    columns are ignored. The session's state store must be the RocksDB one (PROVIDER).
    """
    rows = writes.where("key is not null and at is not null").select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "tags", F.col("at").cast("timestamp").alias("at"), F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"))
    if lifetime:
        rows = rows.withWatermark("at", late)
    rows = rows.withColumn("micros", F.unix_micros("at"))
    changes = rows.groupBy("key").transformWithState(statefulProcessor=Memory(lifetime), outputStructType=_OUT, outputMode="Update", timeMode="EventTime" if lifetime else "None")
    return changes.withColumn("micros", F.timestamp_micros("micros")).withColumnRenamed("micros", "at")


def keep(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch of changes to a folder of its own, so that a batch that is run again replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number:09d}")

    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, path: str) -> DataFrame:
    """The store as of the batches written: each key's last change, if that isn't its expiry."""
    changes = spark.read.schema(OUT + ", batch long").parquet(path)
    last = F.max_by(F.struct("value", "tags", "versions", "overwrote", "tag_counts", "status"), F.struct("batch", F.when(F.col("status") == "stored", 1).otherwise(0))).alias("s")
    return changes.groupBy("key").agg(last).where("s.status = 'stored'").select("key", "s.value", "s.tags", "s.versions", "s.overwrote", "s.tag_counts")


def tagged(store: DataFrame, tag: str) -> DataFrame:
    return store.where(F.array_contains("tags", tag))
