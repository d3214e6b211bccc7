"""Incremental maintenance by micro-batches: a change feed keeps a keyed table current."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skarn.operators.structure import apply_delta, last_event_wins
from skarn.sources import pointers


def change_feed(spark: SparkSession, folder: str, schema: str, fmt: str = "json") -> DataFrame:
    """Events as they arrive as files in ``folder``."""
    return spark.readStream.schema(schema).format(fmt).load(folder)


def split_feed(events: DataFrame, key: str, ts: str) -> tuple[DataFrame, DataFrame]:
    """Changed rows and removed keys of a batch of events (key, ts, type, ...): a key's last event counts."""
    last = last_event_wins(events, key, ts)
    return last.filter("type <> 'removed'"), last.filter("type = 'removed'").select(key)


class KeyedTable:
    """A table of rows by key in versions; a version is complete before the pointer names it.

    ``apply`` is given batches in order, each at least once: a batch whose number
    the pointer already has is skipped, so every batch counts exactly once.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str):
        self.spark, self.folder, self.schema, self.key = spark, folder, schema, key

    def _pointer(self) -> int:
        found = pointers.newest(self.spark, self.folder)
        return -1 if found is None else found[0]

    def read(self) -> DataFrame:
        n = self._pointer()
        return self.spark.createDataFrame([], self.schema) if n < 0 else self.spark.read.schema(self.schema).parquet(f"{self.folder}/v{n}")

    def apply(self, upserts: DataFrame, removed: DataFrame, batch: int) -> None:
        last = self._pointer()
        if batch <= last:
            return
        rows = self.read()
        apply_delta(rows, upserts.select(rows.columns), removed, self.key).write.mode("overwrite").parquet(f"{self.folder}/v{batch}")
        pointers.add(self.spark, self.folder, batch, f"v{batch}")
        pointers.drop_before(self.spark, self.folder, last)  # the version before the last, which a reader may still have, stays


def keep_current(feed: DataFrame, table: KeyedTable, ts: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None, **trigger: object) -> StreamingQuery:
    """Apply a feed (key, ts, type, the table's columns) to ``table``, one micro-batch at a time."""

    def each(events: DataFrame, batch: int) -> None:
        changed, removed = split_feed(events, table.key, ts)
        table.apply(changed, removed, batch)
        if after:
            after(events, batch)

    return feed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def hot_embeddings(notes: DataFrame, stored: DataFrame, longest: int = 8000) -> DataFrame:
    """Notes (id, text, content_hash) and what to do about their vector: keep, embed, or pending if too long."""
    known = stored.select("id", F.col("content_hash").alias("__h"))
    state = F.when(F.col("__h") == F.col("content_hash"), "keep").when(F.char_length("text") > longest, "pending").otherwise("embed")
    return notes.join(known, "id", "left").select("id", state.alias("action"))
