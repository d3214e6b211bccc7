"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points on a 64-bit ring; a row hashes to the arc in
front of one point and belongs to that point's shard.  A shard holds at most its
capacity: rows overflowing a full shard continue clockwise to the next points
until one belongs to a shard with room.  With ``slack`` = 0 the capacities are
floor or ceil of rows / shards, so counts are at most one apart; a larger slack
moves fewer rows when a shard is added.

Plan: one scan of the texts gives a narrow table (id, size, crc, arc) in the
scratch folder.  Its counts per (arc, sub-bucket) - at most ``arcs * SUBS`` rows
whatever the input - reach the driver, which walks the ring once and cuts each
bucket into runs (shard, first slot).  A window inside (arc, sub-bucket) ranks
rows, and a join with the bounded run table places them.  Sub-buckets come from
the scan's partitions, so not even repeated rows make a large bucket.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.llm.common import stash

VNODES = 64
#: Buckets that each arc is dealt into, so that no window grows with one arc.
SUBS = 16


def ring(n_shards: int, vnodes: int = VNODES, seed: str = "ring") -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise; positions are signed 64-bit."""
    if n_shards < 1 or vnodes < 1:
        raise ValueError("a ring needs at least one shard and one virtual node")
    return sorted((xxhash.xxh64_intdigest(f"{seed}/{s}/{v}") - (1 << 63), s) for s in range(n_shards) for v in range(vnodes))


def capacities(rows: int, nodes: Sequence[tuple[int, int]], n_shards: int, slack: float) -> list[int]:
    """Rows each shard may hold.  At slack 0 the sum is ``rows``; the larger shares go to the shards first on the ring."""
    if slack > 0:
        return [math.ceil(rows / n_shards * (1 + slack))] * n_shards
    order = list(dict.fromkeys(s for _, s in nodes))
    caps = [rows // n_shards] * n_shards
    for s in order[: rows % n_shards]:
        caps[s] += 1
    return caps


def fill(nodes: Sequence[tuple[int, int]], counts: dict[tuple[int, int], int], n_shards: int, slack: float) -> list[tuple[int, int, int, int, int]]:
    """Walk the ring: runs (arc, sub, first rank, shard, first slot).

    Home rows are placed before any overflow, so a row leaves its arc's shard
    only when that shard is full of rows of its own.
    """
    caps = capacities(sum(counts.values()), nodes, n_shards, slack)
    used = [0] * n_shards
    runs, over = [], []

    def place(arc: int, sub: int, rank: int, n: int, shard: int) -> int:
        m = min(n, caps[shard] - used[shard])
        if m > 0:
            runs.append((arc, sub, rank, shard, used[shard]))
            used[shard] += m
        return max(m, 0)

    for (arc, sub), n in sorted(counts.items()):
        m = place(arc, sub, 0, n, nodes[arc][1])
        if m < n:
            over.append((arc, sub, m, n - m))
    free = [i for i, (_, s) in enumerate(nodes) if used[s] < caps[s]]
    for arc, sub, rank, n in over:
        at = bisect.bisect_left(free, arc)
        while n:
            if not free:
                raise AssertionError("capacities are below the number of rows")
            i = free[at % len(free)]
            m = place(arc, sub, rank, n, nodes[i][1])
            rank, n = rank + m, n - m
            if n:
                free = [j for j in free if nodes[j][1] != nodes[i][1]]
                at = bisect.bisect_left(free, arc)
    return runs


def shard_documents(docs: DataFrame, n_shards: int = 8, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """Place every row of ``docs`` (doc_id, text) on one of ``n_shards`` shards.

    Returns doc_id, size (UTF-8 bytes of the text + 1), text_crc32, home (the
    ring's first choice), shard and slot (gapless from 0 in each shard).

    Nulls: a null text has size 1 and the crc of no bytes; a null doc_id hashes
    as an empty string.  Repeated rows each get a slot of their own.  An empty
    table gives an empty result.  Other columns of ``docs`` are ignored.
    """
    nodes = ring(n_shards, vnodes)
    points = np.array([p for p, _ in nodes])

    @F.pandas_udf("int")
    def arc(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, key.to_numpy()) % len(points)).astype("int32")

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    placed = stash(
        docs.select(
            "doc_id",
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"),
            F.pmod(F.spark_partition_id(), F.lit(SUBS)).alias("sub"),
        ).withColumn("arc", arc("key"))
    )
    counts = {(r["arc"], r["sub"]): r["n"] for r in placed.groupBy("arc", "sub").agg(F.count("*").alias("n")).collect()}
    runs: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for at, sub, first, shard, slot in fill(nodes, counts, n_shards, slack):
        runs.setdefault((at, sub), []).append((first, shard, slot))
    table = docs.sparkSession.createDataFrame([(*k, v) for k, v in runs.items()], "arc int, sub int, runs array<struct<first: long, shard: int, slot: long>>")
    rank = F.row_number().over(Window.partitionBy("arc", "sub").orderBy("key", "doc_id", "text_crc32", "size")).cast("long") - 1
    home = F.element_at(F.array(*[F.lit(s) for _, s in nodes]), F.col("arc") + 1)
    run = F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("rank")), -1)
    return (
        placed.withColumn("rank", rank)
        .join(F.broadcast(table), ["arc", "sub"])  # at most arcs * SUBS rows
        .withColumn("run", run)
        .select("doc_id", "size", "text_crc32", home.alias("home"), F.col("run.shard").alias("shard"), (F.col("run.slot") + F.col("rank") - F.col("run.first")).alias("slot"))
    )
