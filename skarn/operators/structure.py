"""Relational operators of the index: counts, resolution cascades, range joins, snapshots, deltas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.operators.graph import materialise


def first_wins(rows: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def positions(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with position, from 0 in the order of columns that tell them apart: ranges are counted, then ranked each for itself."""
    dealt = materialise(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    counts = dealt.groupBy("__p").agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))  # over as many rows as there are partitions
    first = counts.select("__p", F.coalesce(before, F.lit(0)).alias("__first"))
    rank = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return dealt.withColumn("__r", rank).join(F.broadcast(first), "__p").withColumn("position", F.col("__first") + F.col("__r")).drop("__p", "__r", "__first")


def last_event_wins(events: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The latest event of each key, by a max of (order, row): aggregated before the shuffle."""
    rest = [c for c in events.columns if c != key]
    picked = F.max_by(F.struct(*rest), F.struct(*order))
    return events.groupBy(key).agg(picked.alias("__r")).select(key, "__r.*")


def file_counts(files: DataFrame, symbols: DataFrame, key: str = "file_id") -> DataFrame:
    """Files with counts of their symbols: functions, classes (with interfaces), others, total; zero without any."""
    kind = F.col("kind")
    counts = symbols.groupBy(key).agg(
        F.count_if(kind == "function").alias("functions"),
        F.count_if(kind.isin("class", "interface")).alias("classes"),
        F.count_if(~kind.isin("function", "class", "interface")).alias("others"),
        F.count("*").alias("total"),
    )
    return files.join(counts, key, "left").fillna(0, ["functions", "classes", "others", "total"])


def coverage(files: DataFrame, language: str = "language") -> DataFrame:
    """By language: eligible and parsed files, symbols, files with errors; unsupported ones are left out."""
    return (
        files.filter(F.col(language) != "unsupported")
        .groupBy(language)
        .agg(F.count("*").alias("eligible"), F.count_if(~F.col("has_error")).alias("parsed"), F.count_if("has_error").alias("failed"), F.sum(F.when(~F.col("has_error"), F.col("symbols")).otherwise(0)).alias("symbols"))
    )


def resolve_by_priority(calls: DataFrame, tiers: Sequence[tuple[str, DataFrame]], key: str, target: str = "target") -> DataFrame:
    """All candidates of each call in the best tier that has any: key, tier, target.

    Each tier, best first, is a column of ``calls`` and the table (that column,
    target) that it is looked up in.  A call's tier is known from the different
    values alone, so only the candidates of the best are made, and they are not
    shuffled.  Calls without a candidate come back with nulls.
    """
    has = [f"__has{n}" for n in range(len(tiers))]
    known = calls
    for flag, (on, table) in zip(has, tiers, strict=True):
        known = known.join(table.filter(F.col(target).isNotNull()).select(on).distinct().withColumn(flag, F.lit(True)), on, "left")
    known = known.withColumn("tier", F.coalesce(*[F.when(F.col(flag), F.lit(n)) for n, flag in enumerate(has, 1)]))
    out = known.filter("tier is null").select(key, "tier", F.lit(None).cast(tiers[0][1].schema[target].dataType).alias(target))
    for n, (on, table) in enumerate(tiers, 1):
        out = out.unionByName(known.filter(F.col("tier") == n).join(table.filter(F.col(target).isNotNull()), on).select(key, "tier", target))
    return out


def bucketed_points(points: DataFrame, intervals: DataFrame, on: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Interval join start <= at <= end within ``on``, as an equi-join on buckets of ``width``.

    A hot ``on`` spreads over its buckets, and Spark can hash and split it; the
    plain condition would compare every point of a key with every interval.
    """
    p = points.withColumn("__b", F.floor(F.col(at) / width))
    i = intervals.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return p.join(i, [on, "__b"]).filter((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end))).drop("__b")


def owning_interval(points: DataFrame, intervals: DataFrame, on: str, at: str, start: str, end: str, point_key: str, interval_key: str, width: int = 64) -> DataFrame:
    """For each point the narrowest interval that holds it (ties: smallest key)."""
    held = bucketed_points(points, intervals, on, at, start, end, width)
    return held.groupBy(point_key).agg(F.min_by(interval_key, F.struct(F.col(end) - F.col(start), F.col(interval_key))).alias(interval_key))


def overlapping(spans: DataFrame, hunks: DataFrame, on: str, span_key: str, start: str, end: str, h_start: str, h_end: str, width: int = 64) -> DataFrame:
    """Spans that overlap a hunk of the same ``on``; spans of an ``on`` without hunks are all kept if it is listed with nulls."""
    s = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    known = hunks.filter(F.col(h_start).isNotNull())
    h = known.withColumn("__b", F.explode(F.sequence(F.floor(F.col(h_start) / width), F.floor(F.col(h_end) / width)))).select(on, "__b", h_start, h_end)
    hit = s.join(h, (s[on] == h[on]) & (s["__b"] == h["__b"]) & (s[start] <= h[h_end]) & (s[end] >= h[h_start]), "left_semi").select(span_key).distinct()
    whole = spans.join(hunks.filter(F.col(h_start).isNull()).select(on), on, "left_semi").select(span_key)
    return hit.union(whole).distinct()


def manifest_diff(previous: DataFrame, discovered: DataFrame, key: str = "path") -> DataFrame:
    """key and change (added, changed, removed, unchanged) by size and time of two snapshots (key, size, mtime)."""
    p = previous.select(key, F.col("size").alias("__s0"), F.col("mtime").alias("__m0"), F.lit(True).alias("__p"))
    d = discovered.select(key, F.col("size").alias("__s1"), F.col("mtime").alias("__m1"), F.lit(True).alias("__d"))
    same = F.col("__s0").eqNullSafe(F.col("__s1")) & F.col("__m0").eqNullSafe(F.col("__m1"))
    change = F.when(F.col("__p").isNull(), "added").when(F.col("__d").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return p.join(d, key, "full_outer").select(key, change.alias("change"))


def apply_delta(base: DataFrame, upserts: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """``base`` without removed and replaced keys, with the upserts."""
    touched = upserts.select(key).union(removed.select(key))
    return base.join(touched, key, "left_anti").unionByName(upserts)


def override(rows: DataFrame, precise: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``precise`` rows and those of ``rows`` whose keys they don't have."""
    return rows.join(precise.select(*keys), list(keys), "left_anti").unionByName(precise)


def evict(handles: DataFrame, now: Column, ttl_days: int = 7, most: int = 50, protected: Column | None = None, key: str = "handle") -> DataFrame:
    """Handles to keep: no older than the TTL and among the newest ``most``; protected ones stay ahead."""
    safe = F.lit(False) if protected is None else protected
    fresh = handles.withColumn("__safe", safe).filter(F.col("__safe") | (F.col("created_at") >= now - F.expr(f"INTERVAL {ttl_days} DAYS")))
    return fresh.orderBy(F.desc("__safe"), F.desc("created_at"), F.desc(key)).limit(most).drop("__safe")


def forward_fill(lines: DataFrame, value: Column, name: str, partition: Sequence[str], order: str) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.last(value, ignorenulls=True).over(w))


def risk(count: Column, high: int = 8, medium: int = 4) -> Column:
    return F.when(count >= high, "alto").when(count >= medium, "medio").otherwise("baixo")


def symbol_weight(name: Column, references: Column, definitions: Column) -> Column:
    """How telling a name is: long, public, seldom defined, often used."""
    long = F.when(F.char_length(name) >= 8, 10.0).otherwise(1.0)
    private = F.when(F.startswith(name, F.lit("_")), 0.1).otherwise(1.0)
    common = F.when(definitions > 5, 0.1).otherwise(1.0)
    return F.greatest(F.lit(0.001), long * private * common * F.sqrt(references.cast("double")))
