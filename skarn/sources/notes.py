"""Markdown notes with front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.text import note_id

FIELDS = ("type", "scope", "source", "confidence", "observed_at", "valid_from", "valid_until", "superseded_by", "supersedes", "stale_reason", "contradiction_reason", "created_at", "updated_at")
# The domains of the front matter.  The scope org is reserved: a note that claims it keeps it and is never read.
SCOPES = ("project", "user", "session", "agent", "org")
SOURCES = ("direct_capture", "agent_inference", "v1_migration", "document_import")
CONFIDENCES = ("confirmed", "inferred", "presumed")
TYPES = ("inbox", "decision", "meeting", "entity", "project", "reference")


def read_vault(spark: SparkSession, root: str) -> DataFrame:
    """path and content of every .md file below ``root``."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return raw.select(F.regexp_replace(F.regexp_replace("_metadata.file_path", "^file:/*", "/"), f"^{root.rstrip('/')}/", "").alias("path"), F.col("value").alias("content"))


def _list(value: Column) -> Column:
    """``[a, b]`` or ``a, b``"""
    bare = F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s*\[|\]\s*$", "")
    return F.filter(F.transform(F.split(bare, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")), lambda x: x != "")


def parse(files: DataFrame) -> DataFrame:
    """Notes of files (path, content): id, title, tags, links, text and the fields of the front matter; a note without a type lies in the inbox."""
    head = F.regexp_extract("content", r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?", 1)
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^\s*[A-Za-z_]\w*\s*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:\s*", "")).alias("v")))
    # of repeated keys the last one holds
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    table = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))
    body = F.regexp_replace("content", r"(?s)^---\r?\n.*?\r?\n---\r?\n?", "")
    held = files.withColumns({"__m": table, "text": body})
    value = lambda k: F.nullif(F.regexp_replace(F.trim(F.try_element_at(F.col("__m"), F.lit(k))), "^[\"']|[\"']$", ""), F.lit(""))
    title = F.coalesce(value("title"), F.nullif(F.regexp_extract("text", r"(?m)^# +(.+)$", 1), F.lit("")), F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), r"\.md$", ""))
    return held.select(note_id(F.col("path"), F.col("content")).alias("id"), "path", title.alias("title"), _list(value("tags")).alias("tags"), _list(value("links")).alias("links"), "text", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"), *[(F.coalesce(value(k), F.lit("inbox")) if k == "type" else value(k)).alias(k) for k in FIELDS])


def normalise(notes: DataFrame) -> DataFrame:
    """Fields within their domains, times as timestamps; ``warnings`` names what was replaced."""
    legacy = F.col("scope").isNull() & F.col("source").isNull() & F.col("confidence").isNull()
    checks = {"scope": (SCOPES, F.lit("project")), "source": (SOURCES, F.when(legacy, "v1_migration").otherwise("direct_capture")), "confidence": (CONFIDENCES, F.lit("presumed"))}
    warn = F.array(*[F.when(F.col(k).isNotNull() & ~F.col(k).isin(*allowed), F.lit(f"E_MEMORY_V2_{k.upper()}")) for k, (allowed, _) in checks.items()])
    out = notes.withColumn("warnings", F.filter(warn, lambda w: w.isNotNull()))
    out = out.withColumns({k: F.when(F.col(k).isin(*allowed), F.col(k)).otherwise(default) for k, (allowed, default) in checks.items()})
    return out.withColumns({k: F.try_to_timestamp(F.col(k)) for k in ("observed_at", "valid_from", "valid_until", "created_at", "updated_at")})


def render(meta: dict[str, object], body: str) -> str:
    """A note's file: front matter in the order given, then the body."""
    rows = [f"{k}: [{', '.join(v)}]" if isinstance(v, (list, tuple)) else f"{k}: {v}" for k, v in meta.items() if v not in (None, "", [], ())]
    return "---\n" + "\n".join(rows) + f"\n---\n{body}"
