"""Schemas of the index and the memory, and the settings a session needs."""

from __future__ import annotations

from pyspark.sql import SparkSession

FILES = "path string, language string, content string, content_hash string, size long, mtime timestamp, errors array<string>"
SYMBOLS = "id string, path string, name string, kind string, start_line int, end_line int, exported boolean"
EDGES = "path string, kind string, from_symbol string, target string, target_name string, line int, source string"
IMPORTS = "path string, source string, names array<string>, resolved_path string"
NOTES = (
    "id string, path string, title string, tags array<string>, links array<string>, text string, content_hash string, type string, scope string, source string, confidence string, "
    "observed_at timestamp, valid_from timestamp, valid_until timestamp, superseded_by string, supersedes string, stale_reason string, contradiction_reason string, created_at timestamp, updated_at timestamp"
)
VECTORS = "id string, content_hash string, scale double, codes array<int>"


def session(name: str = "skarn", master: str | None = None) -> SparkSession:
    """A session with the settings that the operators expect: adaptive plans, UTC, Arrow."""
    b = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    return (b.master(master) if master else b).getOrCreate()
