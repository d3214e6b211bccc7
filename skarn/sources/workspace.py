"""Workspaces: file discovery, manifests, ignore rules, and what version control says has changed."""

from __future__ import annotations

import fnmatch
import os
import subprocess
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.text import IGNORED_FOLDERS, is_ignored
from skarn.operators.structure import last_event_wins

MAX_FILE_BYTES, MAX_FILES = 2 << 20, 50_000


def discover(spark: SparkSession, root: str, max_bytes: int = MAX_FILE_BYTES, max_files: int = MAX_FILES, ignored: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Files (path, content, size, mtime) below ``root``, sorted by path, and limitations (code, path).

    Ignored folders and suffixes are skipped; files over ``max_bytes`` are named
    as MAX_FILE_SIZE, and what lies beyond ``max_files`` as MAX_FILE_COUNT.
    ``ignored`` has further patterns in the manner of an ignore file.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    prefix = f".*?{base.lstrip('/').replace('.', '[.]')}/"
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{prefix}", "")
    rows = raw.select(path.alias("path"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    rows = rows.unionByName(_dotted(spark, root, max_bytes, max_files)).filter(~is_ignored(F.col("path")))
    for pattern in ignored if ignored is not None else ignore_patterns(root):
        rows = rows.filter(~F.col("path").rlike(_regex(pattern)))
    small = rows.filter(F.col("size") <= max_bytes)
    large = rows.filter(F.col("size") > max_bytes).select(F.lit("MAX_FILE_SIZE").alias("code"), "path")
    kept = small.join(F.broadcast(small.select("path").orderBy("path").limit(max_files)), "path", "left_semi")  # names alone are sorted and cut: at most ``max_files``
    beyond = small.select("path").orderBy("path").offset(max_files).limit(1).select(F.lit("MAX_FILE_COUNT").alias("code"), F.lit(None).cast("string").alias("path"))
    return kept.withColumn("content", F.expr("try_validate_utf8(cast(content as string))")), large.unionByName(beyond)


def _dotted(spark: SparkSession, root: str, max_bytes: int, max_files: int) -> DataFrame:
    """Files whose names Spark's listing hides, such as ``__init__.py``: read by the driver, within the same caps."""
    rows = []
    for at, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if f not in IGNORED_FOLDERS)
        hidden = any(part[:1] in "._" for part in Path(at).relative_to(root).parts)
        for name in sorted(names):
            file = Path(at, name)
            if (hidden or name[:1] in "._") and len(rows) <= max_files and file.is_file() and not file.is_symlink():
                stat = file.stat()
                content = bytearray(file.read_bytes()) if stat.st_size <= max_bytes else None
                rows.append((file.relative_to(root).as_posix(), content, stat.st_size, datetime.fromtimestamp(stat.st_mtime)))
    return spark.createDataFrame(rows, "path string, content binary, size long, mtime timestamp")


def ignore_patterns(root: str) -> list[str]:
    file = Path(root, ".gitignore")
    return [x.strip() for x in file.read_text(errors="replace").splitlines() if x.strip() and not x.startswith(("#", "!"))] if file.is_file() else []


def _regex(pattern: str) -> str:
    """A pattern of an ignore file as a regular expression over relative paths."""
    folder, anchored = pattern.endswith("/"), "/" in pattern.rstrip("/")
    body = fnmatch.translate(pattern.strip("/")).removeprefix("(?s:").rsplit(")", 1)[0].replace(".*", "[^/]*")
    return f"{'^' if anchored else '(^|/)'}{body}{'/' if folder else '(/|$)'}"


def manifest(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"), "size", "mtime").orderBy("path")


def manifest_hash(rows: DataFrame) -> DataFrame:
    """One row: a digest of the manifest in the order of its paths (of as many rows as a workspace has files)."""
    line = F.concat_ws("\u0000", "path", "content_hash")
    return rows.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n").cast("binary"), 256).alias("digest"))


def explicit_delta(events: DataFrame, root: str) -> DataFrame:
    """path and change (changed or removed) of events (ts, path, type): the last event of a path wins, others' folders are dropped."""
    inside = events.filter(F.startswith("path", F.lit(root.rstrip("/") + "/")))
    last = last_event_wins(inside.select("path", "ts", "type"), "path", "ts", F.when(F.col("type") == "removed", 0).otherwise(1))
    return last.select(F.substring("path", len(root.rstrip("/")) + 2, 1 << 20).alias("path"), F.when(F.col("type") == "removed", "removed").otherwise("changed").alias("change"))


def git_delta(spark: SparkSession, root: str, ref: str) -> DataFrame | None:
    """path and change since ``ref`` with untracked files; None if version control has no answer."""
    run = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True)
    diff, new = run("diff", "--name-status", "--no-renames", ref), run("ls-files", "--others", "--exclude-standard")
    if diff.returncode or new.returncode:
        return None
    rows = [(p, "removed" if s.startswith("D") else "changed") for s, _, p in (x.partition("\t") for x in diff.stdout.splitlines())]
    rows += [(p, "changed") for p in new.stdout.splitlines()]
    return spark.createDataFrame(sorted(set(rows)), "path string, change string")


def changed_files(spark: SparkSession, root: str, scope: str = "all", base_ref: str | None = None) -> tuple[DataFrame, str]:
    """Changed paths and their patch by scope: unstaged, staged, all, or compare (with ``base_ref``); untracked files are unstaged."""
    args = {"unstaged": [[]], "staged": [["--cached"]], "all": [[], ["--cached"]], "compare": [[f"{base_ref}...HEAD"]]}
    if scope not in args or scope == "compare" and not base_ref:
        raise ValueError("E_BASE_REF_REQUIRED" if scope == "compare" else f"no such scope: {scope}")
    names, patch = set(), ""
    for a in args[scope]:
        found = [subprocess.run(["git", "-C", root, "diff", "--no-renames", *flag, *a], capture_output=True, text=True) for flag in (["--name-only"], ["-U0"])]
        if any(f.returncode for f in found):
            raise ValueError("E_GIT_DIFF_UNAVAILABLE")
        names |= set(found[0].stdout.splitlines())
        patch += found[1].stdout
    if scope in ("unstaged", "all"):
        names |= set(subprocess.run(["git", "-C", root, "ls-files", "--others", "--exclude-standard"], capture_output=True, text=True, check=True).stdout.splitlines())
    return spark.createDataFrame([(n,) for n in sorted(names)], "path string"), patch
