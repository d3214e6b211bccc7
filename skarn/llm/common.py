"""Pieces shared by the training-data operators: tables, scratch space, fields."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the word rules of this package see it: space and \t..\r.
SPACES = "\x20\x09-\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    ``spark.checkpoint.dir`` names it on a cluster, where it must be set.  Only
    on one machine a temporary folder takes its place.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="skarn-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def scratch_path(spark: SparkSession, ending: str = "") -> str:
    """A new path in the scratch folder."""
    path = f"{scratch_dir(spark)}/skarn/{uuid.uuid4().hex}{ending}"
    _made.append(path)
    return path


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared scratch folder and return a scan of it.

    This cuts the lineage: a lost executor costs the re-read of a file, and two
    consumers see the very same rows.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Paths that this process made and has not dropped.
_made: list[str] = []


def mark() -> int:
    """A point in time, for ``drop_since``."""
    return len(_made)


def drop_since(spark: SparkSession, point: int, keep: Iterable[DataFrame] = ()) -> None:
    """Delete what was stashed after ``mark()`` gave ``point``, but for the files that ``keep`` reads."""
    kept = [f for df in keep for f in df.inputFiles()]
    jvm = spark.sparkContext._jvm
    for path in _made[point:]:
        if not any(f"/{path.rsplit('/', 1)[1]}/" in f for f in kept):
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            _made.remove(path)


def open_shared(path: str):
    """(file system, name) of a path in the shared folder, for reads by range and for writes from workers."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        path = path.replace("s3a://", "s3://", 1)
        if path.startswith("file:"):
            return fs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus).cast("long"))
