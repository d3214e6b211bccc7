"""Numbered pointers to versions of a table: one is added and none is ever replaced, so a crash leaves the one before."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _folder(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/pointers")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def newest(spark: SparkSession, folder: str) -> tuple[int, str] | None:
    """Number and version of the largest pointer, None if there is none."""
    store, path = _folder(spark, folder)
    if not store.exists(path):
        return None
    names = [s.getPath().getName() for s in store.listStatus(path)]
    return max(((int(n), v) for n, _, v in (x.partition("-") for x in names) if v and n.isdigit()), default=None)


def add(spark: SparkSession, folder: str, number: int, version: str) -> None:
    """Point to ``version``: an empty file of that name, which is there as a whole or not at all."""
    store, path = _folder(spark, folder)
    store.mkdirs(path)
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, f"{number}-{version}")
    if not store.createNewFile(made):
        raise FileExistsError(f"{made}: another writer was first")


def drop_before(spark: SparkSession, folder: str, number: int) -> None:
    """Delete versions and pointers below ``number``; readers of those must be done."""
    store, path = _folder(spark, folder)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for s in store.listStatus(path):
        n, _, version = s.getPath().getName().partition("-")
        if version and n.isdigit() and int(n) < number:
            store.delete(hadoop.Path(f"{folder}/{version}"), True)
            store.delete(s.getPath(), False)
