"""Precise code indexes in the public SCIP protobuf form."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.operators.structure import owning_interval

OCCURRENCES = "path string, start_line int, start_col int, end_line int, end_col int, symbol string, symbol_roles int"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at += 1
        if byte < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind} in a precise index")
        yield tag >> 3, value


def decode(data: bytes) -> Iterator[tuple]:
    """Occurrences of an index; those without a symbol or with a range of other than 3 or 4 numbers are dropped."""
    for number, document in fields(data):
        if number != 2 or not isinstance(document, bytes):
            continue
        parts = list(fields(document))
        path = next((v.decode() for n, v in parts if n == 1), "")
        for n, value in parts:
            if n != 2:
                continue
            span, symbol, roles = [], "", 0
            for m, x in fields(value):
                if m == 1 and isinstance(x, bytes):
                    at = 0
                    while at < len(x):
                        v, at = _varint(x, at)
                        span.append(v)
                elif m == 1:
                    span.append(x)
                elif m == 2:
                    symbol = x.decode()
                elif m == 3:
                    roles = x
            if symbol and len(span) in (3, 4):
                yield (path, span[0], span[1], span[2] if len(span) == 4 else span[0], span[-1], symbol, roles)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Occurrences of the index files at ``path``."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = [row for data in pdf["content"] for row in decode(bytes(data))]
            yield pd.DataFrame(rows, columns=["path", "start_line", "start_col", "end_line", "end_col", "symbol", "symbol_roles"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, OCCURRENCES)


def short_name(symbol: F.Column) -> F.Column:
    """The last descriptor of a symbol without its suffix."""
    bare = F.regexp_replace(symbol, r"[.#:/!]+$|\(\+?\d*\)\.?$", "")
    return F.regexp_replace(F.regexp_extract(bare, r"([^/#.:`]+)`?$", 1), r"\(\)$", "")


def call_edges(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges (path, from_symbol, target, target_path, line) from references to definitions.

    ``symbols`` (path, name, start_line, end_line) own lines; references outside
    any symbol, to a name without a definition or to themselves give no edge.
    """
    o = occurrences.withColumn("line", F.col("start_line") + 1)
    defs = o.filter(F.col("symbol_roles").bitwiseAND(F.lit(1)) == 1).groupBy("symbol").agg(F.max_by("path", F.struct("path", "line")).alias("target_path"))
    refs = o.filter(F.col("symbol_roles").bitwiseAND(F.lit(1)) == 0).withColumn("ref", F.concat_ws(":", "path", "line", "symbol")).dropDuplicates(["ref"])
    owned = symbols.withColumn("owner", F.concat_ws("\u0001", "name", "start_line"))
    own = owning_interval(refs.select("path", "ref", "line"), owned.select("path", "owner", "start_line", "end_line"), "path", "line", "start_line", "end_line", "ref", "owner")
    joined = refs.join(own, "ref").join(defs, "symbol")
    return joined.select("path", F.substring_index("owner", "\u0001", 1).alias("from_symbol"), short_name(F.col("symbol")).alias("target"), "target_path", "line").filter("from_symbol <> target OR path <> target_path").distinct()
