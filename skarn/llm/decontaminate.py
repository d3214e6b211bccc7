"""Benchmark decontamination by a broadcast set of n-gram windows.

The windows of the benchmark's items, written as word numbers, go to every
worker: a dict of the benchmark's words, the sorted rolling hashes of its
windows, and per hash the exact windows with their items.  A worker turns a text
into word numbers (0: no benchmark word), looks the rolling hashes of its
windows up by binary search, and verifies every hit number by number.

The benchmark is read to the driver in parts of ``part_words`` words (and one
item more at most).  One part is broadcast and scanned at a time: the rows with
their hits are written before the next part's pass, so what a worker holds is
bounded however large the benchmark is, and each further part costs one more
pass over the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.llm.common import stash

WINDOW = 10
#: Words of the benchmark broadcast at once: about 150 bytes each, 300 MB at most.
PART_WORDS = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: Bytes that separate words become spaces, A-Z become a-z; bytes from 0x80 on belong to words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class WindowIndex:
    """Windows of ``items`` (item id as text or None, text)."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window, self.vocabulary, self.windows = window, {}, {}
        for item, text in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            n = min(window, len(own))
            for i in range(len(own) - n + 1) if n else ():
                self.windows.setdefault(tuple(own[i : i + n]), set()).add(item)
        self.by_length: dict[int, tuple[np.ndarray, dict[int, list[tuple[int, ...]]]]] = {}
        for n in {len(w) for w in self.windows}:
            all_n = [w for w in self.windows if len(w) == n]
            found: dict[int, list[tuple[int, ...]]] = {}
            for w, h in zip(all_n, self._rolling(np.array(all_n, np.uint64).ravel(), n)[::n].tolist(), strict=True):
                found.setdefault(h, []).append(w)
            self.by_length[n] = np.array(sorted(found), np.uint64), found

    @staticmethod
    def _rolling(ids: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(ids) - n + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                out = out * _MIX + (ids[k : len(ids) - n + 1 + k] + np.uint64(1)) * _MIX
                out ^= out >> np.uint64(29)
        return out

    def hits(self, found: list[bytes]) -> tuple[np.ndarray, set[str | None]]:
        """Which of the words lie inside a window's occurrence, and the items of those windows."""
        ids = np.fromiter(map(self.vocabulary.get, found, repeat(0)), np.uint64, len(found))
        hit, items = np.zeros(len(ids), bool), set()
        run = np.concatenate(([0], np.cumsum(ids == 0)))
        for n, (hashes, exact) in self.by_length.items():
            if len(ids) < n:
                continue
            starts = np.flatnonzero(run[n:] == run[:-n])  # windows of benchmark words alone
            if not len(starts):
                continue
            h = self._rolling(ids, n)[starts]
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for i in starts[hashes[at] == h].tolist():
                own = tuple(ids[i : i + n].tolist())
                if own in self.windows:
                    hit[i : i + n] = True
                    items |= self.windows[own]
        return hit, items


def _parts(benchmark: DataFrame, part_words: int) -> Iterator[list[tuple[str | None, str | None]]]:
    part, n = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        part.append((row[0], row[1]))
        n += len(words(row[1]))
        if n >= part_words:
            yield part
            part, n = [], 0
    yield part


def _digest(items: set[str | None]) -> str:
    return hashlib.sha256(",".join(sorted(i for i in items if i is not None)).encode()).hexdigest()


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)]), False), False),
        T.StructField("items", T.ArrayType(T.StringType(), True), False),
    ]
)


def _scan(index, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = index.value
        kind = pa.list_(pa.struct([pa.field("first", pa.int32(), False), pa.field("end", pa.int32(), False)]))
        for batch in batches:
            n, spans, items = [], [], []
            for text in batch.column(text_at):
                own = words(text.as_py())
                hit, who = use.hits(own)
                n.append(len(own))
                spans.append([{"first": a, "end": b} for a, b in _spans(hit)] if who else [])
                items.append(list(who))
            extra = [pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "__n_words", "__spans", "__items"])

    return run


def _struct(df: DataFrame) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(f"__{f.name}", f.dataType, f.nullable) for f in _FOUND.fields]])


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """``docs`` with __n_words, __spans (word ranges, end exclusive) and __items.

    A window is ``window`` consecutive words of an item; an item of fewer words,
    but not none, is one window.  Null texts have no words.  An item whose id is
    null marks words but is named nowhere.  Repeated items and rows count as
    they come; an empty benchmark hits nothing; an empty table stays empty.
    Columns of ``docs`` are kept, whatever their names but the three above.
    """
    sc = docs.sparkSession.sparkContext
    at = docs.columns.index("text")
    parts = _parts(benchmark, part_words)
    out = docs.mapInArrow(_scan(sc.broadcast(WindowIndex(next(parts), window)), at), _struct(docs))
    for part in parts:
        # the rows so far are written first, so that no task holds two parts; spans and items add up
        first = stash(out.withColumnsRenamed({"__n_words": "__n0", "__spans": "__s0", "__items": "__i0"}))
        scanned = first.mapInArrow(_scan(sc.broadcast(WindowIndex(part, window)), at), _struct(first))
        out = scanned.withColumns({"__spans": F.concat("__s0", "__spans"), "__items": F.array_distinct(F.concat("__i0", "__items"))}).drop("__n0", "__s0", "__i0")
    return out


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of ``docs``."""
    found = find_contamination(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark, window, part_words)
    several = F.size("__spans") > 0
    covered = F.when(several, F.size(F.array_distinct(F.flatten(F.transform("__spans", lambda s: F.sequence(s["first"], s["end"] - 1)))))).otherwise(0)
    items = F.array_sort(F.filter("__items", lambda i: i.isNotNull()))
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        covered.cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (covered > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "documents", window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """Drop contaminated rows of ``docs`` (``documents``), or cut the hit words out of their texts (``spans``).

    Clean rows come back unchanged.  Cut texts lose every character from the
    first to the last of a hit run of words; n_chars, where there is such a
    column, follows the text.
    """
    if action not in ("documents", "spans"):
        raise ValueError(f"action must be documents or spans, not {action}")
    found = find_contamination(docs, benchmark, window, part_words)
    if action == "documents":
        return found.filter(F.size("__spans") == 0).select(docs.columns)
    # words as the index sees them: signs below 0x80 other than letters and digits separate
    word = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"
    gaps, own = F.split("text", word, -1), F.regexp_extract_all("text", F.lit(f"({word})"), F.lit(1))
    kept = F.transform(
        F.sequence(F.lit(0), F.size(own)),
        lambda i: F.when(F.exists("__spans", lambda s: (s["first"] <= i) & (i < s["end"])), F.when(F.exists("__spans", lambda s: s["first"] == i), F.get(gaps, i)).otherwise(F.lit(""))).otherwise(
            F.concat(F.when(F.exists("__spans", lambda s: s["end"] == i), F.lit(" ")).otherwise(F.get(gaps, i)), F.coalesce(F.get(own, i), F.lit("")))
        ),
    )
    text = F.when(F.size("__spans") == 0, F.col("text")).otherwise(F.array_join(kept, ""))
    out = found.withColumn("text", text).select(docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
