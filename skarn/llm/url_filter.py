"""URL filters: a memory-mapped sorted array of 64-bit digests.

A list of entries (host, path) is stored as the sorted xxHash64 digests of its
strings ``host + path``, with the strings themselves, their offsets and one byte
of verdict.  A URL's candidates are its host and every parent domain, each with
every path prefix whose length the list has.  All candidates of a batch are
digested, probed by one vectorised binary search, and every digest that is found
is confirmed against the stored string, so a collision never decides.

The list is a file of checked size in the shared scratch folder.  Spark fetches
it once for each executor, whose workers all map that one copy; a new executor
fetches it again.
"""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.common import open_shared, scratch_path

#: Entries one list may have (about 60 bytes each: 300 MB).
MAX_ENTRIES = 5_000_000
BLOCK, ALLOW = 0, 1
VERDICTS = ("block", "allow")

#: Explicit rules (verdict, host, path) and the method's own list of advertising hosts.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LISTED = tuple(("block", f"ads-track.example.{end}", "") for end in ("com", "net", "org"))


def build(entries: Iterable[tuple[str, str, str]]) -> bytes:
    """A digest file of (verdict, host, path); of equal entries the last one holds."""
    by_key = {(host + path).encode(): (VERDICTS.index(verdict), len(host.encode())) for verdict, host, path in entries}
    if len(by_key) > MAX_ENTRIES:
        raise ValueError(f"{len(by_key)} entries; one list holds {MAX_ENTRIES}. Split it and apply the parts in turn.")
    rows = sorted((xxhash.xxh64_intdigest(k), k, *v) for k, v in by_key.items())
    ends = np.cumsum([0] + [len(r[1]) for r in rows]).astype("<u8")
    parts = [
        struct.pack("<4Q", len(rows), int(ends[-1]), 0, 0),
        np.array([r[0] for r in rows], "<u8").tobytes(),
        ends.tobytes(),
        np.array([r[3] for r in rows], "<u4").tobytes(),
        bytes(r[2] for r in rows),
        b"".join(r[1] for r in rows),
    ]
    return b"".join(parts)


class DigestArray:
    """A digest file, mapped."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n, size, _, _ = struct.unpack_from("<4Q", self.map)
        at = 32
        self.keys = np.frombuffer(self.map, "<u8", n, at)
        self.ends = np.frombuffer(self.map, "<u8", n + 1, at := at + 8 * n)
        self.hosts = np.frombuffer(self.map, "<u4", n, at := at + 8 * (n + 1))
        self.verdicts = np.frombuffer(self.map, "u1", n, at := at + 4 * n)
        self.strings = at + n
        assert self.strings + size == len(self.map)
        self.path_lengths = np.unique(np.diff(self.ends).astype(np.int64) - self.hosts).tolist()
        self.longest_host = int(self.hosts.max(initial=0))

    def string(self, i: int) -> bytes:
        return self.map[self.strings + int(self.ends[i]) : self.strings + int(self.ends[i + 1])]

    def probe(self, strings: list[bytes]) -> np.ndarray:
        """The entry of each string, or -1."""
        if not len(self.keys) or not strings:
            return np.full(len(strings), -1)
        digests = np.fromiter(map(xxhash.xxh64_intdigest, strings), np.uint64, len(strings))
        first = np.searchsorted(self.keys, digests)
        out = np.full(len(strings), -1)
        for k in np.flatnonzero(self.keys[np.minimum(first, len(self.keys) - 1)] == digests).tolist():
            i = int(first[k])
            while i < len(self.keys) and self.keys[i] == digests[k]:  # equal digests stand side by side
                if self.string(i) == strings[k]:
                    out[k] = i
                    break
                i += 1
        return out

    def match(self, urls: list[tuple[str, str]]) -> list[int]:
        """For each (host, path) the longest entry that fits it (of equal ones that with the longer host), or -1."""
        strings, owner, host_len = [], [], []
        for k, (host, path) in enumerate(urls):
            h, p = host.encode(), path.encode()
            if len(h) > self.longest_host:  # parents that no entry is long enough for are never cut
                at = h.find(b".", len(h) - self.longest_host - 1)
                h = h[at + 1 :] if at >= 0 else b""
            while h:
                for n in self.path_lengths:
                    if n <= len(p):
                        strings.append(h + p[:n])
                        owner.append(k)
                        host_len.append(len(h))
                at = h.find(b".")
                h = h[at + 1 :] if at >= 0 else b""
        best: dict[int, tuple[int, int, int]] = {}
        found = self.probe(strings)
        for c in np.flatnonzero(found >= 0).tolist():
            i = int(found[c])
            if self.hosts[i] == host_len[c]:  # host and path of the entry, not the same letters cut elsewhere
                best[owner[c]] = max(best.get(owner[c], (0, 0, -1)), (len(strings[c]), host_len[c], i))
        return [best.get(k, (0, 0, -1))[2] for k in range(len(urls))]


@lru_cache(4)
def _mapped(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def publish(spark: SparkSession, data: bytes) -> str:
    """Write a digest file to the shared folder and have every executor fetch it; returns its name there."""
    path = scratch_path(spark, ".urls")
    store, name = open_shared(path)
    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(name) as f:
        f.write(data)
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


def entries_of(rows: DataFrame) -> Iterator[tuple[str, str, str]]:
    """Entries of a table (verdict, host, path); one that is larger than a list may be is an error and never cut."""
    n = rows.count()
    if n > MAX_ENTRIES:
        raise ValueError(f"{n} entries; one list holds {MAX_ENTRIES}. Split it and apply the parts in turn.")
    clean = rows.select("verdict", F.coalesce(F.col("host"), F.lit("")), F.coalesce(F.col("path"), F.lit("")))
    return (tuple(r) for r in clean.toLocalIterator())


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = (url or "").partition("://")[2]
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    cut = min(ends, default=len(rest))
    host, tail = rest[:cut].encode().lower().decode(), rest[cut:]
    ends = [i for i in map(tail.find, "?#") if i >= 0]
    return host, tail[: min(ends, default=len(tail))]


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, listed: Iterable[tuple[str, str, str]] | DataFrame = LISTED, id_column: str = "page_id") -> DataFrame:
    """Judge every row of ``pages`` (``id_column``, url).

    Returns the id, host, path, rule (host and path of the longest rule that
    fits, else null) and verdict: that rule's; without one, block if ``listed``
    has an entry for the URL's host or a parent domain and a prefix of its path,
    else allow.  ``listed`` may be a table (verdict, host, path), such as a block
    list read from files.

    Null and malformed URLs have an empty host and path, no rule, and are
    allowed.  Repeated rows are judged each for itself; an empty table gives no
    rows; other columns are ignored.
    """
    spark = pages.sparkSession
    names = [publish(spark, build(x)) for x in (rules, entries_of(listed) if isinstance(listed, DataFrame) else listed)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rule, by_list = map(_mapped, names)
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            rule = by_rule.match(parts)
            own = by_list.match(parts)
            found = [by_rule.string(i).decode() if i >= 0 else None for i in rule]
            verdicts = [VERDICTS[by_rule.verdicts[i]] if i >= 0 else VERDICTS[by_list.verdicts[j]] if j >= 0 else "allow" for i, j in zip(rule, own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in ([h for h, _ in parts], [p for _, p in parts], found, verdicts))], names=[id_column, "host", "path", "rule", "verdict"])

    kind = pages.schema[id_column].dataType.simpleString()
    return pages.select(id_column, F.col("url").cast("string").alias("url")).mapInArrow(run, f"{id_column} {kind}, host string, path string, rule string, verdict string")
