"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates.  ``ROWS`` minima of the set under random permutations make a band's
key; a pair of similarity s shares one of ``BANDS`` keys but for a chance of
(1 - s^ROWS)^BANDS: 5 in a million at 0.8, less above.  A SimHash cannot do this:
pairs at 0.8 differ in 5 to 11 of its bits, which no set of masks searches.

Every text in a run of equal keys is tied to the run's first, and what is tied
together meets in one group, where the sets themselves are compared.  A group is
searched breadth first: a member is compared with all that no link has reached
yet, so every link that could join two classes is looked at, and a group of
copies costs about as much as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm import simhash
from skarn.llm.common import stash

SHINGLE, SIMILARITY, SEED = 5, 0.8, 43
BANDS, ROWS = 40, 6
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles permuted at once: 2 KB each.
_SLICE = 2048
#: Texts that a task remembers, about 100 bytes each.
SEEN = 200_000


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; a shorter text is one, a text without words has none."""
    found = (text or "").encode().lower().split()
    n = max(1, len(found) - shingle + 1) if found else 0
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(found[i : i + shingle]), SEED) for i in range(n)), np.uint64, n))


def band_keys(own: np.ndarray) -> np.ndarray:
    """One signed key for each band of a set that is not empty."""
    low = np.full(len(_FACTORS), ~np.uint64(0))
    for at in range(0, len(own), _SLICE):
        low = np.minimum(low, (own[at : at + _SLICE, None] * _FACTORS).min(0))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def classes(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """For each set the number of the first one that it reaches over links of at least ``similarity``."""
    label = np.arange(len(sets))
    rest = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    while len(rest):
        root, queue = rest[0], [rest[0]]
        rest, flat = rest[1:], flat[sizes[rest[0]] :]
        while queue and len(rest):
            own = sets[queue.pop()]
            place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            ends = np.cumsum(sizes[rest])
            common = np.diff(np.concatenate(([0], np.cumsum(own[place] == flat)))[np.concatenate(([0], ends))])
            near = common >= similarity * (len(own) + sizes[rest] - common)
            if near.any():
                label[rest[near]] = root
                queue += rest[near].tolist()
                flat = flat[np.repeat(~near, sizes[rest])]
                rest = rest[~near]
    return label


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # copies in the same task are left out; the shuffle after it finds all others
    for batch in batches:
        nodes, keys = [], []
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if node in seen:
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(node)
            own = shingles(text.as_py())
            nodes.append(node)
            keys.append(band_keys(own) if len(own) else [])
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["node", "keys"])


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): each node of a run of equal keys, but the first, with the first."""
    last_key, last_first = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        fresh = np.concatenate(([last_key is None or key[0] != last_key], key[1:] != key[:-1]))
        first = np.concatenate(([last_first], node[fresh]))[np.cumsum(fresh)]
        last_key, last_first = key[-1], first[-1]
        tied = first != node
        yield pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(first[tied])], names=["a", "b"])


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True) for b in batches)
        a, b = [], []
        for _, group in groupby(rows, lambda r: r[0]):
            nodes, sets = zip(*((node, shingles(text.as_py())) for _, node, text in group), strict=True)
            for i, first in enumerate(classes(list(sets), similarity).tolist()):
                if first != i:
                    a.append(nodes[i])
                    b.append(nodes[first])
            if len(a) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def links(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Stars (a, b) that span every class of near copies; ``texts``: node (long, one for each different text) and text, copies allowed."""
    keys = texts.mapInArrow(_bands, "node long, keys array<long>").dropDuplicates(["node"])
    dealt = keys.select(F.explode("keys").alias("key"), "node").repartition("key").sortWithinPartitions("key", "node")
    tied = simhash.components(stash(dealt.mapInArrow(_ties, "a long, b long").distinct()))
    group = stash(tied.select(F.col("v").alias("node"), F.col("root").alias("group")).union(tied.select(F.col("root").alias("node"), F.col("root").alias("group")).distinct()))
    once = texts.dropDuplicates(["node"])  # before the join: a partition sends each text once, however many copies it holds
    met = once.join(group, "node").select("group", "node", "text").repartition("group").sortWithinPartitions("group", "node")
    return met.mapInArrow(_verified(similarity), "a long, b long")


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, bits: int = simhash.BITS) -> DataFrame:
    """One row of ``docs`` for each class, that with the smallest doc_id, with all its columns.

    A class is what links of either kind join: near copies, and SimHashes at most
    ``bits`` apart (texts without words among them).  Null ids come after all
    others, and equal ids are told apart by their text's hash; of equal rows one
    stays.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    node = F.xxhash64(text)
    texts = docs.select(node.alias("node"), text.alias("text"))
    close = simhash.near_duplicates(texts.withColumnRenamed("node", "doc_id"), bits).select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    stars = simhash.components(close.unionByName(links(texts, similarity)))
    key = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id"), node.alias("hash"))
    # one row for each text before the join, so that no group of copies meets in a task
    own = docs.select(key.alias("key"), node.alias("v")).groupBy("v").agg(F.min("key").alias("key")).join(stars, "v", "left")
    first = own.groupBy(F.coalesce("root", "v").alias("class")).agg(F.min("key").alias("__key")).select("__key")
    return docs.withColumn("__key", key).join(first, "__key", "left_semi").dropDuplicates(["__key"]).select(docs.columns)
