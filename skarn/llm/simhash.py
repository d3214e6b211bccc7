"""SimHash near-duplicates by a Gray-order hierarchical index.

A fingerprint has bit b set if over half of the text's shingle hashes have it.
All fingerprints that differ in at most two bits are linked; a document's class
is the set it reaches over links.

Index.  The upper nodes are masked bit patterns: of the four 16-bit quarters two
fingerprints within two bits share at least two whole ones, so each of the six
pairs of quarters is a mask, and the fingerprints that share its pattern stand
below one node.  A node with more than ``LARGE`` of them gets a second layer, the
six pairs of 8-bit quarters of its other 32 bits; below that at most 2^16
different fingerprints remain, whatever the corpus holds.  Inside a node the
fingerprints are sorted by Gray rank, which sets those with small differences
side by side, and factored into a tree: an inner node keeps the bits on which
all below agree.  The nodes of a batch are the roots of one forest.  A search
runs down it for all members at once, adds the differences in the bits each
level fixes, and prunes whole groups beyond two.

Only distinct fingerprints are indexed (copies share one), nodes emit a spanning
star for each class they see and not their pairs, and stars are joined to
classes by alternating large-star and small-star steps, all on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import stash

SHINGLE, SEED, BITS = 3, 42, 2
#: Members above which an upper node gets its second layer.
LARGE = 8192
FANOUT = 8
#: A fingerprint that more than one row in HOT has is joined by broadcast: there are fewer than HOT of them.
HOT = 256
#: Search states held at once in a tree: about 40 bytes each.
STATES = 1_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the whole text; 0 without words."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - shingle + 1)
    last = ends[shingle - 1 :] if len(found) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):  # bounds the bits in memory
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Position of each fingerprint in the order of the reflected Gray code."""
    out = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


@dataclass
class Level:
    """Nodes of one depth: what all fingerprints below share, and where their children and leaves are."""

    pattern: np.ndarray  # the agreed bits' values
    agreed: np.ndarray
    fresh: np.ndarray  # bits agreed here and not yet in the parent
    first: np.ndarray  # first child in the next level
    count: np.ndarray
    last: np.ndarray  # last leaf below


def forest(fps: np.ndarray, sizes: np.ndarray) -> list[Level]:
    """Levels from the upper nodes (one for each run of ``sizes`` fingerprints, in Gray order within a run) to the leaves."""
    n = len(fps)
    none = np.zeros(n, np.int64)
    levels = [Level(fps, np.full(n, ~np.uint64(0)), fps, none, none, np.arange(n))]
    ones, zeros = fps, ~fps
    while True:
        nodes = -(-sizes // FANOUT)
        k = np.arange(nodes.sum()) - np.repeat(np.cumsum(nodes) - nodes, nodes)
        first = np.repeat(np.cumsum(sizes) - sizes, nodes) + k * FANOUT
        count = np.minimum(FANOUT, np.repeat(sizes, nodes) - k * FANOUT)
        ones, zeros = np.bitwise_and.reduceat(ones, first), np.bitwise_and.reduceat(zeros, first)
        agreed, below = ones | zeros, levels[-1]
        below.fresh = below.agreed & ~np.repeat(agreed, count)
        levels.append(Level(ones, agreed, agreed, first, count, below.last[first + count - 1]))
        if sizes.max() <= FANOUT:
            return levels[::-1]
        sizes = nodes


def search(fps: np.ndarray, sizes: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of positions that differ in at most ``bits`` bits, inside each run of ``sizes`` fingerprints in Gray order."""
    levels = forest(fps, sizes)
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # (query, node, differences so far, depth): depth first over slices, so that memory is bounded
    stack = [(np.arange(len(fps)), np.repeat(np.arange(len(sizes)), sizes), np.zeros(len(fps), np.int64), 0)]
    while stack:
        query, node, cost, depth = stack.pop()
        if len(query) > STATES:
            half = len(query) // 2
            stack += [(query[:half], node[:half], cost[:half], depth), (query[half:], node[half:], cost[half:], depth)]
            continue
        level = levels[depth]
        cost = cost + np.bitwise_count((fps[query] ^ level.pattern[node]) & level.fresh[node])
        keep = (cost <= bits) & (level.last[node] > query)  # each pair once, from its smaller end
        query, node, cost = query[keep], node[keep], cost[keep]
        if depth == len(levels) - 1:
            out_a.append(query)
            out_b.append(node)
            continue
        child = level.first[node][:, None] + np.arange(FANOUT)
        inside = (np.arange(FANOUT) < level.count[node][:, None]).ravel()
        stack.append((np.repeat(query, FANOUT)[inside], child.ravel()[inside], np.repeat(cost, FANOUT)[inside], depth + 1))
    return np.concatenate(out_a), np.concatenate(out_b)


def classes(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member's number for each of n nodes under links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def _stars(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars (member, centre) of the links inside runs of equal keys: one forest whose roots are the upper nodes."""
    order = np.lexsort((gray_rank(fps), keys))
    keys, fps = keys[order], fps[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    shared = np.repeat(sizes > 1, sizes)
    fps, sizes = fps[shared], sizes[sizes > 1]
    if not len(fps):
        return fps, fps
    label = classes(len(fps), *search(fps, sizes, bits))
    member = np.flatnonzero(label != np.arange(len(fps)))
    return fps[member], fps[label[member]]


def _group_links(bits: int):
    def emit(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = _stars(keys, fps, bits)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            fps = np.concatenate((fps, batch.column(1).to_numpy().view(np.uint64)))
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last node may go on in the next batch
            if cut > 100_000:
                yield emit(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield emit(keys, fps)

    return run


def _masks(fp: Column, offsets: list[tuple[int, int]], tag: Column, width: int) -> Column:
    """One key for each pair of pieces (offset, width bits): the tag, which pair, and the pattern."""
    piece = [F.shiftrightunsigned(fp, o).bitwiseAND(F.lit((1 << width) - 1)) for o in offsets]
    keys = [
        F.shiftleft(F.shiftleft(tag, 3).bitwiseOR(F.lit(k).cast("long")), 2 * width).bitwiseOR(F.shiftleft(piece[i], width)).bitwiseOR(piece[j])
        for k, (i, j) in enumerate(combinations(range(4), 2))
    ]
    return F.array(*keys)


def links(unique: DataFrame, bits: int = BITS, large: int = LARGE) -> DataFrame:
    """Stars (a, b) that span every class of the distinct fingerprints ``fp`` within each upper node."""
    if bits > 2:
        raise ValueError("the masks guarantee links of at most two bits")
    zero = F.lit(0).cast("long")
    nodes = unique.select("fp", F.explode(_masks(F.col("fp"), [48, 32, 16, 0], zero, 16)).alias("key"))
    hot = stash(nodes.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > large).drop("n"))
    plain = nodes
    if not hot.isEmpty():
        plain = nodes.join(hot, "key", "left_anti")
        # the second layer: a pattern on two of the four bytes-wide pieces of the bits that the first leaves open
        pair = F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(7))
        offsets = [48, 32, 16, 0]
        second = None
        for k, (i, j) in enumerate(combinations(range(4), 2)):
            free = [offsets[m] for m in range(4) if m not in (i, j)]
            pieces = [free[0] + 8, free[0], free[1] + 8, free[1]]
            second = F.when(pair == k, _masks(F.col("fp"), pieces, F.col("key"), 8)) if second is None else second.when(pair == k, _masks(F.col("fp"), pieces, F.col("key"), 8))
        # set apart from first-layer keys by the top bit below the sign
        deeper = nodes.join(hot, "key", "left_semi").select("fp", F.explode(second).alias("key")).withColumn("key", F.col("key").bitwiseOR(F.lit(1 << 62)))
        plain = plain.select("fp", "key").unionByName(deeper)
    dealt = plain.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_group_links(bits), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Stars (v, root): every node of ``edges`` (a, b) but the roots, with the smallest node of its component."""
    now = stash(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root")).distinct())
    seen = None
    while True:
        # large star: larger neighbours of u go to the smallest of u's neighbourhood
        both = now.select(F.col("v").alias("u"), F.col("root").alias("w")).union(now.select(F.col("root").alias("u"), F.col("v").alias("w")))
        low = both.groupBy("u").agg(F.min("w").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("w > u").join(low, "u").select(F.col("w").alias("v"), F.col("m").alias("root")).distinct()
        # small star: u and its smaller neighbours go to the smallest of these
        low = large.groupBy("v").agg(F.min("root").alias("m"))
        joined = large.join(low, "v")
        small = joined.select(F.col("root").alias("v"), F.col("m").alias("root")).union(joined.select("v", F.col("m").alias("root"))).filter("v <> root").distinct()
        now = stash(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("v", "root").cast("decimal(38,0)"))).first()
        if state == seen:
            return now
        seen = state


def near_duplicates(docs: DataFrame, bits: int = BITS, large: int = LARGE) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every row of ``docs``.

    Null and empty texts have fingerprint 0 and are linked like any other.  A
    null doc_id gets its class's smallest id, null only if the class has none.
    Repeated rows are a class of their own id.  An empty table gives no rows;
    other columns are ignored.
    """
    own = stash(fingerprints(docs))
    unique = stash(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    stars = components(links(unique.select("fp"), bits, large))
    linked = stars.select(F.col("v").alias("fp"), "root").union(stars.select(F.col("root").alias("fp"), "root").distinct())
    roots = linked.join(unique, "fp").groupBy("root").agg(F.min("first").alias("smallest"))
    of_fp = stash(unique.join(linked, "fp", "left").join(roots, "root", "left").select("fp", F.coalesce("smallest", "first").alias("component_id"), "n"))
    hot = F.broadcast(of_fp.filter(F.col("n") * HOT > own.count()).drop("n"))  # fewer than HOT rows
    rest = own.join(hot.select("fp"), "fp", "left_anti").join(of_fp.drop("n"), "fp")
    return own.join(hot, "fp").unionByName(rest).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row of ``docs`` for each class of near-duplicates, that with the smallest doc_id, with all its columns.

    Null ids come after all others, and equal ids are told apart by their text's
    hash, so every class keeps exactly one row; of equal rows one stays.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # one key for the join and for the rows of equal key, so that texts are shuffled once
    key = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("hash"))
    found = near_duplicates(docs.select(key.alias("doc_id"), "text"), bits)
    first = found.select(F.col("component_id").alias("__key")).distinct()
    return docs.withColumn("__key", key).join(first, "__key", "left_semi").dropDuplicates(["__key"]).select(docs.columns)
