"""Language-model scoring by a weighted backoff automaton.

Model.  Smoothed n-grams of up to ``order`` words are states: reading word w in
the state of history h takes the arc for hw if training text has it, else the
failure arc to h without its first word, and so on down to the root.  With c(h)
and c(hw) counted in the training text and b the backoff of h's length, the arc's
weight is (c(hw) + b p(w | shorter h)) / (c(h) + b), the failure arc's weight is
b / (c(h) + b), so each state's arcs sum to one; a history that training text
doesn't have is no state, and its failure arc is free.  At the root a known word
has (c - d) / N and all unknown words together d V / N, d being the absolute
discount (n1 + 1) / (n1 + 2 n2 + 3) by the words met once and twice, which is
above 0 and below 1 whatever they are, so every score is finite.  A text is one
left-to-right traversal from the state of the text's start.

Plan.  The model grows with the corpus and is nowhere whole.

1. One pass over the texts cuts them into chunks of about ``CHUNK`` words.  A
   chunk's word sequence goes as small numbers to a file of its task in the shared
   scratch folder, and only its place travels.  For every range of n-gram hashes
   that the chunk meets it yields one packed message: its distinct n-grams and
   how often its training documents have them.  An n-gram is in a chunk's message
   once, so a frequent one is no hot key, and there are never more messages than
   n-grams, however many chunks and ranges there are.
2. Each range sums its messages and answers every chunk with the totals.  Ranges
   are as many as the input's bytes ask for, so that one fits in memory.
3. Each chunk's answers meet, and with its sequence, read by range, are the part
   of the automaton that its texts can visit; they are traversed.

Words are known by 64-bit hashes, longer n-grams by the leading bits that leave a
chance of about 2^-16 that one meets another, at any size of the input.  The
totals of step 2 that the root needs (N, V, n1, n2) are summed by range first,
from a written table.
"""

from __future__ import annotations

import json
import pickle
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import open_shared, remainder, scratch_path, stash

#: Words in a chunk, and text bytes for which there is one range of hashes.
CHUNK, RANGE_BYTES = 1_250_000, 8 << 20
ORDER = 3
#: b above, for histories of one word, two, ...: how many observations the shorter history is worth.
BACKOFF = (200.0, 20.0)
END, START = 0, 1
_SCHEMA = "dest long, kind int, chunk long, part int, payload binary"
NGRAMS, SEQUENCE, ANSWER, TOTALS = 0, 1, 2, 3
_END_HASH, _START_HASH = np.uint64(0x51AB_0C5D_93E1_77F3), np.uint64(0x0D2F_86B9_4E7C_A115)


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes; a few as they are."""
    v = np.ascontiguousarray(values, "<u8")
    if len(v) < 16:
        return b"\0" + v.tobytes()
    return b"\1" + zstandard.compress(np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    if data[0] == 0:
        return np.frombuffer(data, "<u8", offset=1)
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def hash_mask(size: int) -> np.uint64:
    """Leading bits by which longer n-grams are known in an input of ``size`` bytes."""
    bits = min(64, max(size, 2).bit_length() + 17)
    return ~np.uint64((1 << (64 - bits)) - 1)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def join_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from those of all but its last word and of its last word."""
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019))
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


class _Words(dict):
    """Numbers of words in the order of their first use; 0 and 1 are the text's end and start."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 2
        return n


@dataclass
class Chunk:
    """Word sequences of several documents, and their n-grams in the order of their hashes."""

    ids: list
    held_out: np.ndarray
    lengths: np.ndarray  # tokens of each document, its end included
    words: np.ndarray  # all documents' tokens, by number
    hashes: np.ndarray  # of the numbers

    def ngrams(self, order: int = ORDER, mask: np.uint64 = ~np.uint64(0)) -> tuple[np.ndarray, list[np.ndarray]]:
        """Sorted hashes of all distinct n-grams; for each length each token's place of the n-gram that ends there, or -1.

        The start counts as a word before the first; only it is no n-gram's last word.
        """
        first = np.concatenate(([0], np.cumsum(self.lengths)[:-1])).astype(np.int64)
        at = np.arange(len(self.words)) - np.repeat(first, self.lengths)
        n = np.int64(len(self.hashes))
        own, hashes = self.words, self.hashes
        ids, known = [own], [hashes]
        for k in range(2, order + 1):
            before = np.empty_like(own)
            before[1:] = own[:-1]
            if k == 2:
                before[first] = START
            here = at >= k - 2
            codes, back = np.unique(before[here].astype(np.int64) * n + self.words[here], return_inverse=True)
            hashes = join_hashes(hashes[codes // n], self.hashes[codes % n])
            own = np.full(len(self.words), -1, np.int64)
            own[here] = back
            ids.append(own)
            known.append(hashes & mask)
        both = np.concatenate(known)
        order_ = np.argsort(both, kind="stable")
        place = np.empty(len(both), np.int64)
        place[order_] = np.arange(len(both))
        shift = np.cumsum([0] + [len(h) for h in known])
        return both[order_], [np.where(i >= 0, place[s + i], -1) for i, s in zip(ids, shift[:-1], strict=True)]

    def dump(self) -> bytes:
        return pickle.dumps((self.ids, pack(self.held_out), pack(self.lengths), pack(self.words), self.hashes.tobytes()))

    @staticmethod
    def load(data: bytes) -> Chunk:
        ids, held_out, lengths, words, hashes = pickle.loads(data)
        return Chunk(ids, unpack(held_out) > 0, unpack(lengths).astype(np.int64), unpack(words).astype(np.int64), np.frombuffer(hashes, np.uint64))


class Builder:
    def __init__(self) -> None:
        self.words, self.ids, self.held, self.parts, self.size = _Words(), [], [], [], 0

    def add(self, doc_id: object, text: str | None, held_out: bool) -> None:
        own = tokens(text)
        sequence = np.empty(len(own) + 1, np.int32)
        sequence[:-1] = np.fromiter(map(self.words.__getitem__, own), np.int32, len(own))
        sequence[-1] = END
        self.ids.append(doc_id)
        self.held.append(held_out)
        self.parts.append(sequence)
        self.size += len(sequence)

    def close(self) -> Chunk:
        hashes = np.concatenate((np.array([_END_HASH, _START_HASH]), np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))))
        return Chunk(self.ids, np.array(self.held, bool), np.fromiter(map(len, self.parts), np.int64, len(self.parts)), np.concatenate(self.parts), hashes)


def training_counts(chunk: Chunk, n: int, places: list[np.ndarray]) -> np.ndarray:
    train = np.repeat(~chunk.held_out, chunk.lengths)
    return sum(np.bincount(p[train & (p >= 0)], minlength=n) for p in places)


@dataclass
class Root:
    """What all states share: training tokens N, distinct ones V, those met once and twice, training documents."""

    tokens: int = 0
    distinct: int = 0
    once: int = 0
    twice: int = 0
    documents: int = 0

    def log_base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def probability(self, counts: np.ndarray) -> np.ndarray:
        """Of a word by its count, at the root; all unknown words are one event."""
        if not self.tokens:
            return np.ones(len(counts))
        discount = (self.once + 1) / (self.once + 2 * self.twice + 3)
        return np.where(counts > 0, counts - discount, discount * self.distinct) / self.tokens


def traverse(chunk: Chunk, counts: np.ndarray, places: list[np.ndarray], root: Root, backoff: Sequence[float] = BACKOFF) -> np.ndarray:
    """log10 of the weight that every token adds along the traversal of its text.

    The state before a token is the longest history that training text goes on
    from; where the arc's count is 0 the fraction is the failure arc's weight
    times that of the shorter history, and where the history's is 0 it is the latter.
    """
    of = lambda place: np.where(place >= 0, counts[place], 0)
    first = np.concatenate(([0], np.cumsum(chunk.lengths)[:-1])).astype(np.int64)
    weight = root.probability(counts[places[0]])
    for k in range(1, len(places)):
        state = np.empty(len(weight), np.int64)
        state[1:] = of(places[k - 1])[:-1]
        state[first] = root.documents if k == 1 else 0
        weight = (of(places[k]) + backoff[k - 1] * weight) / (state + backoff[k - 1])
    return np.log10(weight)


def _message(hashes: np.ndarray, seen: np.ndarray, flags: np.ndarray, documents: int) -> bytes:
    parts = [pack_sorted(hashes), pack(seen), np.packbits(flags).tobytes()]
    return struct.pack("<4I", *map(len, parts), documents) + b"".join(parts)


def _opened(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    a, b, c, documents = struct.unpack_from("<4I", payload)
    hashes = unpack_sorted(payload[16 : 16 + a])
    flags = np.unpackbits(np.frombuffer(payload, np.uint8, c, 16 + a + b), count=len(hashes)).astype(bool)
    return hashes, unpack(payload[16 + a : 16 + a + b]).astype(np.int64), flags, documents


def _chunks(ranges: int, chunk_words: int, order: int, mask: np.uint64, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, builder = TaskContext.get().partitionId(), 0, Builder()
        # no other attempt of this task takes the name; only rows of the attempt that counts refer to it
        store, base = open_shared(folder)
        name, out, written = f"{task}-{uuid.uuid4().hex}", None, 0

        def messages() -> Iterator[pa.RecordBatch]:
            nonlocal out, written
            chunk = builder.close()
            at = (task << 24) + n
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/{name}")
            data = chunk.dump()
            out.write(data)
            place = json.dumps([f"{folder}/{name}", written, len(data)]).encode()
            written += len(data)
            del data
            hashes, places = chunk.ngrams(order, mask)
            seen = training_counts(chunk, len(hashes), places)
            train = ~chunk.held_out
            # words are told from longer n-grams by a flag, for the root's totals
            is_word = np.zeros(len(hashes), bool)
            is_word[places[0]] = True
            dest = ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            cut = np.searchsorted(dest, np.arange(ranges + 1))
            # dealt round by task: by ``at``, whose low bits are the same for all tasks, they would meet in a few ranges
            rows = [((task + n) % ranges, SEQUENCE, at, 0, place)]
            for r in range(ranges):
                a, b = int(cut[r]), int(cut[r + 1])
                if a < b:
                    rows.append((r, NGRAMS, at, r, _message(hashes[a:b], seen[a:b], is_word[a:b], int(train.sum()) if r == int(dest[0]) else 0)))
            for row in rows:
                yield _batch([row])

        for batch in batches:
            for doc_id, text, held in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                builder.add(doc_id, text.as_py(), held)
                if builder.size >= chunk_words:
                    yield from messages()
                    n, builder = n + 1, Builder()
        if builder.ids:
            yield from messages()
        if out is not None:
            out.close()

    return run


def _read_chunk(place: bytes) -> Chunk:
    path, at, n = json.loads(place)
    store, name = open_shared(path)
    with store.open_input_file(name) as f:
        return Chunk.load(f.read_at(n, at))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["dest", "kind", "chunk", "part", "payload"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum a range's messages and answer each; sequences pass through.  Rows come by (dest, kind)."""
    held: list[tuple] = []

    def close() -> Iterator[pa.RecordBatch]:
        opened = [_opened(payload) for *_, payload in held]
        hashes = [o[0] for o in opened]
        own, back = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.zeros(len(own), np.int64)
        at, words = 0, np.zeros(len(own), bool)
        for h, seen, flags, _ in opened:
            place = back[at : at + len(h)]
            np.add.at(counts, place, seen)  # a hash can stand twice in a message, for two n-grams
            words[place] |= flags
            at += len(h)
        c = counts[words]
        yield _batch([(held[0][0], TOTALS, -1, held[0][3], pickle.dumps(Root(int(c.sum()), int((c > 0).sum()), int((c == 1).sum()), int((c == 2).sum()), sum(o[3] for o in opened))))])
        at = 0
        for h, (_, _, chunk, part, _) in zip(hashes, held, strict=True):
            yield _batch([(held[0][0], ANSWER, chunk, part, pack(counts[back[at : at + len(h)]]))])
            at += len(h)

    for row in _rows(batches):
        if held and (row[1] != NGRAMS or row[0] != held[0][0]):
            yield from close()
            held = []
        if row[1] == NGRAMS:
            held.append(row)
        else:
            yield _batch([row])
    if held:
        yield from close()


def _scores(root: Root, backoff: Sequence[float], order: int, mask: np.uint64):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def close(chunk: Chunk, answers: list[tuple[int, bytes]]) -> pa.RecordBatch:
        hashes, places = chunk.ngrams(order, mask)
        counts = np.concatenate([unpack(a) for _, a in sorted(answers)]).astype(np.int64)
        if len(counts) != len(hashes):
            raise ValueError("a chunk's answers don't fit its n-grams")
        first = np.concatenate(([0], np.cumsum(chunk.lengths)[:-1])).astype(np.int64)
        c1 = counts[places[0]]
        sums = [np.add.reduceat(x, first) for x in ((c1 > 0).astype(np.int64), root.log_base(c1), traverse(chunk, counts, places, root, backoff))]
        return pa.RecordBatch.from_arrays([pa.array([str(i) if i is not None else None for i in chunk.ids], pa.string()), pa.array(chunk.held_out), pa.array(chunk.lengths), *map(pa.array, sums)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chunk, answers = None, None, []
        for _, kind, n, part, payload in _rows(batches):
            if n != at:
                if chunk is not None:
                    yield close(chunk, answers)
                at, chunk, answers = n, None, []
            if kind == SEQUENCE:
                chunk = _read_chunk(payload)
            else:
                answers.append((part, payload))
        if chunk is not None:
            yield close(chunk, answers)

    return run


def score_texts(docs: DataFrame, order: int = ORDER, backoff: Sequence[float] = BACKOFF, chunk_words: int = CHUNK, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Score every whole text of ``docs`` (doc_id, text) by a model of the training rows.

    Training rows are those whose crc32(doc_id) mod 5 is not 1.  Returns doc_id,
    held_out, n_tokens (words and one end), n_known, train_tokens, base_score
    (add-half unigrams) and score (log10 probability by the automaton).

    A null or empty text is its end alone.  A null doc_id counts as '' for the
    split and stays null.  Repeated rows are counted and scored each for itself;
    without training rows every word is unknown and the root gives it 1.  An
    empty table gives no rows; other columns are ignored.
    """
    own = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), (remainder(F.col("doc_id"), 5) == 1).alias("held_out"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(4, -(-size // range_bytes))
    kind = docs.schema["doc_id"].dataType
    mask = hash_mask(size)
    messages = own.mapInArrow(_chunks(ranges, chunk_words, order, mask, scratch_path(docs.sparkSession, ".sequences")), _SCHEMA)
    answers = stash(messages.repartitionById(ranges, F.col("dest").cast("int")).sortWithinPartitions("dest", "kind").mapInArrow(_answer, _SCHEMA))
    root = Root()
    for row in answers.filter(F.col("kind") == TOTALS).select("payload").toLocalIterator():  # one small row a range
        part = pickle.loads(row[0])
        root = Root(root.tokens + part.tokens, root.distinct + part.distinct, root.once + part.once, root.twice + part.twice, root.documents + part.documents)
    # a few times as many partitions as chunks, so that seldom two meet in one
    dealt = answers.filter(F.col("kind") != TOTALS).repartition(4 * ranges, "chunk").sortWithinPartitions("chunk", "kind")
    scored = dealt.mapInArrow(_scores(root, backoff, order, mask), "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(root.tokens).cast("long").alias("train_tokens"), "base_score", "score")
