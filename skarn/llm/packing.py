"""Harmonic packing of documents into fixed-length token sequences.

Lengths fall into reciprocal-capacity classes: class k holds pieces of
(C/(k+1), C/k] tokens, and each of its sequences takes exactly k of them.  A
document longer than C is cut into full sequences first.  As cuts are free, a
remainder that would leave more than ``tolerance`` of its slot empty gives off a
piece of floor(C/(k+1)) tokens, which fills the next class's slot, and its rest
is classed anew; so no full sequence is padded by more than ``tolerance`` plus
rounding.  The fewer than k pieces that each class has left when a worker ends
are joined end to end.

Every worker packs its own rows in one pass without any shuffle.  It keeps the
open sequences of at most 2 * sqrt(C) classes, below 2 * C tokens in all but
for the current batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
TOLERANCE = 0.04
END_ID = 1
_END = END_ID.to_bytes(4, "little")
#: Words kept in a worker's tokenizer cache, and the longest of them in bytes.
CACHE_WORDS, CACHE_BYTES = 1_000_000, 40  # about 200 MB at most
_SCHEMA = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer(dict):
    """Ids of a text by a lower-casing tokenizer that drops white space.

    Such a tokenizer treats the stretches between spaces and line feeds one by
    one, so the ids of a text are those of its stretches in order.  The dict
    holds the ids of stretches met before, as little-endian 32-bit bytes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        #: Literals that the tokenizer takes for tokens of its own before it lower-cases or cuts anything.
        self.literals = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.tokenizer = Tokenizer.from_file(path)  # of stretches: a literal that appears by lower-casing is none
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model

    def __missing__(self, word: bytes) -> bytes:
        stem = word.rstrip(b".,")
        if stem and len(stem) < len(word) and stem.isalpha():  # letters, then a run of signs: two pieces to the tokenizer
            ids = self[stem] + self[word[len(stem) :]]
        elif word.isalpha():  # ASCII letters alone: nothing to normalise or to cut
            ids = np.array([t.id for t in self.model.tokenize(word.decode())], "<u4").tobytes()
        else:
            ids = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(literal in text for literal in self.literals):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.encode().lower().replace(b"\n", b" ").split(b" ")))


@lru_cache(1)
def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, so that its cache outlives a task."""
    return WordTokenizer(path)


def cuts(length: int, capacity: int = CAPACITY, tolerance: float = TOLERANCE) -> list[int]:
    """Lengths of the pieces of a document of ``length`` tokens, in order."""
    pieces = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        slot = capacity // k
        if slot - rest <= tolerance * slot:
            pieces.append(rest)
            break
        pieces.append(capacity // (k + 1))
        rest -= capacity // (k + 1)
    return pieces


class HarmonicPacker:
    """Open sequences by class.  ``add`` and ``finish`` yield (piece, sequence, offset)."""

    def __init__(self, first: int = 0, capacity: int = CAPACITY):
        self.capacity, self.next, self.open = capacity, first, {}

    def _close(self, pieces: list) -> Iterator[tuple[tuple, int, int]]:
        at = 0
        for piece in pieces:
            yield piece, self.next, at
            at += piece[2]
        self.next += 1

    def add(self, piece: tuple) -> Iterator[tuple[tuple, int, int]]:
        """piece: (anything, start, length, ...)"""
        k = self.capacity // piece[2]
        pieces = self.open.setdefault(k, [])
        pieces.append(piece)
        if len(pieces) == k:
            yield from self._close(self.open.pop(k))

    def finish(self, split) -> Iterator[tuple[tuple, int, int]]:
        """Join what is left end to end; ``split(piece, n)`` cuts a piece after n tokens."""
        pieces, room = [], self.capacity
        for piece in (p for k in sorted(self.open) for p in self.open[k]):
            while piece is not None:
                head, piece = split(piece, room) if piece[2] > room else (piece, None)
                pieces.append(head)
                room -= head[2]
                if not room:
                    yield from self._close(pieces)
                    pieces, room = [], self.capacity
        if pieces:
            yield from self._close(pieces)
        self.open = {}


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, tolerance: float = TOLERANCE) -> DataFrame:
    """Pack every row of ``docs`` (doc_id, text) into sequences of ``capacity`` ids.

    One row per piece: doc_id, start (the document's ids before it), length,
    ids_crc32 (of its little-endian unsigned 32-bit ids), doc_tokens (with the
    closing id 1), sequence_id and offset in that sequence.

    A null or empty text is the closing id alone.  A null doc_id stays null.
    Repeated rows are packed each for itself.  An empty table gives no rows;
    other columns are ignored.  A text of any length is cut, never shortened.
    """
    path = path or tokenizer_path()
    kind = docs.schema["doc_id"].dataType
    schema = _SCHEMA.format(kind=kind.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer(path)
        packer = HarmonicPacker(TaskContext.get().partitionId() << 40, capacity)
        rows: list[tuple] = []

        def emit(found) -> None:
            rows.extend((p[0], p[1], p[2], zlib.crc32(p[3]), p[4], seq, at) for p, seq, at in found)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.record_batch([pa.array(columns[0], ids.type), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        ids = None
        for batch in batches:
            ids = batch.column(0)
            for doc_id, text in zip(ids.to_pylist(), batch.column(1), strict=True):
                all_ids = tokens.encode(text.as_py() or "") + _END
                start, total = 0, len(all_ids) // 4
                for n in cuts(total, capacity, tolerance):
                    emit(packer.add((doc_id, start, n, all_ids[4 * start : 4 * (start + n)], total)))
                    start += n
                if len(rows) > 20_000:
                    yield flush()
        if ids is not None:
            emit(packer.finish(lambda p, n: ((p[0], p[1], n, p[3][: 4 * n], p[4]), (p[0], p[1] + n, p[2] - n, p[3][4 * n :], p[4]))))
            if rows:
                yield flush()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
