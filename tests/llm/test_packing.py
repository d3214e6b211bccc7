import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skarn.llm import packing


@given(st.integers(1, 20_000), st.sampled_from([64, 100, 2048]))
def test_cuts_cover_a_document_and_fill_their_slots(length, capacity):
    pieces = packing.cuts(length, capacity)
    assert sum(pieces) == length and min(pieces) > 0
    for n in pieces:
        slot = capacity // (capacity // n)
        assert slot - n <= packing.TOLERANCE * slot


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "Hello", " ", "\n", "there."])).map("".join)))
def test_cached_words_give_the_tokenizers_ids(text):
    got = np.frombuffer(packing.tokenizer(packing.tokenizer_path()).encode(text), "<u4").tolist()
    plain = Tokenizer.from_file(packing.tokenizer_path())
    assert got == plain.encode(text, add_special_tokens=False).ids


def test_every_id_lies_in_one_piece_and_sequences_have_no_gaps(docs):
    rows = packing.pack_documents(docs).collect()
    plain = Tokenizer.from_file(packing.tokenizer_path())
    ids = {r["doc_id"]: plain.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert pieces.keys() == ids.keys()
    for doc, own in pieces.items():
        covered = np.zeros(len(ids[doc]), int)
        for start, length, crc, total in own:
            assert total == len(ids[doc])
            covered[start : start + length] += 1
            assert crc == zlib.crc32(np.array(ids[doc][start : start + length], "<u4").tobytes())
        assert set(covered.tolist()) == {2 if doc == 0 else 1}  # document 0 is there twice


def test_padding_is_small(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack_documents(docs).collect()
    used = {}
    for r in rows:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert sum(used.values()) > 0.96 * packing.CAPACITY * len(used)


def test_an_empty_table_gives_no_rows(docs):
    assert packing.pack_documents(docs.limit(0)).count() == 0
