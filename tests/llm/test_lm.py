import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from skarn.llm import lm


def brute(rows, order=lm.ORDER, backoff=lm.BACKOFF):
    """Scores by dictionaries of counts, token by token, down the failure arcs."""
    held = [zlib.crc32(str(i if i is not None else "").encode()) % 5 == 1 for i, _ in rows]
    seqs = [[b" ", *lm.tokens(t), b"\n"] for _, t in rows]
    train = [s for s, h in zip(seqs, held) if not h]
    grams = Counter(tuple(s[i - k + 1 : i + 1]) for s in train for i in range(1, len(s)) for k in range(1, order + 1) if i - k + 1 >= 0)
    uni = {g[0]: c for g, c in grams.items() if len(g) == 1}
    n, v = sum(uni.values()), len(uni)
    once, twice = sum(c == 1 for c in uni.values()), sum(c == 2 for c in uni.values())
    d = (once + 1) / (once + 2 * twice + 3)
    met = lambda h: len(train) if h == (b" ",) else grams.get(h, 0)

    def probability(history, w):
        if not history:
            return ((uni[w] - d) if w in uni else d * v) / n if n else 1.0
        shorter = probability(history[1:], w)
        if not met(history):
            return shorter
        b = backoff[len(history) - 1]
        if grams.get((*history, w)):
            return (grams[(*history, w)] + b * shorter) / (met(history) + b)
        return b / (met(history) + b) * shorter  # the failure arc, then the shorter history's

    out = []
    for (i, _), h, s in zip(rows, held, seqs):
        base = sum(math.log10((uni.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in s[1:])
        score = sum(math.log10(probability(tuple(s[max(0, k - order + 1) : k]), s[k])) for k in range(1, len(s)))
        out.append((i is None, i or 0, h, len(s) - 1, sum(w in uni for w in s[1:]), n, base, score))
    return sorted(out)


@pytest.mark.parametrize(("chunk", "order"), [(5, 3), (1000, 2), (1000, 3), (40, 4)])
def test_scores_match_a_plain_traversal(spark, docs, chunk, order):
    backoff = (30.0, 5.0, 2.0)
    base = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 10_000]
    rows = base + [(50 + i, "the cat sat on the mat and the cat ran " * (i % 3) + f"Word{i % 7} again") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in lm.score_texts(frame, order, backoff, chunk_words=chunk, range_bytes=500).collect())
    want = brute(rows, order, backoff)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:6] == w[:6] and np.allclose(g[6:], w[6:], rtol=1e-9)


def test_a_states_arcs_sum_to_one(spark):
    """All known words and one unknown, after a known word."""
    rows = [(i, "a b a c a d b") for i in range(12)]
    words = ["a", "b", "c", "d", "zzz"]
    held = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 5 == 1)
    more = [i for i in range(2000, 4000) if zlib.crc32(str(i).encode()) % 5 == 1][: len(words) + 1]
    frame = spark.createDataFrame(rows + [(held, "a")] + list(zip(more, [f"a {w}" for w in words])), "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in lm.score_texts(frame).collect()}
    want = {i: s[7] for s in brute(rows + [(held, "a")] + list(zip(more, [f"a {w}" for w in words]))) for i in [s[1]]}
    assert all(abs(score[i] - want[i]) < 1e-9 for i in score)


def test_held_out_text_scores_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in lm.score_texts(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > 0.95 * sum(r["base_score"] for r in rows)
    assert sum(r["score"] > r["base_score"] for r in rows) > 0.8 * len(rows)


def test_words_met_once_leave_every_score_finite(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    train = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 != 1][:4]
    rows = list(zip(train, ["a b c", "d e f", "g h", "k l"])) + list(zip(held, ["b z", "q"]))
    got = sorted((False, r["doc_id"], r["score"]) for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert all(math.isfinite(s) and s < 0 for _, _, s in got)
    assert np.allclose([s for _, _, s in got], [s[7] for s in brute(rows)])


def test_a_text_that_occurs_twice_scores_above_one_that_occurs_once(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choice(words) for _ in range(80)) for _ in range(200)]
    train = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 != 1][:220]
    rows = list(zip(train, texts + texts[:20]))
    got = {i: s for i, s in ((r["doc_id"], r["score"] - r["base_score"]) for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect())}
    twice, once = [got[i] for i in train[:20]], [got[i] for i in train[20:200]]
    assert min(twice) > max(once)


def test_packing_of_numbers_round_trips():
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert np.array_equal(lm.unpack_sorted(lm.pack_sorted(x)), x) and len(lm.unpack(lm.pack(x[:0]))) == 0


def test_odd_tables(spark, docs):
    assert lm.score_texts(docs.limit(0)).count() == 0
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 1)
    one = lm.score_texts(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()[0]
    assert (one["n_known"], one["train_tokens"], one["score"], one["held_out"]) == (0, 0, 0.0, True)
