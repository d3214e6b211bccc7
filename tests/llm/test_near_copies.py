import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from skarn.llm import near_copies, simhash
from tests.llm.test_simhash import brute_fingerprint


def plain(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_first(texts):
    """For each text the first one it reaches over near copies, 2-bit SimHashes and equal texts."""
    sets, fps = [plain(t) for t in texts], [brute_fingerprint(t) for t in texts]
    label = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if (fps[i] ^ fps[j]).bit_count() <= 2 or (both and 5 * both >= 4 * len(sets[i] | sets[j])):
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return label


def family(r, words, n, changes):
    out = []
    for _ in range(n):
        w = list(words)
        for at in r.sample(range(len(w)), changes):
            w[at] = f"new{r.getrandbits(30)}"
        out.append(" ".join(w))
    return out


def test_the_stage_keeps_one_of_each_class_that_five_word_shingles_join(spark):
    r = random.Random(4)
    texts = ["", None, "a b", "A  b", "one two three four five"]
    for changes in (1, 2, 3, 4, 5, 6, 8, 12):
        words = [f"w{r.getrandbits(20)}" for _ in range(200)]
        texts += [" ".join(words), *family(r, words, 4, changes)]
    chain = [f"c{r.getrandbits(20)}" for _ in range(150)]  # neighbours are near copies, the ends are not
    texts += [" ".join(chain[i * 12 : i * 12 + 100]) for i in range(4)] + [" ".join(chain[i * 8 : i * 8 + 100]) for i in range(6)]
    order = list(range(len(texts)))
    r.shuffle(order)
    docs = spark.createDataFrame([(i, texts[k]) for i, k in enumerate(order)], "doc_id long, text string").repartition(3)
    label = brute_first([texts[k] for k in order])
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    got = sorted(x["doc_id"] for x in stage(spark, docs, "").collect())
    assert got == [i for i in range(len(order)) if label[i] == i]
    assert len(got) < simhash.deduplicate(docs).count()


def test_classes_are_those_of_all_pairs():
    r = np.random.default_rng(5)
    base = np.unique(r.integers(0, 1 << 63, 60, np.uint64))
    sets = [np.unique(np.concatenate((r.choice(base, r.integers(40, 60), False), r.integers(0, 1 << 63, r.integers(0, 4), np.uint64)))) for _ in range(80)]
    label = list(range(80))
    for i, j in combinations(range(80), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    assert near_copies.classes(sets).tolist() == label and 1 < len(set(label)) < 80
