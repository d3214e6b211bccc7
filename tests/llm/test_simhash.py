import random
from itertools import combinations

import numpy as np
import xxhash

from skarn.llm import simhash


def brute_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    w = [x for x in w if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(fps):
    n = len(fps)
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations(range(n), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            a, b = root(i), root(j)
            label[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_fingerprints_match_a_plain_count():
    r = random.Random(1)
    texts = ["", None, "a", "A b", "x y Z", "é À ü\tq\nr", *(" ".join(r.choice(["Ab", "cd", "é", "f", "gh"]) for _ in range(n)) for n in (4, 50, 500))]
    for t in texts:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def near_family(r, n, centre, flips):
    out = {centre}
    while len(out) < n:
        x = r.choice(sorted(out)) if r.random() < 0.5 else centre
        for _ in range(r.randint(1, flips)):
            x ^= 1 << r.randrange(64)
        out.add(x)
    return sorted(out)


def near_pairs(fps):
    return {(i, j) for i, j in combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2}


def test_the_forest_finds_the_pairs_that_brute_force_finds(monkeypatch):
    """Runs of one to some hundred members, in one forest, also with few states held at once."""
    r = random.Random(2)
    runs = [near_family(r, 300, r.getrandbits(64), 3) + [r.getrandbits(64) for _ in range(200)]]
    runs += [near_family(r, n, r.getrandbits(64), 2) for n in (1, 2, 3, 7, 8, 9, 48, 49, 64, 65)] + [[0, (1 << 64) - 1], [r.getrandbits(64)]]
    r.shuffle(runs)
    fps = [np.array(x, np.uint64)[np.argsort(simhash.gray_rank(np.array(x, np.uint64)))] for x in runs]
    want, at = set(), 0
    for x in fps:
        want |= {(at + i, at + j) for i, j in near_pairs(x.tolist())}
        at += len(x)
    for states in (simhash.STATES, 100):
        monkeypatch.setattr(simhash, "STATES", states)
        a, b = simhash.search(np.concatenate(fps), np.array([len(x) for x in fps]))
        assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


def test_every_level_factors_what_its_leaves_share():
    r = random.Random(4)
    fps = np.array(near_family(r, 100, r.getrandbits(64), 3), np.uint64)
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    top = simhash.forest(fps, np.array([60, 40]))[0]
    for k, own in enumerate((fps[:60], fps[60:])):
        ones, zeros = np.bitwise_and.reduce(own), np.bitwise_and.reduce(~own)
        assert (top.pattern[k], top.agreed[k], top.last[k]) == (ones, ones | zeros, (59, 99)[k])


def test_gray_rank_inverts_the_gray_code():
    x = np.array([0, 1, 2, 3, 1 << 63, (1 << 64) - 1, 123456789], np.uint64)
    assert np.array_equal(simhash.gray_rank(x ^ (x >> np.uint64(1))), x)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def check_links(spark, fps, large):
    edges = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), large=large)
    got = {r["v"]: r["root"] for r in simhash.components(edges).collect()}
    want = brute_classes(fps)
    groups = {}
    for i, c in enumerate(want):
        groups.setdefault(c, []).append(signed(fps[i]))
    for members in groups.values():
        assert {got.get(m, m) for m in members} == {min(members)}


def test_links_and_classes_match_brute_force_in_both_layers(spark):
    r = random.Random(3)
    centre = r.getrandbits(64)
    fps = sorted({*near_family(r, 400, centre, 3), *near_family(r, 40, 0, 1), *(r.getrandbits(64) for _ in range(200)), (1 << 64) - 1})
    check_links(spark, fps, simhash.LARGE)
    check_links(spark, fps, 50)


def test_long_chains_become_one_class(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 201)], "a long, b long")
    got = {r["v"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 201: 200}


def test_documents_get_their_smallest_reachable_id(spark, docs):
    rows = simhash.near_duplicates(docs).collect()
    texts = docs.collect()
    assert len(rows) == len(texts)
    fps = [brute_fingerprint(r["text"]) for r in texts]
    label = brute_classes(fps)
    small = {}
    for r, c in zip(texts, label):
        if r["doc_id"] is not None:
            small[c] = min(small.get(c, r["doc_id"]), r["doc_id"])
    want = sorted(((r["doc_id"] is None, r["doc_id"] or 0, signed(f), small[c]) for r, f, c in zip(texts, fps, label)))
    assert want == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fp"], r["component_id"]) for r in rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_deduplicate_keeps_one_row_of_each_class_with_its_columns(docs):
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 4, 5, 6]
