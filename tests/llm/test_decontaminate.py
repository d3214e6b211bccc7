import hashlib
import random
import re

from skarn.llm import decontaminate as d

WORD = r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def lowered(text):
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w = lowered(text)
    hit, who = set(), set()
    for item, t in items:
        own = lowered(t)
        n = min(10, len(own))
        for i in range(len(own) - n + 1) if n else ():
            for j in range(len(w) - n + 1):
                if w[j : j + n] == own[i : i + n]:
                    hit |= set(range(j, j + n))
                    who.add(item)
    names = sorted(str(i) for i in who if i is not None)
    return len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


def tables(spark):
    r = random.Random(6)
    words = ["Ab", "cd", "é1", "x"]
    items = [(i, " ".join(r.choice(words) for _ in range(n))) for i, n in enumerate((3, 10, 12, 30, 5, 0))] + [(7, None), (None, "null id item"), (2, "second text of two"), (11, "...")]
    texts = [" ".join(r.choice(words) for _ in range(n)) + "!" for n in (2, 9, 10, 200, 3000)]
    texts += [f"before, {items[3][1]}; after", items[3][1].upper().replace(" ", "\n--"), f"aa{items[1][1]}", "a null ID item b", None, "", "clean text alone"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    return docs, spark.createDataFrame(items, "item_id long, text string"), items


def test_hits_match_brute_force_in_one_part_and_in_several(spark):
    docs, benchmark, items = tables(spark)
    for part in (d.PART_WORDS, 12):
        got = {r["doc_id"]: r for r in d.contamination_report(docs, benchmark, part_words=part).collect()}
        for r in docs.collect():
            g = got[r["doc_id"]]
            assert (g["n_words"], g["n_hit"], g["n_items"], g["items_sha256"], g["contaminated"]) == brute(r["text"], items), r["doc_id"]


def test_contaminated_documents_go_and_clean_ones_stay_as_they_are(spark):
    docs, benchmark, items = tables(spark)
    clean = [r for r in docs.collect() if not brute(r["text"], items)[4]]
    assert sorted(d.decontaminate(docs, benchmark).collect()) == sorted(clean)
    cut = {r["doc_id"]: r["text"] for r in d.decontaminate(docs, benchmark, "spans").collect()}
    assert len(cut) == docs.count() and all(cut[r["doc_id"]] == r["text"] for r in clean)
    assert lowered(cut[5]) == ["before", "after"] and lowered(cut[8]) == ["a", "b"]


def test_empty_tables(spark, docs):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert d.contamination_report(docs, benchmark).filter("contaminated").count() == 0
    assert d.contamination_report(docs.limit(0), benchmark).count() == 0
