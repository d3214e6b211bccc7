import random
import re

import pytest

from skarn.llm import quality_rules as q


def brute(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    n, rep = len(w), len(covered)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n


@pytest.fixture
def texts(spark, docs):
    r = random.Random(4)
    more = [" ".join(r.choice(["ab", "c", "é#", "d$", "long"]) + r.choice(["", "", "\n", "\t"]) for _ in range(n)) for n in (1, 2, 3, 49, 50, 51, 400)]
    more += ["same line\n" * 60, "\n \n\t\n", " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)), " ".join(f"W{i}X" for i in range(80)), "#" * 100]
    rows = [(100 + i, t) for i, t in enumerate(more)]
    return docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))


def test_counts_match_a_plain_count(texts):
    got = {r["doc_id"]: r for r in q.quality_report(texts).collect()}
    for r in texts.collect():
        g = got[r["doc_id"]]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"]) == brute(r["text"]), r["doc_id"]
        assert not (g["base_failed"] and g["kept"])
    assert q.quality_report(texts.limit(0)).count() == 0


def test_the_order_changes_no_verdict(texts):
    keep = [sorted(r["doc_id"] or -1 for r in q.filter_quality(texts, order=order).collect()) for order in (q.RULES, q.RULES[::-1])]
    assert keep[0] == keep[1] == sorted(r["doc_id"] or -1 for r in q.quality_report(texts).filter("kept").collect())
    assert 109 in keep[0]


def test_cheap_rules_that_reject_much_come_first(spark):
    docs = spark.createDataFrame([(i, "a" * (i % 10)) for i in range(100)], "doc_id long, text string")
    ticks = iter(range(1000))
    many = q.Rule("many", lambda m: m["word_chars"] > 1)
    some = q.Rule("some", lambda m: m["word_chars"] > 7)
    one = q.Rule("one", lambda m: m["word_chars"] == 1)
    none = q.Rule("none", lambda m: m["word_chars"] > 99)
    order = q.plan_order(docs, [none, some, one, many], clock=lambda: next(ticks))
    assert [r.name for r in order] == ["many", "one", "none", "some"]


def test_a_rules_cost_is_what_it_adds_to_an_empty_job(spark):
    docs = spark.createDataFrame([(i, "a" * (i % 10)) for i in range(100)], "doc_id long, text string")
    cheap, dear = q.Rule("cheap", lambda m: m["word_chars"] > 7), q.Rule("dear", lambda m: m["word_chars"] > 4)
    # a first job, an empty one (100), cheap (101, so it costs 1), dear (110, so it costs 10): by whole times dear would come first
    ticks = iter([0, 500, 0, 100, 0, 101, 0, 110])
    assert [r.name for r in q.plan_order(docs, [cheap, dear], clock=lambda: next(ticks))] == ["cheap", "dear"]


def test_columns_and_clean_rows_come_back_as_they_were(docs):
    clean = docs.limit(0).unionByName(docs.filter("doc_id = 5").selectExpr("doc_id", "'" + " ".join(f"word{i}x" for i in range(99)) + "' AS text", "lang", "source", "n_chars", "shard", "size", "fingerprint"))
    assert q.filter_quality(clean).collect() == clean.collect()
