import hashlib
import math
import random
import re
import time

import pytest

from skarn.llm import pii

PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


ALPHABET = ["a", "b.", "@", "1", "22", "255", ".", "-", " ", "+", "(", ")", "4111 1111 1111 1111", "4111111111111111", "\n", "é", "x@y.zz", "9.8.7.6", "+12 (3) 45-67.89", "%", "_", "..", "@@", "  ", "256", "007"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    out = ["".join(r.choice(ALPHABET) for _ in range(r.randint(1, 30))) for _ in range(1500)]
    return out + [None, "", "1" * 20_000, "1 " * 20_000, "1." * 20_000, "a" * 50_000 + "@", "a@b" + ".c" * 20_000, "+1" + "(" * 20_000, "😀 a@b.cc 😀 1.2.3.4", "00000000000000000000000000000000000000000000001.2.3.4"]


def test_spans_match_the_plain_patterns(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in pii.privacy_report(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = brute(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (text or "")[:200]
        assert [r[f"n_{k}"] for k, _ in PLAIN] == [sum(s[0] == k for s in want) for k, _ in PLAIN]
        assert r["spans"].startswith(joined)


def corpus(spark):
    rows = [(i, f"common words here number{'abcdefghij'[i % 10]}\nwrite to Zaphodia now at zed@mail.org please{'xyzuv'[i % 5] * (1 + i // 5)}\ncommon") for i in range(10)]
    rows += [(100 + i, "common words here\nwrite now please common text of other kinds") for i in range(200)]
    return spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_terms_that_only_occur_with_an_entity_are_added(spark):
    got = {r["doc_id"]: r["spans"] for r in pii.privacy_report(corpus(spark)).collect()}
    for i in range(10):
        text = corpus(spark).collect()[i]["text"]
        at = text.index("Zaphodia")
        assert got[i].split(",")[1:] == [f"removed:{at}:{at + 8}"]
    assert all(not got[100 + i] for i in range(200))


def test_sanitised_texts_hold_no_entity_and_clean_rows_are_unchanged(spark):
    docs = corpus(spark)
    out = {r["doc_id"]: r for r in pii.sanitise(docs).collect()}
    assert pii.sanitise(docs).columns == docs.columns
    for r in docs.collect():
        if r["doc_id"] < 100:
            assert "[EMAIL]" in out[r["doc_id"]]["text"] and "Zaphodia" not in out[r["doc_id"]]["text"] and "zed@" not in out[r["doc_id"]]["text"]
            assert out[r["doc_id"]]["n_chars"] == len(out[r["doc_id"]]["text"])
        else:
            assert out[r["doc_id"]] == r


def test_odd_rows(docs):
    rows = pii.privacy_report(docs).collect()
    assert len(rows) == docs.count() and all(r["spans"] == "" for r in rows)
    assert pii.privacy_report(docs.limit(0)).count() == 0
    assert sorted(map(str, pii.sanitise(docs).collect())) == sorted(map(str, docs.collect()))


def test_disclosing_terms_are_treated_in_texts_without_the_entity(spark):
    rows = [(i, f"mail Zaphodia at zed@mail.org today number{i}", 0) for i in range(100)]
    rows += [(100 + i, f"text by Zaphodia, other{i}", 0) for i in range(5)] + [(200, rows[0][1], 0), (201, None, None)]
    rows += [(1000 + i, f"text mail today plain{i}", 7) for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    out = {r["doc_id"]: r for r in pii.sanitise(docs).collect()}
    spans = {r["doc_id"]: r["spans"] for r in pii.privacy_report(docs).collect()}
    assert len(out) == len(rows)
    for i, text, n in rows:
        if "Zaphodia" in (text or ""):
            at = text.index("Zaphodia")
            assert f":{at}:{at + 8}" in spans[i] and "Zaphodia" not in out[i]["text"] and out[i]["n_chars"] == len(out[i]["text"])
        else:
            assert spans[i] == "" and (out[i]["text"], out[i]["n_chars"]) == (text, n)


def test_terms_on_other_lines_and_short_names_disclose(spark):
    rows = [(i, f"Xy Zaphodia\nfirst street{i}\n\nplain words\nzed@mail.org") for i in range(5)] + [(100 + i, f"plain words first street{i % 5}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert all(out[i] == f" \nfirst street{i}\n\nplain words\n[EMAIL]" for i in range(5))
    assert all(out[i] == t for i, t in rows if i >= 100)


def test_many_matches_are_placed_as_by_the_plain_pattern(spark):
    text = "é " + " , ".join(f"u{i}@x{i}.org" for i in range(1500)) + " 1.2.3.4"
    got = pii.privacy_report(spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id long, text string")).collect()
    want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(text))
    assert {r["doc_id"]: r["spans"] for r in got} == {1: want, 2: want, 3: ""}


def plain_disclosure(rows):
    """Terms that disclose an entity, by sets of texts."""
    n, entities, terms, weight = len(rows), {}, {}, {}
    for _, text in rows:
        weight[text] = weight.get(text, 0) + 1
    for text in weight:
        bare, at = "", 0
        for kind, a, b in sorted(brute(text), key=lambda s: s[1]):
            entities.setdefault((kind, text[a:b].lower()), set()).add(text)
            bare, at = bare + text[at:a] + " ", b
        bare += text[at:]
        found = {w.lower() for w in re.findall(r"[^\W\d_]+", bare) if len(w) >= 3 or (len(w) == 2 and w[0].isupper())}
        for w in {x.lower() for x in re.findall(r"[^\W\d_]+", text)}:
            terms.setdefault(w, [set(), set()])[1].add(text)
        for w in found:
            terms[w][0].add(text)
    total = lambda texts: sum(weight[t] for t in texts)
    out = set()
    for own in entities.values():
        for w, (candidate, everywhere) in terms.items():
            both = own & candidate
            if len(both) >= pii.SUPPORT and len(own) >= pii.SUPPORT:
                n_e, n_t, n_b = total(own), max(total(everywhere), total(both)), total(both)
                if n_e < n and math.log(n * n_b / (n_e * n_t)) / math.log(n / n_e) >= pii.GENERALISE:
                    out.add(w)
    return out


def test_disclosing_terms_match_plain_sets(spark):
    r = random.Random(8)
    people = [(f"Name{chr(97 + i)}", f"p{i % 7}@mail.org", f"10.0.0.{i}") for i in range(12)]
    rows = []
    for i in range(400):
        name, mail, ip = r.choice(people)
        words = " ".join(r.choice(["plain", "words", "here", "Ab", "of", "rare" + chr(97 + r.randrange(20))]) for _ in range(8))
        rows.append((i, f"{words} {r.choice([name, name, ''])} {r.choice([mail, mail + ' ' + ip, ''])} {r.choice(['x', 'yy'])}"))
    rows += [(1000 + i, rows[i % 5][1]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["term"] for r in pii.disclosing_terms(docs, pii.evidence(docs)).select("term").distinct().collect()}
    assert got == plain_disclosure(rows) and got


def test_a_page_of_two_thousand_addresses_gives_no_square(spark):
    page = " ".join(f"user{i}@host{i}.org term{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(2000))
    docs = spark.createDataFrame([(i, page + f" copy{'abc'[i]}") for i in range(3)] + [(10 + i, f"other text {i}") for i in range(50)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in pii.privacy_report(docs).collect()}
    assert got[0]["n_email"] == 2000 and got[0]["spans"].count("removed") > 1900 and time.perf_counter() - began < 60


def shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    time.sleep(0.5)
    executors = sc.statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_texts_without_terms_stay_where_they_lie(spark):
    r = random.Random(3)
    noise = lambda: "".join(r.choice("!#$&*=~^|<>{}[]") for _ in range(4000))
    rows = [(i, f"mail Zaphodia at zed@mail.org {noise()}") for i in range(5)] + [(100 + i, f"mail at {noise()}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if keys and terms were too many to broadcast
    try:
        before = shuffled(spark)
        got = {x["doc_id"]: x["spans"] for x in pii.privacy_report(docs).collect()}
        moved = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert {i for i, spans in got.items() if spans} == set(range(5)) and all("removed:5:13" in got[i] for i in range(5)) and len(got) == len(rows)
    assert 0 < moved < 0.25 * sum(len(t) for _, t in rows)


def test_a_full_sieve_and_dealt_copies_change_no_result(spark, monkeypatch):
    rows = [tuple(x) for x in corpus(spark).collect()]
    docs = spark.createDataFrame(rows + [(500 + i, *rows[i % 4][1:]) for i in range(40)], corpus(spark).schema).repartition(6)
    report, clean = (sorted(map(str, f(docs).collect())) for f in (pii.privacy_report, pii.sanitise))
    monkeypatch.setattr(pii, "MOST_BITS", 64)
    monkeypatch.setattr(pii, "MANY", 3)
    assert sorted(map(str, pii.privacy_report(docs).collect())) == report and sorted(map(str, pii.sanitise(docs).collect())) == clean
    assert sum("removed:" in x for x in report) == 50


def test_a_sieve_misses_none(spark):
    wanted = pii.stash(spark.range(1000).selectExpr("cast(id * 7 as string) as v"))
    passed = {x["v"] for x in spark.range(70_000).selectExpr("cast(id as string) as v").filter(pii._sieve(wanted, "v")(pii.F.col("v"))).collect()}
    assert {str(i * 7) for i in range(1000)} <= passed and len(passed) < 10_000
    assert spark.range(50).selectExpr("cast(id as string) as v").filter(pii._sieve(wanted.limit(0), "v")(pii.F.col("v"))).count() == 0
