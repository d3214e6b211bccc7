import random

import pytest
import xxhash

from skarn.llm import url_filter as u


def brute(url, rules, listed):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])]

    def fits(h, p):
        return host and (host == h or host.endswith("." + h)) and path.startswith(p)

    found = max(((len(h + p), len(h), h + p, v) for v, h, p in rules if fits(h, p)), default=None)
    if found:
        return host, path, found[2], found[3]
    return host, path, None, "block" if any(fits(h, p) for _, h, p in listed) else "allow"


def test_urls_are_judged_as_by_brute_force(spark):
    r = random.Random(7)
    hosts = ["a.NET", "net", "x.example.net", "example.net", "EXAMPLE.com", "b.example.com", "q.org", "org", "anet", "m.ads-track.example.com", "ads-track.example.com.", "é.org", "..net", "h:80", ""]
    paths = ["", "/", "/en/", "/en", "/en/1?x=/de/", "/de/2#y", "/fr/é", "?q", "#f", "/fr"]
    urls = [f"{r.choice(['http', 'https', ''])}://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "a:b://c.net/://d", "http://a.net/" + "x" * 100_000]
    pages = spark.createDataFrame([(i, x, "v") for i, x in enumerate(urls)], "page_id long, url string, verdict string")
    got = {x["page_id"]: x for x in u.filter_urls(pages).collect()}
    for i, x in enumerate(urls):
        g = got[i]
        assert (g["host"], g["path"], g["rule"], g["verdict"]) == brute(x, u.RULES, u.LISTED), x
    assert u.filter_urls(pages.limit(0)).count() == 0
    assert u.filter_urls(pages, [], []).filter("verdict <> 'allow'").count() == 0


def mapped(tmp_path, entries):
    (tmp_path / "list").write_bytes(u.build(entries))
    return u.DigestArray(str(tmp_path / "list"))


def test_a_large_list_from_a_table_and_a_host_of_many_labels(spark, monkeypatch):
    listed = spark.range(1_000_000).selectExpr("'block' AS verdict", "concat('h', id, '.list.test') AS host", "if(id % 2 = 0, '/x', '') AS path")
    long = "http://" + "a." * 200_000
    urls = ["http://h7.list.test/", "http://a.h8.list.test/x/y", "http://h8.list.test/y", "http://h1000000.list.test/", long + "h9.list.test/", long + "other.test/", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in u.filter_urls(pages, listed=listed).collect()}
    assert [got[i] for i in range(7)] == ["block", "block", "allow", "allow", "block", "allow", "allow"]
    monkeypatch.setattr(u, "MAX_ENTRIES", 10)
    with pytest.raises(ValueError, match="1000000 entries"):
        u.filter_urls(pages, listed=listed)


def test_equal_digests_are_told_apart_by_their_strings(monkeypatch, tmp_path):
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda s, *a: len(s) % 3)
    entries = [("block", f"h{i}", "/") for i in range(20)] + [("allow", "longer", "/p")]
    array = mapped(tmp_path, entries)
    assert [array.string(i).decode() if i >= 0 else None for i in array.match([("h3", "/"), ("h99", "/"), ("x.longer", "/path"), ("h19", "/z")])] == ["h3/", None, "longer/p", "h19/"]
