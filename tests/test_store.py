"""Stores behind pointers, handles, citations, envelopes, locks."""

import json
import os
from datetime import datetime, timedelta

import pytest

from skarn.operators import memory, synthesis
from skarn.plans import store
from skarn.sources import pointers
from skarn.streaming import schedule


def test_pointers_only_grow_and_one_writer_wins(spark, tmp_path):
    folder = str(tmp_path)
    assert pointers.newest(spark, folder) is None
    for n, v in ((0, "a"), (1, "b"), (10, "c"), (2, "d")):
        pointers.add(spark, folder, n, v)
    assert pointers.newest(spark, folder) == (10, "c")
    with pytest.raises(FileExistsError):
        pointers.add(spark, folder, 10, "c")
    (tmp_path / "b").mkdir()
    pointers.drop_before(spark, folder, 10)
    assert pointers.newest(spark, folder) == (10, "c") and not (tmp_path / "b").exists()


def test_a_vault_is_synced_embedded_and_found_stale(spark, tmp_path):
    vault = tmp_path / "vault"
    vault.mkdir()
    (vault / "billing.md").write_text("---\ntags: [money]\n---\n# Billing\nInvoices go out monthly\n")
    (vault / "plain.md").write_text("plain words\n")
    memo = store.MemoryStore(spark, str(tmp_path / "m"), str(vault))
    assert memo.status()["staleness"] == "unknown" and not memo.status()["initialized"]
    assert {(r["path"], r["type"]) for r in memo.sync().collect()} == {("billing.md", "inbox"), ("plain.md", "inbox")}
    assert memo.status()["staleness"] == "fresh" and not memo.status()["embeddings_ready"]
    assert memo.embed().count() == 2 and memo.status()["embeddings_ready"]
    row = memo.notes.rows().filter("path = 'plain.md'").withColumns({"text": store.F.lit("other words"), "content_hash": store.F.lit("x")})
    assert memo.upsert(row).filter("text = 'other words'").count() == 1
    assert memo.vectors.rows().count() == 1 and memo.embed().count() == 2
    (vault / "plain.md").write_text("changed\n")
    assert memo.status()["staleness"] == "stale"


def test_handles_are_checked_kept_and_evicted(spark, tmp_path):
    handles = store.HandleStore(spark, str(tmp_path / "h"))
    segments = spark.createDataFrame([(0, "a", "text a"), (1, "b", None)], "seq int, ref string, text string")
    names = [f"rh_{i:016x}" for i in range(3)]
    for n in names:
        handles.write(n, segments, most=2)
    assert handles.read(names[0]) == (None, "none", [])
    rows, state, lost = handles.read(names[2])
    assert [r["text"] for r in rows.collect()] == ["text a"] and (state, lost) == ("partial", ["W_SEGMENT_MISSING: b"])
    assert handles.read("rh_../../etc")[2] == ["E_HANDLE_INVALID"]
    with pytest.raises(ValueError, match="E_HANDLE_INVALID"):
        handles.write("x", segments)


def test_a_long_list_is_cut_and_has_a_handle(spark):
    rows = spark.createDataFrame([(f"p{i:02}", i) for i in range(12)], "path string, n int")
    first, handle, segments = store.truncated(rows, 5, ["path"], "path")
    assert [r["path"] for r in first.orderBy("path").collect()] == [f"p{i:02}" for i in range(5)] and store.HANDLE.fullmatch(handle)
    assert {r["ref"]: json.loads(r["text"])["n"] for r in segments.collect()} == {f"p{i:02}": i for i in range(12)}
    assert store.truncated(rows, 12, ["path"], "path")[1] is None


def test_known_items_need_a_citation_that_is_there(spark):
    known, unknown = synthesis.parse_answer('x ```json\n{"known": [{"text": " a ", "citation_ids": ["c1", "no", 3]}, {"text": "b", "citation_ids": ["no"]}, 7], "unknown": [{"text": "u"}]}\n```')
    assert unknown == [{"text": "u", "reason": None, "handle": None}] and synthesis.parse_answer("nothing") == ([], []) == synthesis.parse_answer("[1]")
    items = spark.createDataFrame([(k["text"], k["citation_ids"]) for k in known] + [("", ["c1"])], "text string, citation_ids array<string>")
    good, bare = synthesis.check_citations(items, spark.createDataFrame([("c1",)], "id string"))
    assert [tuple(r) for r in good.collect()] == [("a", ["c1"])]
    extra = spark.createDataFrame([("b", "sem_citacao_valida", None), (" ", None, None)], "text string, reason string, handle string")
    assert [tuple(r) for r in memory.merge_unknowns(bare, extra).collect()] == [("b", "sem_citacao_valida", None)]


def test_links_go_both_ways_and_envelopes_keep_codes(spark):
    facts = spark.createDataFrame([("a", None, None), ("b", None, None)], "id string, superseded_by string, supersedes string")
    out, refused = synthesis.link_supersedence(facts, spark.createDataFrame([(" a", "b "), ("", "b")], "origin string, current string"))
    assert {tuple(r) for r in out.collect()} == {("a", "b", None), ("b", None, "a")} and refused.first()["code"] == "E_MEMORY_V2_SUPERSEDENCE"
    rows = spark.createDataFrame([("E_X: prose", ["W_A: b", "prose", "W_A"], 1.0), ("all well", ["prose"], 0.5)], "message string, limitations array<string>, confidence double")
    assert [tuple(r) for r in synthesis.concise(rows).collect()] == [("E_X", ["W_A"]), (None, None)]


def test_readers_rely_on_confirmed_paths_and_symbols_are_found_by_part(spark):
    relations = spark.createDataFrame([("1", "path", "a", "m", "presumed"), ("1", "path", "b", "m", "confirmed"), ("1", "tag", "c", "m", "presumed"), ("1", "tag", "d", "m", "odd")], "note string, entity_kind string, entity string, mechanism string, confidence string")
    assert {r["entity"] for r in memory.consumable(relations).collect()} == {"b", "c"}
    symbols = spark.createDataFrame([(f"p{i:02}", "getUserName", i) for i in range(25)] + [("a", "user", 1), ("z", "us", 1)], "path string, name string, start_line int")
    got = [tuple(r) for r in memory.resolve_symbols(spark.createDataFrame([("User",), ("us",), ("none",)], "name string"), symbols).collect()]
    users = sorted(x for x in got if x[0] == "User")
    assert len(users) == 20 and users[0] == ("User", "a", "user", 1) and users[-1][1] == "p18"
    assert len([x for x in got if x[0] == "us"]) == 20 and {x[0] for x in got} == {"User", "us"}


def test_locks_and_schedules(tmp_path):
    path = str(tmp_path / "lock")
    with schedule.exclusive(path) as mine:
        assert mine
        with schedule.exclusive(path, timeout=0.1) as other:
            assert not other
    assert not os.path.exists(path)
    (tmp_path / "lock").write_text(json.dumps({"pid": 2**22 + 1, "at": 0}))  # no such process
    with schedule.exclusive(path, timeout=0.1) as mine:
        assert mine
    now = datetime(2026, 1, 2)
    assert schedule.due(None, timedelta(days=1), now) and schedule.due(now - timedelta(days=1), timedelta(days=1), now)
    assert not schedule.due(now, timedelta(days=1), now) and not schedule.due(None, timedelta(days=1), now, running=True)
