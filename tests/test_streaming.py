import json
import time

from skarn.streaming import debounce, sync


def test_bursts_end_by_quiet_or_by_the_cap():
    assert debounce.split_burst([0, 100, 499, 900, 2000]) == [(0, 3), (3, 4), (4, 5)]
    assert debounce.split_burst(list(range(0, 6300, 300))) == [(0, 10), (10, 20), (20, 21)]
    assert debounce.split_burst([]) == []


def events(n):
    return [("w", t, f"p{t % 7}") for t in range(0, 300 * n, 300)] + [("v", 0, "a"), ("v", 100, "a"), ("v", 5000, "b")]


def test_stream_and_batch_give_the_same_bursts(spark, tmp_path):
    rows = events(21)
    batch = debounce.capped_batches(spark.createDataFrame(rows, "key string, ts_ms long, path string"))
    want = sorted((r["key"], r["first_ms"], r["last_ms"], tuple(r["paths"])) for r in batch.collect())
    assert ("v", 0, 100, ("a",)) in want and len([w for w in want if w[0] == "w"]) == 3
    folder = tmp_path / "in"
    folder.mkdir()
    rows = sorted(rows, key=lambda r: r[1])
    for i in range(0, len(rows), 9):
        (folder / f"{i:03d}.json").write_text("".join(json.dumps({"key": k, "ts": f"1970-01-01T00:01:{t / 1000:06.3f}Z", "path": p}) + "\n" for k, t, p in rows[i : i + 9]))
        time.sleep(0.02)
    for hour in (1, 2):  # each lets the watermark pass what came before
        (folder / f"z{hour}.json").write_text(json.dumps({"key": "end", "ts": f"1970-01-01T0{hour}:00:00Z", "path": "x"}) + "\n")
        time.sleep(0.02)
    feed = spark.readStream.schema("key string, ts timestamp, path string").option("maxFilesPerTrigger", 1).json(str(folder)).withWatermark("ts", "0 seconds")
    q = debounce.capped_stream(feed).writeStream.format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["key"], r["first_ms"] - 60_000, r["last_ms"] - 60_000, tuple(r["paths"])) for r in spark.table("bursts").collect())
    assert [g for g in got if g[0] != "end"] == want


def test_a_feed_keeps_a_table_current_and_batches_count_once(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    put = lambda name, rows: (folder / name).write_text("".join(json.dumps(dict(zip(("path", "ts", "type", "hash"), r))) + "\n" for r in rows))
    table = sync.KeyedTable(spark, str(tmp_path / "table"), "path string, hash string", "path")
    run = lambda: sync.keep_current(sync.change_feed(spark, str(folder), "path string, ts long, type string, hash string"), table, "ts", str(tmp_path / "c")).awaitTermination(60)
    put("1.json", [("a", 1, "changed", "h1"), ("b", 2, "changed", "h2"), ("a", 3, "changed", "h3"), ("c", 1, "changed", "x"), ("c", 2, "removed", None)])
    run()
    assert {tuple(r) for r in table.read().collect()} == {("a", "h3"), ("b", "h2")}
    put("2.json", [("b", 5, "removed", None), ("d", 6, "changed", "h4")])
    run()
    assert {tuple(r) for r in table.read().collect()} == {("a", "h3"), ("d", "h4")}
    table.apply(spark.createDataFrame([("z", "z")], "path string, hash string"), spark.createDataFrame([], "path string"), 0)
    assert {tuple(r) for r in table.read().collect()} == {("a", "h3"), ("d", "h4")}


def test_vectors_are_kept_made_or_put_off(spark):
    notes = spark.createDataFrame([("a", "t", "h"), ("b", "t", "new"), ("c", "x" * 9000, "h")], "id string, text string, content_hash string")
    stored = spark.createDataFrame([("a", "h"), ("b", "old")], "id string, content_hash string")
    assert {tuple(r) for r in sync.hot_embeddings(notes, stored).collect()} == {("a", "keep"), ("b", "embed"), ("c", "pending")}
