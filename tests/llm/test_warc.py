import gzip
import hashlib
import io
import json
import zipfile

import pytest

from skarn.llm import warc


def pages(spark):
    long = "<p>é</p>" * 50
    rows = [(3, "http://a/1", long), (1, "http://a/2\r\nX: y", long), (2, None, "short"), (4, "u", "short"), (5, "u", None), (5, "u", None), (None, None, long), (1, "again", long), (6, "big", "x" * 300_000)]
    return spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, payload int").repartition(3)


def test_pages_come_back_from_the_archives(spark):
    rows = warc.archive_round_trip(pages(spark)).collect()
    got = sorted((r["page_id"] is None, r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["url"]) for r in rows)
    want = []
    for r in pages(spark).collect():
        data = (r["html"] or "").encode()
        revisit = (r["html"] or "").startswith("<p>") and r["page_id"] != 1
        want.append((r["page_id"] is None, r["page_id"] or 0, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None, r["url"] or ""))
    assert got == sorted(want, key=lambda w: tuple(map(str, w))) or sorted(map(str, got)) == sorted(map(str, want))
    assert warc.archive_round_trip(pages(spark).limit(0)).count() == 0


def test_files_are_packages_that_other_readers_open(spark, tmp_path):
    packages = warc.write_packages(pages(spark), str(tmp_path), package_bytes=2000, date="2026-01-02T03:04:05Z").collect()
    assert len(packages) > 1 and sum(p["records"] for p in packages) == 9
    ids = []
    for p in packages:
        with zipfile.ZipFile(p["path"]) as z:
            assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
            lines = [json.loads(x) for x in z.read(warc.INDEX).splitlines()]
            data = z.read(warc.MEMBER)
        for x in lines:
            headers, _ = warc.parse_record(gzip.decompress(data[x["offset"] : x["offset"] + x["length"]]))
            assert headers["warc-date"] == "2026-01-02T03:04:05Z"
            ids.append(headers["warc-record-id"])
    assert len(ids) == 9 and sum(i.startswith("<urn:uuid:") for i in ids) == 1
    (tmp_path / "part-000000-left-by-a-lost-task.wacz").write_bytes(b"half a package")
    listed = spark.createDataFrame(packages)
    assert warc.read_packages(listed, 3).count() == 9


def test_members_are_read_by_range(tmp_path):
    with open(tmp_path / "p", "wb") as f:
        w = warc.PackageWriter(f)
        for i in range(50):
            w.add("u", warc.page_record(str(i), "u", b"%d" % i * 5000, hashlib.sha256(b"%d" % i * 5000).hexdigest(), None, "d"))
        w.close()
    data, reads = (tmp_path / "p").read_bytes(), []
    rows = [warc.page_row(*r) for r in warc.read_records(lambda at, n: reads.append(n) or data[at : at + n], len(data))]
    assert [r[0] for r in rows] == [str(i) for i in range(50)] and len(reads) >= 50 + 4 and max(reads[1:]) < len(data) / 4


def build(members, compress=zipfile.ZIP_STORED, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", compress) as z:
        for name, data in members:
            with z.open(name, "w", force_zip64=True) as f:
                f.write(data)
        z.comment = comment
    return out.getvalue()


@pytest.mark.parametrize("limit", [None, 10])
def test_zip64_directories(monkeypatch, limit):
    if limit:  # every size, offset and count overflows
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    data = build([("a", b"x" * 50), ("dir/b", b"hello world, hello")], comment=b"ends with PK\x05\x06 inside")
    monkeypatch.undo()
    reads = []

    def read(at, n):
        reads.append(n)
        return data[at : at + n]

    members = warc.central_directory(read, len(data))
    at, n = warc.member_at(read, members, "dir/b")
    assert data[at : at + n] == b"hello world, hello"
    if limit:
        assert b"PK\x06\x06" in data


def test_damage_is_an_error():
    data = build([("a", b"x" * 5000)], zipfile.ZIP_DEFLATED)
    read = lambda at, n: data[at : at + n]
    with pytest.raises(ValueError, match="compressed"):
        warc.member_at(read, warc.central_directory(read, len(data)), "a")
    with pytest.raises(ValueError, match="not a ZIP"):
        warc.central_directory(lambda at, n: b"\0" * n, 5000)
    record = warc.page_record("1", "u", b"payload", "0" * 64, None, "2026-01-01T00:00:00Z")
    with pytest.raises(ValueError, match="digest"):
        warc.page_row(*warc.parse_record(record))
