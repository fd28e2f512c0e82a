"""WARC round trips, damage, and the order of records."""

import gzip
import hashlib

import pytest

from echograin.llm import shared, warc

SCHEMA = "page_id long, url string, html string, payload string"


def trip(spark, rows, **options):
    path = shared.new_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), path, **options)
    return path, warc.read_archives(spark, path, payloads=True).collect()


def want(rows):
    first = {}
    for page, _, html, _ in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        revisit = len(data) >= 100 and page is not None and first[html or ""] != page
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[html or ""] if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    long, big = "é" * 100, "x" * 300_000
    rows = [(3, "http://a/ b\r\n", long, "p"), (1, None, long, "p"), (2, "u", long, None), (4, "u", None, ""), (5, "u", "", ""), (6, "u", "short", ""), (7, "u", "short", ""), (8, "u", big, ""), (9, "u", big, ""), (9, "u", big, ""), (None, "u", "n", "")]
    _, got = trip(spark, rows)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want(rows)
    assert all(r.verified for r in got)
    assert {r.page_id: bytes(r.payload) for r in got if r.record_type == "response" and r.page_id in (1, 4, 8)} == {1: long.encode(), 4: b"", 8: big.encode()}


def test_hot_group_and_many_archives(spark):
    rows = [(k, "u", "h" * 200 if k % 3 else f"page {k}" * 30, "") for k in range(900)]
    path, got = trip(spark, rows, archive_bytes=20_000)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want(rows)
    assert len({r.archive for r in got}) > 4


def test_archives_are_plain_gzip_members(spark, tmp_path):
    path, got = trip(spark, [(k, "u", f"page {k}" * 40, "") for k in range(5)])
    text = b"".join(gzip.decompress(p.read_bytes()) for p in __import__("pathlib").Path(path.removeprefix("file:")).rglob("part-*"))
    assert text.count(b"WARC/1.1\r\n") == 5


def test_empty(spark):
    assert trip(spark, [])[1] == []


def member(**changes):
    return warc.record_bytes(1, "u", b"payload", changes.get("digest", hashlib.sha256(b"payload").hexdigest()), None, "1970-01-01T00:00:00Z")


def test_reader_checks_digests_and_framing():
    good = member()
    assert [r["verified"] for r in warc.records(good + b"\0\0" + good)] == [True, True]
    assert [r["verified"] for r in warc.records(member(digest="0" * 64))] == [False]
    with pytest.raises(warc.Damaged):
        list(warc.records(good[:-20]))
    with pytest.raises(warc.Damaged):
        list(warc.records(good + b"no member"))
    with pytest.raises(warc.Damaged):
        list(warc.records(gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n")))


def test_damaged_archive_is_a_row(spark, tmp_path):
    (tmp_path / "part-0.warc.gz").write_bytes(member() + member()[:50])
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(r.record_type for r in got) == ["damaged", "response"]
