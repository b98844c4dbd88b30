import gzip
import hashlib

import pytest

from marginalia.llm import warc


def test_both_versions_parse():
    for version in (1, 2):
        data = warc.arc_version_block("f", version, "20200102030405")
        data += warc.arc_record(7, "http://a/b c", b"one\n\ntwo\r\n\r\n", version, "20200102030405", "f", len(data))
        data += warc.arc_record(None, None, b"", version, "20200102030405", "f", len(data))
        first, second = warc.parse_arc(data)
        assert (first.url, first.date, second.url) == ("http://a/b%20c", "20200102030405", "-")
        head, payload = warc.split_http(first.block)
        assert payload == b"one\n\ntwo\r\n\r\n" and head["x-record-key"] == "7"
        record = warc.warc_record("f", first, None)
        (fields, block), = warc.parse_warc(record)
        assert block == first.block and fields["warc-date"] == "2020-01-02T03:04:05Z" and fields["warc-type"] == "response"


def test_broken_archives_are_reported():
    data = warc.arc_version_block("f", 1, "20200102030405")
    with pytest.raises(ValueError, match="declares 50 bytes"):
        list(warc.parse_arc(data + b"http://a 0.0.0.0 20200102030405 text/html 50\nshort"))
    with pytest.raises(ValueError, match="fields"):
        list(warc.parse_arc(data + b"http://a 20200102030405 text/html 0\n\n"))


def test_members_of_gzip_files():
    assert warc._inflated(gzip.compress(b"one") + gzip.compress(b"two")) == b"onetwo"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, key string, digest int")


def test_round_trip_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 6000)
    long, other = "é" * 500 + "\r\n\r\n", "WARC/1.0\r\n\r\n" * 100
    rows = [(i, f"http://h/{i}", long if i % 3 else other) for i in range(40)]
    rows += [(100, None, None), (101, "u v", ""), (102, "http://x", "short"), (103, "http://x", "short"), (104, "http://big", "z" * 200_000)]
    rows += [(200, "http://t", "t" * 1000), (200, "http://t", "t" * 1000), (None, "http://n", "t" * 1000)]
    got = [tuple(r) for r in warc.archived(pages(spark, rows)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    want = []
    top, used = {}, set()
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            top[h] = max(top.get(h, -1), i)
    for i, _, h in rows:
        raw = (h or "").encode()
        stored = len(raw) < 1000 or (i == top[h] and h not in used)
        if len(raw) >= 1000 and stored:
            used.add(h)
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if stored else "revisit", None if stored else top[h]))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty(spark):
    assert warc.archived(pages(spark, [])).count() == 0
