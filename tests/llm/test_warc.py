import base64
import hashlib
import io
import random

import pytest
import zstandard

from ledgerloom.llm import warc


def _rows():
    return [(1, "https://a/1", "<p>é one</p>", 5), (2, "https://a/2", "<p>é one</p>", 5), (3, None, None, 5), (4, "x\r\ny", "", 5), (5, "u", "long " * 200_000, 5), (None, "n", "<p>é one</p>", 5), (None, "m", "alone", 5), (7, "d", "twice", 5), (7, "d", "twice", 5)]


def test_round_trip(spark):
    pages = spark.createDataFrame(_rows(), "page_id long, url string, html string, payload int").repartition(3)
    folder = warc.archive_folder(spark)
    got = warc.read_archives(warc.write_archives(pages, folder, warc.train_dictionary(pages)), folder).collect()
    assert len(got) == 9 and all(r.problem is None for r in got)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    texts = {i: (h or "").encode() for i, _, h, _ in _rows() if i is not None}
    for i, text in texts.items():
        for r in by[i]:
            assert r.payload_bytes == len(text) and r.payload_digest == base64.b32encode(hashlib.sha1(text).digest()).decode()
            assert r.payload == (text if r.record_type == "response" else None)
    assert [(i, by[i][0].record_type, by[i][0].refers_to) for i in (1, 2, 3, 4, 5)] == [(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None)]
    assert sorted((r.record_type, r.refers_to) for r in by[None]) == [("response", None), ("revisit", 2)]
    assert [r.record_type for r in by[7]] == ["response"] * 2
    assert by[3][0].url is None and by[4][0].url == "x%0D%0Ay"


def test_many_archives_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 60_000)
    folder = warc.archive_folder(spark)
    pages = spark.range(0, 300, 1, 1).selectExpr("id AS page_id", "'u' AS url", "repeat(sha2(cast(id AS string), 512), 20) AS html")
    manifest = warc.write_archives(pages, folder, b"raw dictionary " * 10)
    assert manifest.count() > 1
    assert warc.read_archives(manifest, folder, False).filter("problem IS NULL AND record_type = 'response'").count() == 300
    empty = pages.limit(0)
    assert warc.read_archives(warc.write_archives(empty, folder, warc.train_dictionary(empty)), folder).count() == 0


def _archive(*records, dictionary=b"some raw dictionary"):
    out = io.BytesIO()
    archive = warc.Archive(out, dictionary)
    for r in records:
        archive.add(r)
    return out.getvalue()


def test_broken_archives_are_errors():
    good = warc.record_bytes(1, "u", b"abc", None, False)
    data = _archive(good, good)
    assert list(warc.read_records(io.BytesIO(data))) == [good, good]
    for bad in (data[8:], data[:-3], data[:6], data[:12], data[:-9] + b"XXXXXXXXX"):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(bad)))
    packed = zstandard.ZstdCompressor().compress(b"some raw dictionary")
    head = warc.struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed
    assert list(warc.read_records(io.BytesIO(head + data[8 + 19 :]))) == [good, good]


def test_broken_records_are_flagged():
    good = warc.record_bytes(1, "u", b"abc", None, False)
    assert warc.parse_record(good)[-1] is None and warc.parse_record(warc.record_bytes(1, None, b"abc", 9, True))[3] == 9
    for bad in (good[:-1], good + b"x", good.replace(b"abc", b"abd"), good.replace(b"WARC/1.1", b"WRAC/1.1"), good.replace(b"WARC-Date", b"WARC-Dote"), good.replace(b"Content-Length: 3", b"Content-Length: 4"), b"", b"\xff\r\n\r\n", good.replace(b"response\r\nWARC-R", b"request\r\nWARC-R")):
        assert warc.parse_record(bad)[-1]


def test_equal_to_a_plain_grouping_of_pages(spark):
    rng = random.Random(12)
    bodies = [None, "", "<p>é</p>", "hot", "x" * 70_000] + [f"<html>{'ab' * rng.randint(1, 50)}</html>" for _ in range(12)]
    rows = [(k * 3 % 211, f"http://h/{k}", "hot" if k % 3 == 0 else rng.choice(bodies)) for k in range(150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    folder = warc.archive_folder(spark)
    read = warc.read_archives(warc.write_archives(pages, folder, warc.train_dictionary(pages)), folder, keep_payload=False, strict=True)
    newest = {}
    for page, _, html in rows:
        newest[html or ""] = max(newest.get(html or "", -1), page)
    want = set()
    for page, _, html in rows:
        payload = (html or "").encode()
        first = newest[html or ""]
        want.add((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if page == first else "revisit", None if page == first else first))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read.collect()]
    assert len(got) == len(rows) and set(got) == want
