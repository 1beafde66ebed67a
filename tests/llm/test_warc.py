import base64
import hashlib
from collections import defaultdict

import pytest
import zstandard

from tessera.llm import warc

ROWS = [(1, "http://a/x", "<p>one</p>"), (2, "http://a/é?q=1 2", "<p>one</p>"), (3, None, None), (4, "u", ""), (5, "u", "<p>one</p>"), (6, "u", "é" * 70_000), (None, "u", "<p>null</p>"), (7, "u", "<p>null</p>"), (8, "u", "x"), (8, "u", "x"), (9, "line\r\nbreak", "y")]


def brute(rows, least):
    keep = defaultdict(list)
    for p, _, h in rows:
        keep[h or ""].append(p)
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        best = max((x for x in keep[h or ""] if x is not None), default=None)
        visit = len(raw) >= least and best is not None and p != best
        out.append((str(p), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if visit else "response", best if visit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(2)
    # columns named like the operator's own
    pages = pages.selectExpr("*", "'x' AS key", "-1L AS keep_id", "7 AS n", "'y' AS payload", "'z' AS path")
    got = warc.round_trip(pages, least).collect()
    assert sorted([(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == brute(ROWS, least)


def test_payloads_and_urls_come_back(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    files = warc.write(pages, f"file://{tmp_path}/w", file_bytes=2000)
    assert files.count() > 1
    got = warc.load(files, payloads=True).collect()
    want = {p: (u, (h or "").encode()) for p, u, h in ROWS}
    for r in got:
        assert r.url == want[r.page_id][0]
        if r.record_type == "response":
            assert bytes(r.payload) == want[r.page_id][1]


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def archive(records, dictionary=b""):
    w = warc.Writer(dictionary)
    for r in records:
        w.add(r)
    return b"".join(w.parts)


def test_reader_checks_frames_and_records():
    good = warc.record(1, "http://a", b"payload")
    many = [warc.record(i, f"http://a/{i}", f"<html>{i} some words that repeat</html>".encode() * 9) for i in range(300)]
    trained = warc.train(many, 4096)
    assert trained and [r["page_id"] for r in warc.read(archive(many, trained))] == list(range(300))
    assert [r["page_id"] for r in warc.read(archive([good]))] == [1]
    data = archive([good])
    for broken in (data[:-3], data[8:], b"", data + b"xx", good):
        with pytest.raises((warc.Malformed, zstandard.ZstdError)):
            list(warc.read(broken))
    for broken in (good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"payload\r\n", b"paylord\r\n"), good[:-1], good.replace(b"WARC-Type: response", b"WARC-Type: other"), good.replace(b"WARC-Date", b"WARC Date:x"), good.replace(b"Content-Length: 7", b"Content-Length: 8")):
        with pytest.raises(warc.Malformed):
            warc.parse(broken)
