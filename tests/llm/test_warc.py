import base64
import hashlib

import pytest

from lumenframe.llm import warc
from lumenframe.llm.warc import ArcRecord, arc_file, archived, parse_arc, parse_warc, timestamp, warc_record

SCHEMA = "page_id long, url string, html string, record string, page string, id long, top long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "r", "p", 1, 1) for i, u, h in rows], SCHEMA)


def sha(h):
    return base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    records = [ArcRecord("http://a/b", "1.2.3.4", "20010203040506", "text/html; charset=x", 200, b"HTTP/1.0 200 OK\r\n\r\nbody\n\n"), ArcRecord("dns:x", "0.0.0.0", "200102030405", "text/dns", None, b""), ArcRecord("http://c", "::1", "20010203040506", "image/gif", 404, bytes(range(256)) * 9)]
    got = list(parse_arc(arc_file(records, version)))
    assert [(g.url, g.ip, g.date, g.content_type, g.body) for g in got] == [(r.url, r.ip, r.date, r.content_type, r.body) for r in records]
    assert [g.status for g in got] == ([200, None, 404] if version == 2 else [None] * 3)


@pytest.mark.parametrize("bad", [b"http://x 1 2 3 4\nbody", arc_file([ArcRecord("u", "i", "d", "t", 1, b"abcdef")], 1)[:-4], arc_file([], 1).replace(b"1 0 lumen", b"7 0 lumen"), arc_file([], 2) + b"http://x y z\n"])
def test_broken_arc_is_refused(bad):
    with pytest.raises(ValueError):
        list(parse_arc(bad))


def test_warc_record():
    r = ArcRecord("http://a", "1.2.3.4", "20010203040506", "text/html", 200, b"HTTP/1.0 200 OK\r\nX-Page-Id: 7\r\nContent-Length: 4\r\n\r\nbody")
    data = warc_record(r) + b"\r\n\r\n" + warc_record(r, 9) + b"\r\n\r\n"
    (a, block), (b, short) = parse_warc(data)
    assert a["warc-type"] == "response" and block == r.body and b["warc-type"] == "revisit" and short.endswith(b"\r\n\r\n")
    assert a["warc-payload-digest"] == b["warc-payload-digest"] == "sha1:" + sha("body")
    assert b["warc-refers-to"] == warc.record_id("9", sha("body")) and a["warc-date"] == timestamp("20010203040506") == "2001-02-03T04:05:06Z"
    plain = warc_record(ArcRecord("dns:x", "0.0.0.0", "20010203040506", "text/dns", None, b"1"))
    assert next(parse_warc(plain))[0]["warc-type"] == "resource"
    with pytest.raises(ValueError):
        list(parse_warc(data[:-20]))


ROWS = [(1, "http://a/é ?q=1 2", "x\r\n\r\nWARC/1.1\r\n"), (2, None, "same"), (5, "u", "same"), (3, "u", "same"), (4, "u", None), (6, "u", ""), (None, "u", "null id"), (None, "u", "null id"), (None, "u", "same"), (8, "u", "twice"), (8, "u", "twice"), (9, "u", "🎉" * 5000), (10, "u", "\x00\x01")]


@pytest.mark.parametrize("least", [0, 5])
def test_archives_equal_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "ARC_BYTES", 20)
    got = archived(pages(spark, ROWS), least_bytes=least).collect()
    tops = {}
    for i, _, h in ROWS:
        if len((h or "").encode()) >= least and i is not None:
            tops[h or ""] = max(tops.get(h or "", i), i)
    want = []
    for i, _, h in ROWS:
        top = tops.get(h or "")
        own = top is None or i == top
        want.append((i, len((h or "").encode()), sha(h), "response" if own else "revisit", None if own else top))
    key = lambda t: [repr(x) for x in t]
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=key) == sorted(want, key=key)


def test_empty_table(spark):
    assert archived(pages(spark, [])).collect() == []
