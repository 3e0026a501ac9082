from __future__ import annotations

import gzip
import hashlib
import io

import pytest

from sondera.llm import warc


def _pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, key string, first int")


def test_archives_round_trip(spark):
    long = "<p>équal " + "x" * 200
    rows = [(4, "http://a/é b", long), (2, "http://b", long), (9, None, long), (5, "http://c", "short"), (6, "http://d", "short"), (7, "", None), (8, "u", ""), (None, "n", "y" * 150), (None, "n2", "y" * 150), (3, "http://e", "z" * 100), (1, "http://f", "z" * 100), (10, "g", "z" * 99)]
    got = {}
    for r in warc.read(warc.write(_pages(spark, rows)), payloads=True).collect():
        got.setdefault(r["page_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, url, html in rows:
        data = (html or "").encode()
        r = next(x for x in got[i] if x["payload_digest"] == hashlib.sha256(data).hexdigest() and x["url"] == (url or "-"))
        assert r["payload_bytes"] == len(data)
        assert bytes(r["payload"]) == (data if r["record_type"] == "response" else b"")
    kinds = {i: (x[0]["record_type"], x[0]["refers_to"]) for i, x in got.items() if i is not None}
    assert kinds == {4: ("revisit", 2), 2: ("response", None), 9: ("revisit", 2), 5: ("response", None), 6: ("response", None), 7: ("response", None), 8: ("response", None), 3: ("revisit", 1), 1: ("response", None), 10: ("response", None)}
    assert all(x["record_type"] == "response" for x in got[None])


def test_empty_table_and_equal_ids(spark):
    assert warc.read(warc.write(_pages(spark, []))).count() == 0
    same = [(1, "a", "q" * 120), (1, "a", "q" * 120), (2, "a", "q" * 120)]
    got = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read(warc.write(_pages(spark, same))).collect())
    assert got == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]


def test_parts_are_cut_by_size(spark):
    rows = [(i, "u", f"{i}" * 300) for i in range(40)]
    manifest = warc.write(_pages(spark, rows), part_bytes=500)
    assert manifest.count() > 8 and manifest.agg({"n_records": "sum"}).first()[0] == 40
    assert warc.read(manifest).count() == 40


@pytest.mark.parametrize("version", [1, 2])
def test_arc_files(version):
    body = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi\n\n</p>"
    plain = b"just\nbytes"
    data = warc.arc_version_block("x.arc", version)
    data += warc.arc_record(version, "http://a/b c", "20010203040506", "text/html", body, "1.2.3.4")
    data += warc.arc_record(version, "dns:a", "2001", "text/dns; some type", plain)
    arcs = list(warc.parse_arc(data))
    assert [a.body for a in arcs] == [body, plain] and arcs[0].fields["URL"] == "http://a/b%20c" and arcs[1].fields["Content-type"] == "text/dns; some type"
    members = b"".join(gzip.compress(x) for x in (warc.arc_version_block("x.arc", version), data[len(warc.arc_version_block("x.arc", version)) :]))
    for source in (data, members):
        records = [next(warc.parse_warc(io.BytesIO(x))) for x in warc.convert_arc(source)]
        (h1, b1), (h2, b2) = records
        assert (b1, b2) == (body, plain)
        assert h1["WARC-Type"] == "response" and h2["WARC-Type"] == "resource"
        assert h1["WARC-Date"] == "2001-02-03T04:05:06Z" and h2["WARC-Date"] == "2001-01-01T00:00:00Z"
        assert h1["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(b"<p>hi\n\n</p>").hexdigest()
        assert h1["WARC-Record-ID"] != h2["WARC-Record-ID"] and h1["WARC-IP-Address"] == "1.2.3.4"


def test_broken_arc_files_are_errors():
    block = warc.arc_version_block("x", 1)
    with pytest.raises(ValueError):
        list(warc.parse_arc(block + b"http://a 1.2.3.4 2001 text/html 99\nshort\n"))
    with pytest.raises(ValueError):
        list(warc.parse_arc(block + b"http://a 5\nabcde\n"))
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"filedesc://x 0.0.0.0 2001 text/plain 6\n7 0 x\n\n"))
