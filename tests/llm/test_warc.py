from __future__ import annotations

import base64
import hashlib

import pytest

from lorekeep.llm import warc

SCHEMA = "page_id bigint, url string, html string, payload string, seq string"
ROWS = [
    (3, "http://a/ b\r\nX: y", "<p>same</p>"), (1, "http://a/1", "<p>same</p>"), (2, None, "<p>same</p>"),
    (None, "http://n", "<p>same</p>"), (4, "http://e", None), (5, "http://e", ""), (6, "http://ü/é", "ünïcode"),
    (7, "u", "x" * 300_000), (7, "u", "x" * 300_000), (None, None, "alone"),
]


def pages(spark):
    return spark.createDataFrame([(*r, "p", "s") for r in ROWS], SCHEMA)


def digest(html) -> str:
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def order(row):
    return tuple((v is None, v) for v in row)


def test_headers_and_edge_rows(spark, folder):
    warc.write_archive(pages(spark), f"{folder}/a")
    got = [tuple(r)[:5] for r in warc.read_headers(spark, f"{folder}/a").collect()]
    want = []
    taken = set()
    for page, url, html in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0)):
        first = min((p for p, _, h in ROWS if (h or "") == (html or "") and p is not None), default=None)
        response = digest(html) not in taken
        taken.add(digest(html))
        kind = ("response", None) if response else ("revisit", first)
        want.append((page, len((html or "").encode()), digest(html), *kind))
    assert sorted(got, key=order) == sorted(want, key=order)
    assert spark.read.parquet(f"{folder}/a/payloads").count() == len({h or "" for _, _, h in ROWS})


def test_records_are_rebuilt_exactly(spark, folder):
    warc.write_archive(pages(spark), f"{folder}/a", least_bytes=5)
    records = warc.read_records(spark, f"{folder}/a").collect()
    assert sorted(bytes(r["payload"]) for r in records) == sorted((h or "").encode() for _, _, h in ROWS)
    for r in records:
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        size = int(fields[b"Content-Length"])
        assert block[size:] == b"\r\n\r\n"
        http, _, body = block[:size].partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK")
        assert body == (b"" if fields[b"WARC-Type"] == b"revisit" else bytes(r["payload"]))
        assert (b"WARC-Refers-To" in fields) == (fields[b"WARC-Type"] == b"revisit")
        assert not (fields[b"WARC-Type"] == b"revisit" and len(r["payload"]) < 5)


def test_damage_is_found_and_empty_works(spark, folder):
    warc.write_archive(pages(spark), f"{folder}/a")
    spark.read.parquet(f"{folder}/a/payloads").selectExpr(
        "address", "unhex(concat(hex(payload), '00')) as payload", "copies"
    ).write.parquet(f"{folder}/b/payloads")
    spark.read.parquet(f"{folder}/a/records").write.parquet(f"{folder}/b/records")
    with pytest.raises(Exception, match="does not match its address"):
        warc.read_headers(spark, f"{folder}/b").collect()
    warc.write_archive(pages(spark).limit(0), f"{folder}/c")
    assert warc.read_headers(spark, f"{folder}/c").collect() == []
