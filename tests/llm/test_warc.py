"""WARC round trip, byte ranges and foreign bytes."""

import base64
import gzip
import hashlib
import os
import zlib

import pytest
from pyspark.sql import functions as F

from propwise.llm import warc
from propwise.llm.common import shared_path

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id bigint, url string, html string"
#: Text that holds the magic and a whole member, which must not be taken for records of their own.
TRAP = "\x1f\x08" + "WARC/1.1\r\n\r\n" * 3
ROWS = [
    (7, "http://a/?q=1 2\r\nX: y", "<p>same</p>"), (3, None, "<p>same</p>"), (9, "http://c", "<p>same</p>"),
    (3, None, "<p>same</p>"), (4, "http://d", None), (5, "http://e", ""), (6, "http://é", "ünï" * 50_000),
    (None, "http://n", "<p>same</p>"), (None, None, "only null ids"), (8, "http://t", TRAP),
]


def sha(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def want(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        f = first.get(h or "")
        again = f is not None and f != i and len((h or "").encode()) >= least
        out.append((i, len((h or "").encode()), sha(h), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


@pytest.mark.parametrize("least", [0, 12])
def test_round_trip_of_odd_rows(spark, least):
    pages = spark.createDataFrame(ROWS, SCHEMA).withColumn("payload", F.lit(1)).repartition(3)
    back = warc.round_trip(pages, min_bytes=least)
    assert got(back) == want(ROWS, least) and all(r.digest_ok for r in back.collect())
    html = {(r.page_id, r.payload.decode()) for r in back.where("record_type = 'response'").collect()}
    assert html == {(i, h or "") for (i, _, h), w in zip(ROWS, ROWS)
                    if (i, len((h or "").encode()), sha(h), "response", None) in want(ROWS, least)}
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("range_bytes", [97, 4096, 1 << 22])
def test_byte_ranges_own_each_record_once(spark, range_bytes):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    if range_bytes == 97:
        pages = pages.limit(20)
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    files = warc.write_archives(warc.with_revisits(spark.createDataFrame(rows, SCHEMA)), shared_path(spark, "w"), file_bytes=60_000)
    assert got(warc.read_archives(files, range_bytes)) == want(rows)


def test_ranges_of_a_file_agree_with_a_plain_reader(tmp_path):
    # members holding stored (uncompressed) bytes full of magics, junk between members, a cut last member
    def member(body, level=6):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        return z.compress(body) + z.flush()

    records = [warc.record(i, f"http://x/{i}", os.urandom(50 * i) + warc.MAGIC * i, None) for i in range(40)]
    stored = member(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 30\r\n\r\n"
                    b"HTTP/1.1 200 OK\r\n\r\n" + (b"\x1f\x8b\x08" * 5)[:11], level=0)
    info = member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n")
    blob = info + b"".join(records[:20]) + stored + b"junk \x1f\x8b\x08 junk" + b"".join(records[20:]) + records[5][:30]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(blob)
    store, inner = warc.open_fs(str(path))
    whole = [(at, body) for at, body in warc.read_range(store, inner, 0, len(blob))]
    assert len(whole) == 42
    for step in (1, 13, 1000, 5000):
        for read in (64, 1 << 20):
            if step == 1 and read == 64:
                continue
            parts = [x for s in range(0, len(blob), step) for x in warc.read_range(store, inner, s, min(s + step, len(blob)), read)]
            assert parts == whole
    pages = [warc.parse(body) for _, body in whole]
    assert pages[0] is None and [p["page_id"] for p in pages[1:]] == [*range(20), 77, *range(20, 40)]
    assert gzip.decompress(records[3]).startswith(b"WARC/1.1\r\n")
    assert list(warc.read_range(store, inner, len(blob) - 3, len(blob))) == []
    cut = []
    assert len(list(warc.read_range(store, inner, 0, len(blob), cut=cut))) == 42 and cut == [len(blob) - 30]


def test_foreign_and_damaged_records_are_reported(spark, tmp_path):
    def member(body):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(body) + z.flush()

    http = b"HTTP/1.1 200 OK\r\n\r\n"
    none = member(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\n\r\n" + http + b"abc\r\n\r\n")
    odd = member(b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:page:2>\r\nContent-Length: x\r\n\r\n"
                 b"HTTP/1.1 200 OK\r\nContent-Length: many\r\n\r\n\r\n\r\n")
    short = member(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:3>\r\nContent-Length: 9999\r\n\r\n" + http + b"ab")
    whole = warc.record(4, "http://x", b"ok", None)
    last = warc.record(5, "http://y", os.urandom(4000), None)[:3000]
    path = tmp_path / "odd.warc.gz"
    blob = none + odd + short + whole + last
    path.write_bytes(blob)
    files = spark.createDataFrame([(str(path), len(blob), 5)], "path string, bytes bigint, records bigint")
    for step in (150, 1 << 20):
        rows = warc.read_archives(files, step).orderBy("start").collect()
        assert [(r.page_id, r.record_type, r.payload and bytes(r.payload), r.fault) for r in rows] == [
            (1, "response", b"abc", "no length"), (2, "revisit", None, "no length"), (3, "response", b"ab", "short"),
            (4, "response", b"ok", None), (None, "cut", None, None)]
        assert rows[-1].start == len(blob) - 3000 and rows[1].payload_bytes == 0
