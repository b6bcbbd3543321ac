"""WARC archives: written by tasks, read back by byte ranges.

Writing: each record is a gzip member of its own.  Equal payloads (by SHA-1, a second digest
and length) keep one ``response``, the others are ``revisit`` records without a payload that
carry the payload's length and digest.  Tasks write whole files below a shared folder and
return what they wrote; only files that a finished task returned belong to the archive, so a
lost or repeated task leaves nothing behind that would be read.

Reading: tasks take byte ranges of files, scan for the gzip magic, take a candidate only if
it decodes to a WARC header, and own the records that start inside their range; the last one
is read beyond the range's end.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, explode_salts, salt_of, shared_path, stage

FILE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
#: Tasks that read ranges, at most; more ranges share them.
MAX_TASKS = 20_000
READ_BYTES = 1 << 20
#: Compressed bytes decoded at once.
STEP_BYTES = 1 << 14
MIN_REVISIT_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
                 "refers_to bigint, digest_ok boolean, payload binary, path string, start bigint, fault string")


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it (``file:/x`` and plain paths included)."""
    if re.match(r"file:/[^/]", path):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                  min_bytes: int = MIN_REVISIT_BYTES, salts: int = SALTS) -> DataFrame:
    """``(page_id, url, payload, refers_to)``: ``refers_to`` is null for responses.

    Of equal payloads of at least ``min_bytes`` bytes, the smallest id is the response; rows
    that share that id and payload are all responses.  A null payload counts as empty.  A null
    id comes last; payloads whose ids are all null are all responses.
    """
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    key = ["__sha", "__h", "__len"]
    rows = (pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"),
                         body.cast("binary").alias("payload"))
            .withColumns({"__sha": F.sha1("payload"), "__h": F.xxhash64("payload"), "__len": F.octet_length("payload"),
                          "__salt": salt_of(F.col("page_id"), salts)}))
    first = (rows.groupBy(*key).agg(F.min("page_id").alias("__first"),
                                    F.bit_or(F.expr("shiftleft(1L, __salt)")).alias("__salts"))
             .select(*key, "__first", explode_salts("__salts", salts).alias("__salt")))
    again = (F.col("__len") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("__first"))
    return rows.join(first, [*key, "__salt"]).select("page_id", "url", "payload",
                                                     F.when(again, F.col("__first")).alias("refers_to"))


def _header(fields: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8") + b"\r\n"


def _clean(url: str) -> str:
    """A header value: control characters percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    digest = base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\n" + _header([("Content-Type", "text/html; charset=utf-8"),
                                             ("Content-Length", str(len(payload)))])
    block = http + (payload if refers_to is None else b"")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"),
              ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", _clean(url)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
               ("Content-Length", str(len(block)))]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + _header(fields) + block + b"\r\n\r\n") + z.flush()


def write_archives(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``rows`` (of ``with_revisits``) below ``folder``; ``(path, bytes, records)`` of each file.

    The result is a written table: the files it names are those of finished tasks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_fs(folder)
        store.create_dir(base, recursive=True)
        out, path, size, n = None, "", 0, 0
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            nonlocal out, size, n
            if out is not None:
                out.close()
                done.append((f"{folder}/{path}", size, n))
            out, size, n = None, 0, 0

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    path = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{base}/{path}", compression=None)
                member = record(*row)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pylist([{"path": p, "bytes": s, "records": k} for p, s, k in done], schema=pa.schema(
            [("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return stage(rows.select("page_id", "url", "payload", "refers_to").mapInArrow(
        run, "path string, bytes bigint, records bigint"), "warc-files")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def _page(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


def parse(body: bytes) -> dict | None:
    """The fields of one decoded record; None for records other than response and revisit."""
    head, _, rest = body.partition(b"\r\n\r\n")
    f = _fields(head)
    kind = f.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    told = f.get("content-length", "")
    known = told.isascii() and told.isdigit()
    # without a length the block ends where the record does
    block = rest[:int(told)] if known else rest.removesuffix(b"\r\n\r\n")
    http, _, payload = block.partition(b"\r\n\r\n")
    short = known and len(rest) < int(told)
    told = f.get("warc-payload-digest", "").removeprefix("sha1:")
    whole = kind == "response"
    found = base32_sha1(payload) if whole else told
    size = _fields(http).get("content-length", "")
    return {"page_id": _page(f.get("warc-record-id")), "url": f.get("warc-target-uri"),
            "payload_bytes": len(payload) if whole else int(size) if size.isascii() and size.isdigit() else 0,
            "payload_digest": found, "record_type": kind, "refers_to": _page(f.get("warc-refers-to")),
            "digest_ok": found == told or not told, "payload": payload if whole else None,
            "fault": "short" if short else None if known else "no length"}


def read_range(store: fs.FileSystem, path: str, start: int, end: int, read_bytes: int = READ_BYTES,
               cut: list[int] | None = None) -> Iterator[tuple[int, bytes]]:
    """``(start, decoded member)`` of every WARC member that starts in ``[start, end)``.

    ``cut`` gets the start of a member that begins like a WARC record and lacks its end.
    """
    with store.open_input_file(path) as f:
        size, buf, low = f.size(), b"", 0

        def ahead(at: int, n: int) -> int:
            """Place of ``at`` in the buffer, which holds ``n`` bytes from there unless the file ends."""
            nonlocal buf, low
            if not (low <= at and min(at + n, size) <= low + len(buf)):
                buf, low = f.read_at(max(0, min(max(read_bytes, n), size - at)), at), at
            return at - low

        def member(at: int) -> tuple[bytes, int] | None:
            """The member at ``at`` and where it ends; None if there is no WARC record."""
            z, parts, head, first = zlib.decompressobj(31), [], b"", at
            try:
                while not z.eof:
                    i = ahead(at, 1)
                    chunk = buf[i:i + STEP_BYTES]
                    if not chunk:
                        if cut is not None and head == VERSION:
                            cut.append(first)
                        return None
                    at += len(chunk)
                    parts.append(z.decompress(chunk))
                    if len(head) < len(VERSION):
                        head = (head + parts[-1])[:len(VERSION)]
                        if not VERSION.startswith(head):
                            return None
            except zlib.error:
                return None
            return (b"".join(parts), at - len(z.unused_data)) if head == VERSION else None

        at = start
        while at < end:
            i = ahead(at, len(MAGIC))
            hit = buf.find(MAGIC, i)
            if hit < 0:
                at = max(low + len(buf) - len(MAGIC) + 1, at + 1)
                continue
            at += hit - i
            if at >= end:
                return
            found = member(at)
            if found:
                yield at, found[0]
            at = found[1] if found else at + 1


def read_archives(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row for each response and revisit record of ``files (path, bytes)``.

    A revisit has no payload; its length and digest are those of the payload it stands for.
    ``digest_ok`` tells whether a response's payload has the digest its header names; ``fault`` is null, or
    "no length" (a record without one ends where its member does) or "short" (fewer bytes than it names).  A
    member that the file's end cuts is a row of ``record_type`` "cut" with its place alone.  Empty
    files and files without a WARC member give no rows.

    A payload that is an archive itself, kept uncompressed, looks like records to a range that starts inside it.
    ``write_archives`` cannot make one: its payloads are UTF-8, which never holds the magic's second byte
    behind the first.  Read foreign archives of archives with ranges of whole files.
    """
    ranges = files.where("bytes > 0").select(
        "path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1,
                                              F.lit(range_bytes).cast("bigint"))).alias("start"))
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                            ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                            ("digest_ok", pa.bool_()), ("payload", pa.binary()), ("path", pa.string()),
                            ("start", pa.int64()), ("fault", pa.string())])
        assert schema.names == names
        for b in batches:
            for path, size, start in zip(*(c.to_pylist() for c in b.columns)):
                store, inner = open_fs(path)
                held, held_bytes, cut = [], 0, []
                for at, body in read_range(store, inner, start, min(start + range_bytes, size), cut=cut):
                    row = parse(body)
                    if row:
                        held.append(row | {"path": path, "start": at})
                        held_bytes += len(body)
                    if held_bytes >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, held_bytes = [], 0
                held += [{"record_type": "cut", "path": path, "start": at} for at in cut]
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    # a task for each range: adaptive execution would join these short rows into one task
    return ranges.repartition(max(1, min(ranges.count(), MAX_TASKS))).mapInArrow(run, RECORD_SCHEMA)


def round_trip(pages: DataFrame, **how) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read all records back.

    Null htmls are empty payloads, rows repeated whole are records like any other, columns beside the three
    named play no part, an empty table gives an empty result.
    """
    files = write_archives(with_revisits(pages, **how), shared_path(pages.sparkSession, "warc"))
    return read_archives(files)
