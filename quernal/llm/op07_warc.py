"""WARC segment reassembly.

A WARC record that was cut in segments is a first record with WARC-Segment-Number 1 and continuation records that name it in
WARC-Segment-Origin-ID; the last one states WARC-Segment-Total-Length. `reassemble` groups by origin, orders by segment number,
verifies the total length, splits HTTP headers from the body and decodes chunked transfer framing. Segments meet in one shuffle by origin;
a task holds one record at a time beside its Arrow batch.

Input columns: record_id, origin_id (null on first records), segment_number, total_length (null but on the last), target_uri,
payload. Result: origin_id, target_uri, n_segments, payload_bytes, state, headers (names in small letters), body.

state is 'ok', or the first of these that holds: 'orphan' (no segment 1), 'conflict' (two different payloads for a
number), 'gap' (a number is missing), 'untold' (several segments and no total length), 'length' (the total isn't the sum), 'framing' (chunked framing that
can't be read to its end). body is null unless the state is ok.

Defined cases: rows without both record_id and origin_id can't be placed and are dropped. A null payload is empty. A null segment number counts as 1
on a first record and as missing ('gap') on a continuation. Repeated rows count once. A payload without a header end is all body, with no
headers. Bytes after the last chunk and its trailer are ignored. An empty table gives an empty result; extra columns are not read.

`segment` writes such records from pages, which makes exact round trips possible.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernal.session import ship

SEGMENT = 2048
_SEGMENTS = "record_id string, origin_id string, segment_number int, total_length bigint, target_uri string, payload binary"
_RECORDS = "origin_id string, target_uri string, n_segments int, payload_bytes bigint, state string, headers map<string,string>, body binary"


def chunked(body: bytes, step: int = 700) -> bytes:
    """body in chunked transfer framing, chunks of growing size, some with an extension."""
    out, at, k = [], 0, 0
    while at < len(body):
        part = body[at : at + step + 97 * (k % 5)]
        out.append(b"%x%s\r\n%s\r\n" % (len(part), b";n=%d" % k if k % 3 == 2 else b"", part))
        at += len(part)
        k += 1
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(data: bytes) -> bytes | None:
    """The body in chunked framing, None if it breaks off, before the blank line after the last chunk too, or a size can't be read."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            return None
        size = data[at:end].split(b";")[0].strip()
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            return None
        n = int(size, 16)
        at = end + 2
        if n == 0:
            ended = data.startswith(b"\r\n", at) or data.find(b"\r\n\r\n", at) >= 0
            return b"".join(out) if ended else None
        if data[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(data[at : at + n])
        at += n + 2


def decoded(payload: bytes) -> tuple[dict[str, str], bytes | None]:
    """Headers and body of an HTTP response."""
    head, mark, body = payload.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        return {}, payload
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if "chunked" in headers.get("transfer-encoding", "").lower():
        return headers, unchunked(body)
    return headers, body


def assembled(parts: list[tuple[bool, int | None, int | None, bytes]]) -> tuple[str, bytes]:
    """State and payload of one origin's segments: (is first record, number, total length, payload)."""
    seen = {(1 if first and n is None else n, p) for first, n, _, p in parts}
    if not any(first for first, *_ in parts):
        return "orphan", b""
    numbers = sorted((n if n is not None else -1) for n, _ in seen)
    if len(set(numbers)) < len(numbers):
        return "conflict", b""
    if numbers != list(range(1, len(numbers) + 1)):
        return "gap", b""
    payload = b"".join(p for _, p in sorted(seen))
    totals = {t for *_, t, _ in parts if t is not None}
    if not totals:
        return ("ok", payload) if len(seen) == 1 else ("untold", b"")
    return ("ok", payload) if totals == {len(payload)} else ("length", b"")


def _records(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("origin_id", pa.string()), ("target_uri", pa.string()), ("n_segments", pa.int32()), ("payload_bytes", pa.int64()), ("state", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary())])
    for b in it:
        for at in range(0, b.num_rows, 256):
            rows = []
            for origin, uri, parts in zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True):
                given = [(p["first"], p["n"], p["total"], p["payload"] or b"") for p in parts]
                state, payload = assembled(given)
                headers, body = decoded(payload) if state == "ok" else ({}, None)
                if state == "ok" and body is None:
                    state = "framing"
                rows.append((origin, uri, len(set(given)), sum(len(g[3]) for g in set(given)), state, list(headers.items()), body))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def reassemble(segments: DataFrame) -> DataFrame:
    """A row for each origin; see the module."""
    ship(segments.sparkSession)
    key = F.coalesce("origin_id", "record_id").alias("origin_id")
    part = F.struct(F.col("origin_id").isNull().alias("first"), F.col("segment_number").cast("int").alias("n"), F.col("total_length").cast("bigint").alias("total"), F.col("payload").cast("binary").alias("payload"))
    keyed = segments.filter("record_id is not null or origin_id is not null").select(key, F.col("target_uri").alias("uri"), part.alias("part"))
    grouped = keyed.groupBy("origin_id").agg(F.min("uri").alias("target_uri"), F.collect_list("part").alias("parts"))
    return grouped.mapInArrow(_records, _RECORDS)


def _writer(size: int):  # noqa: ANN202
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 256):
                rows = []
                for record, page, uri, html in zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True):
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\nX-Page-Id: {'' if page is None else page}\r\n\r\n"
                    payload = head.encode() + chunked((html or "").encode())
                    n = -(-len(payload) // size)
                    for k in range(n):
                        total = len(payload) if k == n - 1 and n > 1 else None
                        rows.append((f"{record}-{k + 1}" if k else record, record if k else None, k + 1, total, uri, payload[k * size : (k + 1) * size]))
                kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["record_id", "origin_id", "segment_number", "total_length", "target_uri", "payload"])

    return run


def segment(pages: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Chunked HTTP responses of the pages as WARC records in segments of at most `size` bytes."""
    ship(pages.sparkSession)
    record = F.concat(F.lit("urn:md5:"), F.md5(F.concat_ws("\u0001", F.col("page_id").cast("string"), "url", "html")))
    return pages.select(record, "page_id", "url", "html").mapInArrow(_writer(size), _SEGMENTS)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, url, state, n_segments, html, html_bytes: pages cut in segments and put together again. Equal rows make one record."""
    whole = reassemble(segment(pages))
    return whole.select(F.expr("try_cast(headers['x-page-id'] as bigint)").alias("page_id"), F.col("target_uri").alias("url"), "state", "n_segments", F.decode("body", "UTF-8").alias("html"), F.octet_length("body").cast("bigint").alias("html_bytes"))


def oracle(size: int = SEGMENT) -> str:
    """The round trip in DuckDB SQL: the framing's length gives the number of segments."""
    head = len("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\nX-Page-Id: \r\n\r\n")
    return f"""
WITH RECURSIVE p AS (SELECT DISTINCT page_id, url, html, CAST(octet_length(encode(html)) AS BIGINT) AS n FROM pages),
c AS (SELECT page_id, n, 0 AS k, CAST(0 AS BIGINT) AS done, CAST(5 AS BIGINT) AS framed FROM p
  UNION ALL SELECT page_id, n, k + 1, done + least(n - done, 700 + 97 * (k % 5)), framed + least(n - done, 700 + 97 * (k % 5)) + 4 +
    length(printf('%x', least(n - done, 700 + 97 * (k % 5)))) + CASE WHEN k % 3 = 2 THEN 3 + length(CAST(k AS VARCHAR)) ELSE 0 END FROM c WHERE done < n),
f AS (SELECT page_id, max(framed) AS framed FROM c GROUP BY page_id)
SELECT page_id, url, 'ok' AS state, CAST((framed + {head} + length(CAST(page_id AS VARCHAR)) + {size - 1}) // {size} AS INTEGER) AS n_segments, html, n AS html_bytes
FROM p JOIN f USING (page_id)
"""
