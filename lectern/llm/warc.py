"""Legacy web archives: ARC version 1 and 2 streams converted to WARC 1.1, written, and read back.

An ARC stream is a version block (``filedesc://``) whose second line names the version and whose
third names the fields of the header lines, then records: one header line, as many bytes as it
declares, and a line feed.  The converter takes the layout of header lines from the version block,
cuts records by the declared lengths and makes of each the WARC headers that ARC lacks: a record
identifier (from the URI, the capture time and the payload digest, so that a rerun makes the same),
an ISO time, a type, and the SHA-1 of the payload in base 32.  Captures whose payload equals that of
an earlier page become ``revisit`` records that refer to the first one.

Archives are ordinary ``.warc.gz`` files: each record is a row that Spark's text writer ends with
the last line break of the record.  Files are read back as lines, so that neither side needs more
than a record in memory, and cut by the declared Content-Length.

Nulls: a null html is an empty payload, a null url becomes ``urn:page:<id>``.  A null page_id is
never the smallest of its group and is written as an empty id.  Rows that repeat the smallest id and
payload are all responses.  An empty table gives no records.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.plans.storage import materialize, new_path

#: Fixed values of the ARC format: the field lines of both versions.
ARC_FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:lectern:warc")
_EPOCH = "20240101000000"
SALT = 8


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_block(version: int, name: str) -> bytes:
    """The version block that opens an ARC stream."""
    body = b"%d 0 lectern\n%s\n" % (version, ARC_FIELDS[version])
    head = f"filedesc://{name} 0.0.0.0 {_EPOCH} text/plain"
    if version == 2:
        head += f" 200 - - 0 {name}"
    return f"{head} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, uri: str, date: str, block: bytes, offset: int, name: str) -> bytes:
    """One ARC record around an HTTP response."""
    uri = quote(uri, safe=":/?#[]@!$&'()*+,;=%~") or "urn:empty"
    head = f"{uri} 0.0.0.0 {date} text/html"
    if version == 2:
        head += f" 200 {hashlib.md5(block).hexdigest()} - {offset} {name}"
    return f"{head} {len(block)}\n".encode() + block + b"\n"


def read_arc(stream: bytes) -> Iterator[dict]:
    """Records of an ARC stream: the header fields by name, lower case, and the block.

    The version block can return within a stream (archives that were joined); its field line holds
    from there on.  A header line with another number of fields, or a length that isn't a number or
    runs past the end, raises ValueError: what follows can't be cut reliably.
    """
    at, fields = 0, None
    while at < len(stream):
        end = stream.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line without end")
        parts = stream[at:end].split(b" ")
        if not parts[-1].isdigit():
            raise ValueError("an ARC header line without length")
        length, body = int(parts[-1]), end + 1
        if body + length > len(stream):
            raise ValueError("an ARC record that ends early")
        block = stream[body : body + length]
        at = body + length + (stream[body + length : body + length + 1] == b"\n")
        if parts[0].startswith(b"filedesc://"):
            lines = block.split(b"\n")
            version = lines[0].split(b" ")[0]
            if version not in (b"1", b"2") or len(lines) < 2:
                raise ValueError("an unknown ARC version")
            fields = [x.decode().lower() for x in lines[1].split(b" ")]
            continue
        if fields is None or len(parts) != len(fields):
            raise ValueError("an ARC header line that doesn't fit the version block")
        yield {name: value.decode("utf-8", "replace") for name, value in zip(fields, parts, strict=True)} | {"block": block}


def iso_time(stamp: str) -> str:
    """An ARC time (YYYYMMDDhhmmss, older ones without seconds or hours) in WARC form."""
    full = (stamp + "00000000")[:14] if stamp.isdigit() and len(stamp) >= 8 else "19700101000000"
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Header with its empty line, and payload, of an HTTP response; a block that is none is all payload."""
    if block.startswith(b"HTTP/"):
        head, mark, payload = block.partition(b"\r\n\r\n")
        if mark:
            return head + mark, payload
    return b"", block


def synthesised(record: dict) -> dict:
    """What a WARC record needs and an ARC record lacks."""
    head, payload = split_http(record["block"])
    digest, date, uri = base32_sha1(payload), iso_time(record["archive-date"]), record["url"]
    return {"record_id": f"urn:uuid:{uuid.uuid5(_NAMES, f'{uri} {date} {digest}')}", "uri": uri, "date": date, "digest": digest, "http": head, "payload": payload}


def warc_record(kind: str, made: dict, first: dict | None = None) -> bytes:
    """The bytes of a response or revisit record."""
    block = made["http"] + (made["payload"] if kind == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{made['record_id']}>", f"WARC-Date: {made['date']}", f"WARC-Target-URI: {made['uri']}",
        f"WARC-Payload-Digest: sha1:{made['digest']}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {_REVISIT_PROFILE}", f"WARC-Refers-To: <{first['record_id']}>", f"WARC-Refers-To-Target-URI: {first['uri']}", f"WARC-Refers-To-Date: {first['date']}", "WARC-Truncated: length"]
        lines += [f"X-Refers-To-Page: {first['page_id']}"]
    lines += [f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(lines: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of the records in a stream given as lines without their line feed.

    Raises ValueError where a record ends early, where no record begins, and where a block doesn't match its digest.
    """
    lines = iter(lines)
    for line in lines:
        if line in (b"\r", b""):
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError("no WARC record begins where one should")
        headers: dict[str, str] = {}
        for line in lines:
            if line == b"\r":
                break
            name, _, value = line.rstrip(b"\r").partition(b": ")
            headers[name.decode().lower()] = value.decode("utf-8", "replace")
        length, parts, have = int(headers["content-length"]), [], -1
        while have < length + 1:  # the block and the carriage return behind it, up to a line feed
            part = next(lines, None)
            if part is None:
                raise ValueError("a WARC record ends early")
            parts.append(part)
            have += len(part) + 1
        block = b"\n".join(parts)[:length]
        if headers.get("warc-block-digest", "sha1:" + base32_sha1(block)) != "sha1:" + base32_sha1(block):
            raise ValueError("a WARC block doesn't match its digest")
        yield headers, block


_ARC_BYTES = 4 << 20


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """The pages as ARC streams of a few MB (column arc); streams alternate between versions 1 and 2."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version, parts, size = 2, [], 0
        for batch in batches:
            for page, url, html in zip(batch.column("page_id"), batch.column("url"), batch.column("html"), strict=True):
                if not parts:
                    version = 3 - version
                    parts.append(arc_block(version, "pages.arc"))
                page, payload = page.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page is None else page}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                date = str(int(_EPOCH) + (page or 0) % 28 * 1000000)
                parts.append(arc_record(version, url.as_py() or f"urn:page:{page}", date, head + payload, size, "pages.arc"))
                size += len(parts[-1])
                if size >= _ARC_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.large_binary())], names=["arc"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.large_binary())], names=["arc"])

    return pages.select("page_id", "url", "html").mapInArrow(work, "arc binary")


def _header(http: bytes, name: bytes) -> str:
    for line in http.split(b"\r\n"):
        if line[: len(name)].lower() == name:
            return line[len(name) :].strip().decode()
    return ""


_MADE = "page_id long, record_id string, uri string, date string, digest string, size long"
_MADE_NAMES = ["page_id", "record_id", "uri", "date", "digest", "size"]


def converted(arcs: DataFrame, with_payload: bool) -> DataFrame:
    """What conversion makes of every ARC record: identifiers, time, digest; http and payload if wanted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for arc in batch.column("arc"):
                made = [synthesised(r) for r in read_arc(arc.as_py())]
                ids = [_header(m["http"], b"x-page-id:") for m in made]
                columns = [pa.array([int(i) if i else None for i in ids], pa.int64()), *(pa.array([m[k] for m in made], pa.string()) for k in ("record_id", "uri", "date", "digest")), pa.array([len(m["payload"]) for m in made], pa.int64())]
                names = list(_MADE_NAMES)
                if with_payload:
                    columns += [pa.array([m[k] for m in made], pa.large_binary()) for k in ("http", "payload")]
                    names += ["http", "payload"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return arcs.mapInArrow(work, _MADE + ", http binary, payload binary" * with_payload)


def convert(arcs: DataFrame) -> DataFrame:
    """WARC records (column record, without the last line break) of ARC streams, revisits resolved.

    The first of each group of equal payloads comes from an aggregate by digest.  Records meet it in
    a join salted by page, so that a payload that a third of all pages share is spread over tasks.
    """
    slim = converted(arcs, False)
    first = slim.groupBy("digest", "size").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page_id", "record_id", "uri", "date")).alias("some"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id", "uri", "date"))).alias("least"))
    first = materialize(first.where("n > 1").select(F.col("digest").alias("d"), F.col("size").alias("l"), F.coalesce("least", "some").alias("first")), "warc-first")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = converted(arcs, True).withColumn("salt", F.pmod(F.xxhash64("page_id", "uri"), F.lit(SALT)).cast("int"))
    known = salted.alias("r").join(first.alias("f"), (F.col("digest") == F.col("d")) & (F.col("size") == F.col("l")) & (F.col("r.salt") == F.col("f.salt")), "left")
    known = known.select("page_id", "record_id", "uri", "date", "digest", "http", "payload", "first")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256).to_pylist()
                out = []
                for r in rows:
                    again = r["first"] is not None and r["first"]["page_id"] is not None and r["first"]["page_id"] != r["page_id"]
                    out.append(warc_record("revisit" if again else "response", r, r["first"])[:-2])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.large_binary())], names=["record"])

    return known.mapInArrow(work, "record binary")


def write_archives(records: DataFrame, path: str) -> None:
    """Write records as .warc.gz files: the text writer copies bytes and ends each row with a line break."""
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def read_archives(spark, path: str) -> DataFrame:
    """Per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, uri.

    A gzip file is one split, and lines of a split come in order, so records are whole.  Response
    payloads are held against their digests.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines() -> Iterator[bytes]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    yield from batch.column(0).slice(at, 1024).to_pylist()

        rows: list[tuple] = []
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "uri"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for headers, block in read_warc(lines()):
            http, payload = split_http(block)
            kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
            page, size, refers = _header(http, b"x-page-id:"), _header(http, b"content-length:"), headers.get("x-refers-to-page", "")
            if kind == "response" and base32_sha1(payload) != digest:
                raise ValueError("a payload doesn't match its digest")
            rows.append((int(page) if page else None, int(size), digest, kind, int(refers) if refers else None, headers["warc-record-id"].strip("<>"), headers["warc-target-uri"]))
            if len(rows) == 4096:
                yield pack()
                rows = []
        if rows:
            yield pack()

    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(work, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, uri string")


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """All pages as ARC streams, converted to WARC files, read back."""
    path = new_path(spark, "warc")
    write_archives(convert(pages_to_arc(spark.read.parquet(f"{sf_dir}/pages.parquet"))), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
coded AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, (1 + i // 8 * 10)::INT, 10))::BIGINT >> (35 - i % 8 * 5)::INT) & 31)::INT, 1)), '') AS payload_digest
  FROM hashed),
grouped AS (SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM coded)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM grouped
"""
