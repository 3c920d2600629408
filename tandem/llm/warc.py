"""WARC archives of page captures, and their assembly from request, response and metadata records.

Writing: a capture becomes three records, a response (or, for a payload that a
later page holds too, a revisit of identical payload digest), the request and
a metadata record; the latter two name the first in ``WARC-Concurrent-To``.
A text row per record, ended by the record separator, makes the files; Spark's
commit protocol and file systems apply. Reading: archives are parsed by
content length, so payloads may hold anything, also WARC headers. Assembly
joins the three kinds of records through the concurrent-to ids and emits one
nested row per capture.

Results by case: null html is an empty payload, null urls are written as empty
and read back as null; rows that repeat or share an id are captures of their
own (record ids contain a running number); of equal payloads every row with
the largest page id is a response, the others revisit it; rows with a null id
revisit if some page with an id has the payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The format's version, separators and revisit profile.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
FILE_RECORDS = 1500


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes) -> str:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    return VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n" + block.decode("utf-8")


def _one_line(url: str | None) -> str:
    """A url as a header value: line ends and blanks at its edges are escaped by per cent signs."""
    escape = lambda m: "".join(f"%{b:02X}" for b in m[0].encode())
    return "" if url is None else re.sub(r"[\r\n]|^\s+|\s+$", escape, url)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for number, page, url, html, original in zip(*(batch.column(k).to_pylist() for k in range(5))):
            payload = (html or "").encode()
            ids = [str(uuid.uuid5(uuid.NAMESPACE_URL, f"{kind}:{page}:{number}")) for kind in ("response", "request", "metadata")]
            key = [("X-Page-ID", "" if page is None else str(page))]
            target = [("WARC-Target-URI", _one_line(url))]
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
            digest = [("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Content-Type", "application/http; msgtype=response")]
            if original is None:
                out.append(_record("response", ids[0], [*target, *key, *digest], http + payload))
            else:
                first = [("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", str(original))]
                out.append(_record("revisit", ids[0], [*target, *key, *digest, *first], http))
            with_first = [("WARC-Concurrent-To", f"<urn:uuid:{ids[0]}>")]
            ask = f"GET {_one_line(url) or '/'} HTTP/1.1\r\nAccept: text/html\r\n\r\n".encode()
            out.append(_record("request", ids[1], [*target, *with_first, ("Content-Type", "application/http; msgtype=request")], ask))
            out.append(_record("metadata", ids[2], [*target, *with_first, ("Content-Type", "application/warc-fields")], f"fetchedBytes: {len(payload)}\r\n".encode()))
            if sum(map(len, out)) > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, file_records: int = FILE_RECORDS) -> None:
    """Write the captures as gzip-compressed WARC files of at most ``file_records`` records.

    One aggregate per payload digest (combined before the shuffle) finds the
    digests of several rows; only those are joined back, so a payload that a
    third of the rows share is one row there, and the wide side is split by
    the engine's skew handling.
    """
    payload = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    p = pages.select(F.col(f"`{id_col}`").cast("long").alias("page"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("html"))
    p = p.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    big = F.octet_length("html") >= min_bytes
    same = p.filter(big).groupBy("digest").agg(F.max("page").alias("original"), F.count("*").alias("n")).filter("n > 1 and original is not null")
    marked = p.join(same.select("digest", "original"), "digest", "left")
    marked = marked.select(
        F.monotonically_increasing_id().alias("number"), "page", "url", "html", F.when(~F.col("page").eqNullSafe(F.col("original")), F.col("original")).alias("original")
    )
    records = marked.mapInArrow(_records, "value string")
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def parse_archive(data: bytes | Iterable[bytes]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers by lower-case name, block) of each record of an uncompressed archive,
    given whole or in parts; only the record at hand is held."""
    parts = iter([data] if isinstance(data, bytes | bytearray | memoryview) else data)
    held, begun = bytearray(), 0  # bytes from offset ``begun`` on

    def filled(n: int) -> bool:
        """Whether ``held`` has ``n`` bytes, after reading on."""
        while len(held) < n:
            more = next(parts, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while filled(1):
        look = 0
        while (stop := held.find(b"\r\n\r\n", look)) < 0:
            look = max(0, len(held) - 3)
            if not filled(len(held) + 1):
                raise ValueError(f"record at {begun} has no end of headers")
        lines = held[:stop].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {begun}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        end = stop + 4 + int(fields["content-length"])
        if not filled(end):
            raise ValueError(f"record at {begun} is cut off")
        yield begun, fields, bytes(held[stop + 4 : end])
        filled(end + 4)
        del held[: end + 4]
        begun += end + 4


def gunzip(data: bytes, step: int = 1 << 17) -> Iterator[bytes]:
    """All members of a gzip file, in parts; other data as it is."""
    if data[:2] != b"\x1f\x8b":
        yield bytes(data)
        return
    view, at = memoryview(data), 0
    while bytes(view[at : at + 2]) == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        while at < len(view) and not z.eof:
            piece = view[at : at + step]
            at += len(piece)
            yield z.decompress(piece)
        at -= len(z.unused_data)


def warc_fields(block: bytes) -> dict[str, str]:
    """``name: value`` lines of a metadata block, by lower-case name."""
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, sep, v in (line.partition(":") for line in lines) if sep}


_FIELDS = "type string, record_id string, concurrent_to string, url string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary, request_line string, fetched_bytes long"


def _parse(with_payload: bool):
    names = ["type", "record_id", "concurrent_to", "url", "page_id", "refers_to", "payload_bytes", "payload_digest", "payload", "request_line", "fetched_bytes"]
    types = [pa.string()] * 4 + [pa.int64()] * 3 + [pa.string(), pa.binary(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                rows, held = [], 0
                for _, f, block in parse_archive(gunzip(blob.as_py())):
                    http, _, body = block.partition(b"\r\n\r\n")
                    kind, size, digest, line, fetched = f["warc-type"], None, None, None, None
                    if kind == "response":
                        size, digest = len(body), base32_sha1(body)
                    elif kind == "revisit":
                        # the block holds the headers only; length and digest are the full payload's
                        size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http + b"\r\n")[1])
                        digest = f["warc-payload-digest"].rpartition(":")[2]
                    elif kind == "request":
                        line = http.split(b"\r\n", 1)[0].decode("utf-8", "replace")
                    elif kind == "metadata":
                        told = warc_fields(block).get("fetchedbytes", "")
                        fetched = int(told) if told.isdigit() else None
                    number = lambda k: int(f[k]) if f.get(k) else None  # noqa: E731, B023
                    rows.append((kind, f["warc-record-id"], f.get("warc-concurrent-to"), f.get("warc-target-uri") or None, number("x-page-id"), number("x-refers-to-page-id"), size, digest, body if with_payload and kind == "response" else None, line, fetched))
                    held += len(body)
                    if held > 1 << 24 and with_payload or len(rows) >= 20000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path`` (plain or gzip)."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")
    return files.mapInArrow(_parse(with_payload), _FIELDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: the response or revisit record with its request and metadata, each null if absent."""

    def part(kind: str, *more: str) -> DataFrame:
        return records.filter(F.col("type") == kind).select(F.col("concurrent_to").alias("record_id"), F.struct("record_id", "url", *more).alias(kind))

    main = records.filter(F.col("type").isin("response", "revisit"))
    first = main.select("record_id", F.struct("type", "record_id", "url", "page_id", "refers_to", "payload_bytes", "payload_digest", "payload").alias("capture"))
    return first.join(part("request", "request_line"), "record_id", "left").join(part("metadata", "fetched_bytes"), "record_id", "left")
