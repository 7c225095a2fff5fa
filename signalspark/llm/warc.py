"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import hashlib
import re
import struct

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from signalspark.llm.tables import store

#: Magic number of the skippable frame that holds the dictionary (fixed value).
DICTIONARY = b"\x5d\x2a\x4d\x18"
ZSTD = b"\x28\xb5\x2f\xfd"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive is closed at so many bytes of records; a longer record has one of its own.
ARCHIVE_BYTES = 16 << 20
#: The dictionary is trained on the archive's first records, of so many bytes in all.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 32 << 10
#: Shorter payloads are stored each time.
SHORT = 100
STEP = 1 << 16


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """A response record, or a revisit whose block has the HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        lines.append(f"WARC-Target-URI: {safe}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(records: list[bytes]) -> bytes:
    """An archive: dictionary frame (unless the records are too few for one), then a frame per record."""
    sample, size = [], 0
    for r in records:
        if size + len(r) > SAMPLE_BYTES and sample:
            break
        sample.append(r[:SAMPLE_BYTES])
        size += len(r)
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, sample, level=3)
    except zstandard.ZstdError:
        trained = None
    if trained is None:
        compress = zstandard.ZstdCompressor(level=3, write_checksum=True).compress
        head = b""
    else:
        trained.precompute_compress(level=3)
        compress = zstandard.ZstdCompressor(dict_data=trained, write_checksum=True).compress
        raw = zstandard.ZstdCompressor(level=3).compress(trained.as_bytes())
        head = DICTIONARY + struct.pack("<I", len(raw)) + raw
    return head + b"".join(map(compress, records))


def frames(content: bytes):
    """(offset, record) of each frame of an archive."""
    view, at, decompressor = memoryview(content), 0, zstandard.ZstdDecompressor()
    if content[:4] == DICTIONARY:
        (size,) = struct.unpack_from("<I", content, 4)
        raw = content[8 : 8 + size]
        if len(raw) < size:
            raise ValueError("dictionary frame is cut off")
        if raw[:4] == ZSTD:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        at = 8 + size
    while at < len(content):
        start, out, one = at, [], decompressor.decompressobj()
        while not one.eof:
            if at >= len(content):
                raise ValueError(f"frame at {start} is cut off")
            piece = view[at : at + STEP]
            out.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        yield start, b"".join(out)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record; ValueError if it is not one."""
    head, end, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not end or not re.fullmatch(rb"WARC/1\.[01]", first):
        raise ValueError("no WARC version line and header")
    headers = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon or not name.strip():
            raise ValueError(f"bad header line {line[:60]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"no {name}")
    if not headers["content-length"].isdecimal():
        raise ValueError("bad content-length")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"content-length {size}, but {len(rest) - 4} bytes before the end")
    return headers, rest[:size]


def page(headers: dict[str, str], block: bytes) -> tuple:
    """record_id, target_uri, record_type, payload_bytes, payload_digest, refers_to, payload of a record."""
    kind = headers["warc-type"]
    head, end, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", head)
    digest = headers.get("warc-payload-digest", "").partition(":")[2]
    if kind == "response":
        if not end or (length and int(length[1]) != len(payload)):
            raise ValueError("payload and HTTP content-length differ")
        found = hashlib.sha256(payload).hexdigest()
        if digest and digest != found:
            raise ValueError("payload digest differs")
        return headers["warc-record-id"], headers.get("warc-target-uri"), kind, len(payload), found, None, payload
    if kind == "revisit" and "warc-refers-to" not in headers:
        raise ValueError("revisit without warc-refers-to")
    size = int(length[1]) if length else None
    return headers["warc-record-id"], headers.get("warc-target-uri"), kind, size, digest or None, headers.get("warc-refers-to"), None


def marked(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """page_id, url, payload, digest and refers_to (the page whose equal payload is stored)."""
    x = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    same = x.filter(F.octet_length("payload") >= SHORT).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")
    )
    # stored, so that Spark knows its size and may broadcast it, or split the rows of a hot payload
    same, _ = store(same.filter("n > 1").select("digest", "first"), "payloads")
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return x.join(same, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
    archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """One row per archive: path (its name) and content.

    Of records with equal payloads of at least ``SHORT`` bytes those with the
    smallest page_id are responses, the others revisits that refer to it.
    A null payload is empty; a null id comes after all others and is left out of
    the record's name; repeated rows are repeated records.  An empty table
    makes no archive.  A task holds one archive's records at a time.
    """

    def run(batches):
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            nonlocal made, held, size
            name = f"pages-{part:06d}-{made:06d}.warc.zst"
            out = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([pack(held)], pa.binary())], ["path", "content"])
            made, held, size = made + 1, [], 0
            return out

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record(*row, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
        if held:
            yield close()

    return marked(pages, page_id, url, html).select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(
        run, "path string, content binary"
    )


def read_archives(archives: DataFrame, payloads: bool = False, strict: bool = True) -> DataFrame:
    """Records of archives given as path and content, as Spark's ``binaryFile`` source has them.

    One row per frame: path, offset, record_id, target_uri, record_type,
    payload_bytes, payload_digest, refers_to, payload (if asked) and error.  A
    response's payload is measured and hashed; a revisit states those of the
    full payload.  With ``strict`` a frame that is no valid record fails the
    job; else its row has only path, offset and error, and a broken frame ends
    its archive.  Empty and null contents have no records.
    """
    fields = (
        "path string, offset long, record_id string, target_uri string, record_type string, payload_bytes long, "
        "payload_digest string, refers_to string" + ", payload binary" * payloads + ", error string"
    )
    names = [f.split()[0] for f in fields.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]] for f in fields.split(", ")]
    width = 7 if payloads else 6

    def records(path, content):
        offset = 0
        try:
            for offset, raw in frames(content):
                try:
                    yield (path, offset, *page(*parse(raw))[:width], None)
                except ValueError as e:
                    if strict:
                        raise ValueError(f"{path} at {offset}: {e}") from e
                    yield (path, offset, *[None] * width, str(e))
        except zstandard.ZstdError as e:
            if strict:
                raise
            yield (path, offset, *[None] * width, str(e))
        except ValueError as e:
            if strict:
                raise
            yield (path, offset, *[None] * width, str(e))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows, size = [], 0
                for r in records(path, content or b""):
                    rows.append(r)
                    size += len(r[8] or b"") if payloads else 0
                    if len(rows) >= 10_000 or size >= 8 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return archives.select("path", "content").mapInArrow(run, fields)


def page_of(name: str):
    """The page_id in a record's name ``<urn:page:ID>``."""
    return F.regexp_extract(F.col(name), r"^<urn:page:(-?[0-9]+)>$", 1)


def archived_pages(pages: DataFrame, **names) -> DataFrame:
    """Write the pages' archives to the shared folder and read them back: one row per page."""
    archives, _ = store(write_archives(pages, **names), "archives")
    read = read_archives(archives)
    number = lambda c: F.when(page_of(c) != "", page_of(c).cast("long"))
    return read.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )
