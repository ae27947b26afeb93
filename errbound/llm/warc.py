"""WARC archives in Zstandard: a writer with one frame a record, and a reader that validates what it reads.

An archive begins with a skippable frame (magic number 0x184D2A5D) that holds the dictionary; each record after it is a
frame of its own, compressed with that dictionary.  The reader loads the dictionary from the leading frame,
decodes frame by frame, and checks version line, required headers, Content-Length, the closing line ends, that
nothing follows in the frame, and the payload's length and digest.

Of records with equal payloads of at least `least_bytes`, that with the smallest page_id is the response and the others revisit
it; smaller payloads are all responses.  A revisit has no body, only the digest and length of what it revisits.

Rows: a null html is an empty payload; a null url has no WARC-Target-URI; rows without a page_id are written as
responses and read back with a null id; equal rows that repeat the smallest page_id are all responses; an empty
table gives no archive and an empty result; other columns are ignored.
Recovery: a try of a task writes under its own random name, and only names that a finished task returned are read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, fresh_dir, small_batches, utf8_bytes

#: Fixed values of the format.
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

DATE = "2000-01-01T00:00:00Z"
ARCHIVE_SCHEMA = "path string, n_records long"
ROW_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_CHUNK = 1 << 20


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str = DATE) -> bytes:
    """One record as bytes."""
    revisit = refers_to is not None
    head = (HTTP_HEAD % len(payload)).encode()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}/{digest}/{refers_to}")
    lines = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"\s", lambda m: "%%%02X" % min(ord(m[0]), 255), url))
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}/{digest}/None')}>",
                  f"X-Refers-To-Page-Id: {refers_to}"]
    body = head if revisit else head + payload
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
              "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers and body of one decoded frame; raises ValueError if it isn't exactly one valid record."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", first):
        raise ValueError("no WARC version line or no end of headers")
    headers = {}
    for line in lines:
        key, colon, value = line.partition(":")
        if not colon or not key or key != key.strip():
            raise ValueError(f"malformed header line {line!r}")
        headers[key.lower()] = value.strip()
    if missing := [x for x in REQUIRED if x.lower() not in headers]:
        raise ValueError(f"missing headers {missing}")
    if not re.fullmatch(r"[0-9]+", headers["content-length"]):
        raise ValueError("Content-Length is no number")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {n} does not match the record of {len(rest) - 4} bytes")
    return {"headers": headers, "body": rest[:n]}


def payload_row(raw: bytes) -> dict:
    """The result row of one record, with digest and length checked."""
    found = parse(raw)
    headers, (http, gap, payload) = found["headers"], found["body"].partition(b"\r\n\r\n")
    digest, length = headers.get("warc-payload-digest", ""), int(headers.get("x-payload-length", len(payload)))
    sent = re.search(rb"(?im)^content-length:\s*([0-9]+)\s*$", http)
    kind = headers["warc-type"]
    if not gap or not http.startswith(b"HTTP/") or (sent and int(sent[1]) != length):
        raise ValueError("no HTTP header or a wrong HTTP Content-Length")
    if kind == "response" and (len(payload) != length or f"sha256:{hashlib.sha256(payload).hexdigest()}" != digest):
        raise ValueError("payload does not match its length or digest")
    if kind == "revisit" and (payload or "x-refers-to-page-id" not in headers) or kind not in ("response", "revisit"):
        raise ValueError(f"bad {kind} record")

    def number(x):
        return None if x is None else int(x)

    return {"page_id": number(headers.get("x-page-id")), "payload_bytes": length, "payload_digest": digest.removeprefix("sha256:"),
            "record_type": kind, "refers_to": number(headers.get("x-refers-to-page-id"))}


def dictionary(samples: list[bytes], size: int = 65_536) -> bytes:
    """A trained dictionary, or the samples' end as a raw one if they are too few to train on."""
    import zstandard

    if len(samples) >= 64:
        return zstandard.train_dictionary(size, samples).as_bytes()
    return b"".join(samples)[-size:] or record(None, None, b"", "", None)


def frames(stream):
    """Decoded frames of an archive; the dictionary comes from its leading skippable frame, if there is one."""
    import zstandard

    head = stream.read(8)
    known, rest = None, head
    if len(head) == 8 and struct.unpack("<II", head)[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<II", head)[1]
        raw = stream.read(size)
        if len(raw) != size:
            raise ValueError("the dictionary frame is cut short")
        if raw[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may itself be a frame
            raw = zstandard.ZstdDecompressor().decompress(raw)
        known, rest = zstandard.ZstdCompressionDict(raw), b""
    plain = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    while rest or (rest := stream.read(_CHUNK)):
        one, out = plain.decompressobj(), []
        while not one.eof:
            if not rest and not (rest := stream.read(_CHUNK)):
                raise ValueError("the last frame is cut short")
            out.append(one.decompress(rest))
            rest = one.unused_data if one.eof else b""
        yield b"".join(out)


def _writer(folder: str, known: bytes, level: int):
    def write(batches):
        import pyarrow as pa
        import zstandard

        fs, root = filesystem(folder)
        out, path, n = None, f"{root}/part-{uuid.uuid4().hex}.warc.zst", 0
        pack = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(known))
        for batch in small_batches(batches, 64):
            for row in batch.to_pylist():
                if out is None:
                    out = fs.open_output_stream(path)
                    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(known)) + known)
                out.write(pack.compress(record(row["page_id"], row["url"], (row["html"] or "").encode(), row["digest"], row["refers_to"])))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path.rsplit('/', 1)[1]}"], "n_records": [n]})
    return write


def _reader(batches):
    import pyarrow as pa

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64())])
    for batch in batches:
        for path, wanted in zip(batch.column("path").to_pylist(), batch.column("n_records").to_pylist(), strict=True):
            fs, at = filesystem(path)
            rows, n = [], 0
            with fs.open_input_stream(at) as stream:
                for raw in frames(stream):
                    rows.append(payload_row(raw))
                    n += 1
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
            if wanted is not None and n != wanted:
                raise ValueError(f"{path}: {n} records, {wanted} were written")
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 100, level: int = 3, sample_rows: int = 256,
                   sample_chars: int = 8192) -> list[tuple[str, int]]:
    """Write one record per page; returns path and record count of each archive, one for each task.

    The dictionary is fitted on `sample_rows` pages, chosen by hash, and on at most `sample_chars` characters of each.
    """
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    light = rows.select("page_id", "digest", utf8_bytes(F.col("html")).alias("n")).where((F.col("n") >= least_bytes) & F.col("page_id").isNotNull())
    first = light.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last")
    again = light.join(first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()
    low = rows.select("page_id", "digest").orderBy(F.xxhash64("page_id", "digest")).limit(sample_rows)
    samples = rows.join(F.broadcast(low.distinct()), ["page_id", "digest"]).select(
        "page_id", "url", F.substring("html", 1, sample_chars).alias("html"), "digest").limit(2 * sample_rows).collect()
    known = dictionary([record(r.page_id, r.url, r.html.encode(), r.digest, None) for r in samples])
    whole = rows.join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")
    return [(r.path, r.n_records) for r in whole.mapInArrow(_writer(folder, known, level), ARCHIVE_SCHEMA).collect()]


def read_archives(spark, archives: list[tuple[str, int | None]]) -> DataFrame:
    """One row per record of the archives named with their record counts (None: not known)."""
    return spark.createDataFrame(archives, ARCHIVE_SCHEMA).repartition(max(1, len(archives))).mapInArrow(_reader, ROW_SCHEMA)


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages, folder or fresh_dir(spark, "warc")))


ORACLE = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first_id from p where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, payload_digest, case when page_id > first_id then 'revisit' else 'response' end as record_type,
       case when page_id > first_id then first_id end as refers_to
from p left join f using (payload_digest)
"""
