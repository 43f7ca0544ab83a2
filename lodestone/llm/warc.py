"""WARC archives of individually compressed records with an embedded Zstandard dictionary.

An archive starts with a skippable frame that holds a dictionary built from the archive's own
records; then follows one Zstandard frame per record. Archives are rows (name, content): tasks
write them to a table, since executors share no local folder, and any reader of that table can
store the contents as .warc.zst files.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import free_name, materialise, python_batches, table

# Fixed values of the format: the skippable frame that holds a dictionary, and Zstandard's own marks.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of an archive, of its dictionary, and of the records that the dictionary is built from.
ARCHIVE_BYTES, DICT_BYTES, SAMPLE_BYTES, LEVEL = 16 << 20, 32 << 10, 2 << 20, 3


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: dict[str, str], block: bytes) -> bytes:
    """A WARC/1.1 record; header values keep no line breaks."""
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k: v.strip() for k, _, v in (line.partition(":") for line in lines)}
    n = int(headers["Content-Length"])
    if len(rest) < n:
        raise ValueError("a record is short")
    return headers, rest[:n]


def dictionary_of(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from records spread over the archive, SAMPLE_BYTES of them at most (of each its first 64 KB).

    Where they are too few or too much alike to train one, their content itself is the dictionary, as the format allows.
    """
    size = sum(map(len, records))
    samples = [r[:65536] for r in records[:: max(1, -(-size // SAMPLE_BYTES))]]
    try:
        if len(samples) >= 8:
            return zstandard.train_dictionary(max(256, min(DICT_BYTES, size // 10)), samples, k=200, d=8)
    except zstandard.ZstdError:
        pass
    return zstandard.ZstdCompressionDict((b"".join(samples) + b"WARC/1.1")[:DICT_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(records: list[bytes]) -> bytes:
    """The dictionary, itself compressed, in a skippable frame, then a frame per record."""
    out = io.BytesIO()
    known = dictionary_of(records)
    body = zstandard.ZstdCompressor(level=19).compress(known.as_bytes())
    out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True)
    for r in records:
        out.write(press.compress(r))
    return out.getvalue()


def read_archive(data: bytes) -> Iterator[bytes]:
    """Each record of an archive. A dictionary may be stored as it is or compressed."""
    at, known = 0, None
    view = memoryview(data)
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        at = 8 + struct.unpack_from("<I", data, 4)[0]
        body = bytes(view[8:at])
        if body.startswith(FRAME):
            body = zstandard.ZstdDecompressor().decompress(body)
        if len(body) < 8:
            raise ValueError("the first frame holds no dictionary")
        known = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_FULLDICT if body.startswith(DICTIONARY) else zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    while at < len(data):
        one, parts, step = press.decompressobj(), [], 4096
        while not one.eof:
            if at >= len(data):
                raise ValueError("an archive is cut off")
            piece = view[at : at + step]
            parts.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
            step *= 2
        yield b"".join(parts)


def with_revisits(pages: DataFrame, page_id: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """Add warc_digest (hex SHA-1) and warc_first: the smallest id with an equal payload of at least min_bytes bytes, or null if that is the row itself or there is none.

    A null payload counts as empty. Null ids come last; rows that share the smallest id are all firsts.
    Only digests that occur more than once are joined, and the join's inputs are written tables, so that
    a digest with a large part of all rows can be split over tasks.
    """
    body = F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b""))
    digest, low = free_name(pages, "digest"), free_name(pages, "first")
    rows = pages.withColumn("warc_digest", F.sha1(body))
    slim = pages.select(F.col(page_id).alias(low), F.sha1(body).alias(digest), F.length(body).alias("n"))
    twins = slim.where(F.col("n") >= min_bytes).groupBy(digest).agg(F.min(low).alias(low), F.count("*").alias("n")).where((F.col("n") > 1) & F.col(low).isNotNull())
    twins = materialise(twins.select(digest, low), "twins")
    found = rows.join(twins, F.col("warc_digest") == F.col(digest), "left")
    first = F.when(F.col(page_id).isNull() | (F.col(page_id) != F.col(low)), F.col(low))
    return found.select(*[F.col(c) for c in pages.columns], "warc_digest", first.alias("warc_first"))


_ARCHIVES = "name string, content binary, n_records long"


def write_warc(pages: DataFrame, page_id: str, url: str, payload: str, min_bytes: int = 0, date: str | None = None) -> DataFrame:
    """Write a record per row into archives; returns the table of archives (name, content, n_records).

    The record is a response, or a revisit without payload if a smaller id has the same one. Ids are
    integers or null. Null url: an empty target; repeated rows get a record each; extra columns
    are left out; an empty table gives no archives. Each task rolls over to a new archive after
    ARCHIVE_BYTES, so it holds one archive at a time.
    """
    python_batches(pages.sparkSession)
    when = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = with_revisits(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(payload).alias("payload")), "page_id", "payload", min_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        size = serial = 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{number:05d}.warc.zst"]), pa.array([write_archive(held)], pa.binary()), pa.array([len(held)], pa.int64())], ["name", "content", "n_records"])

        for batch in batches:
            for row in batch.to_pylist():
                body = (row["payload"] or "").encode()
                key, first = row["page_id"], row["warc_first"]
                digest = base64.b32encode(bytes.fromhex(row["warc_digest"])).decode()
                serial += 1
                # revisits refer to a response by its id and digest; a revisit's own name is its task's alone
                own = f"{key}-{digest}" if first is None and key is not None else f"{key}-{digest}-{part}-{serial}"
                headers = {"WARC-Type": "response" if first is None else "revisit", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, own)}>", "WARC-Target-URI": row["url"] or "", "WARC-Date": when, "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-ID": "" if key is None else str(key), "X-Payload-Length": str(len(body))}
                if first is None:
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                else:
                    headers |= {"WARC-Profile": REVISIT, "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{first}-{digest}')}>", "X-Refers-To-Page-ID": str(first)}
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                held.append(record(headers | {"Content-Type": "application/http; msgtype=response"}, block))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    held, size, number = [], 0, number + 1
        if held:
            yield closed()

    return materialise(rows.mapInArrow(run, _ARCHIVES), "warc")


def read_warc(archives: DataFrame) -> DataFrame:
    """A row per record of the archives in column content: headers, and the payload of responses (null for revisits)."""
    python_batches(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                heads, bodies, size = [], [], 0
                for data in read_archive(content.as_py()):
                    headers, block = parse_record(data)
                    heads.append(list(headers.items()))
                    bodies.append(block.partition(b"\r\n\r\n")[2] if headers["WARC-Type"] == "response" else None)
                    size += len(block)
                    if size > 4 << 20:
                        yield batch_of(heads, bodies)
                        heads, bodies, size = [], [], 0
                if heads:
                    yield batch_of(heads, bodies)

    def batch_of(heads: list, bodies: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(heads, pa.map_(pa.string(), pa.string())), pa.array(bodies, pa.binary())], ["headers", "payload"])

    return archives.select("content").mapInArrow(run, "headers map<string,string>, payload binary")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    read = read_warc(write_warc(pages, "page_id", "url", "html"))
    number = lambda name: F.expr(f"try_cast(headers['{name}'] AS BIGINT)")
    # a response's digest and length are those of the payload that was read back
    sha = F.sha1("payload")
    named = F.substring(F.col("headers")["WARC-Payload-Digest"], 6, 32)
    rows = read.select(
        number("X-Page-ID").alias("page_id"),
        F.coalesce(F.length("payload").cast("long"), number("X-Payload-Length")).alias("payload_bytes"),
        F.when(F.col("payload").isNull(), named).otherwise(base32(sha)).alias("payload_digest"),
        F.col("headers")["WARC-Type"].alias("record_type"),
        number("X-Refers-To-Page-ID").alias("refers_to"),
    )
    return rows


def base32(hexadecimal: F.Column) -> F.Column:
    """RFC 4648 base 32 of a digest of 20 bytes given in hex."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")  # fixed value: the alphabet of RFC 4648
    chars = []
    for i in range(4):
        forty = F.conv(F.substring(hexadecimal, 10 * i + 1, 10), 16, 10).cast("long")
        chars += [F.substr(letters, (F.shiftright(forty, s).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for s in range(35, -1, -5)]
    return F.concat(*chars)


_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {10 * i + 1}, 10) AS BIGINT) >> {s}) & 31 AS INTEGER) + 1, 1)" for i in range(4) for s in range(35, -1, -5))
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS h FROM p
), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, payload_bytes, {_DIGITS} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
