"""Media columns: TIFF files in binary columns.

The reader walks a file's image directories and emits one row per page: it decodes PackBits, LZW or
deflate strips and tiles, undoes horizontal predictors, and returns the page's samples. The writer
makes such files of 8-bit samples. Both are narrow: no row leaves its task.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import free_name, python_batches, table

# Fixed values of the format: compression schemes and tags.
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
SIZES = {1: "B", 2: "B", 3: "H", 4: "I", 16: "Q"}

# ---------------------------------------------------------------- codecs


def packbits_encode(row: bytes) -> bytes:
    """Runs of three or more as runs, all else as literals."""
    a, out, at = np.frombuffer(row, np.uint8), bytearray(), 0
    cuts = np.concatenate(([0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)])) if len(a) else np.zeros(1, int)
    long = np.flatnonzero(np.diff(cuts) >= 3)

    def literal(end: int) -> None:
        for i in range(at, end, 128):
            part = row[i : min(i + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for i in long:
        start, end = int(cuts[i]), int(cuts[i + 1])
        literal(start)
        while start < end:
            n = min(128, end - start)
            out += bytes((257 - n if n > 1 else 0, row[start]))
            start += n
        at = end
    literal(len(row))
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        head = data[at]
        if head < 128:
            out += data[at + 1 : at + 2 + head]
            at += 2 + head
        else:
            if head > 128:
                out += data[at + 1 : at + 2] * (257 - head)
                at += 1
            at += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widened one code early."""
    codes: dict[int, int] = {}  # of a known string's code and the byte after it
    out, held, filled, bits, following = bytearray(), 256, 9, 9, 258
    prefix = -1

    def drained() -> None:
        nonlocal held, filled
        rest = filled & 7
        out.extend((held >> rest).to_bytes(filled >> 3, "big"))
        held, filled = held & ((1 << rest) - 1), rest

    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        pair = prefix << 8 | byte
        if (known := codes.get(pair)) is not None:
            prefix = known
            continue
        held = held << bits | prefix
        filled += bits
        codes[pair] = following
        following += 1
        if following == 4095:
            held = held << bits | 256
            filled += bits
            codes.clear()
            bits, following = 9, 258
        elif following + 1 > 1 << bits:
            bits += 1
        if filled >= 512:
            drained()
        prefix = byte
    if prefix >= 0:
        held = held << bits | prefix
        filled += bits
        if following + 2 > 1 << bits and bits < 12:
            bits += 1
    held = held << bits | 257
    filled += bits
    held <<= -filled % 8
    filled += -filled % 8
    drained()
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    fresh = [bytes((i,)) for i in range(256)] + [b"", b""]
    words, bits, out, last = list(fresh), 9, [], b""
    held = filled = 0
    at, n = 0, len(data)
    while True:
        while filled < bits:
            if at >= n:
                return b"".join(out)
            held = (held & 0xFFFF) << 8 | data[at]
            at += 1
            filled += 8
        filled -= bits
        code = held >> filled & ((1 << bits) - 1)
        if code == 257:
            return b"".join(out)
        if code == 256:
            words, bits, last = list(fresh), 9, b""
            continue
        if code < len(words):
            word = words[code]
        elif code == len(words) and last:
            word = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out.append(word)
        if last:
            words.append(last + word[:1])
        last = word
        if len(words) + 1 >= 1 << bits and bits < 12:
            bits += 1


def inflate(data: bytes) -> bytes:
    return zlib.decompressobj().decompress(data)


DECODE = {NONE: bytes, LZW: lzw_decode, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: packbits_decode}

# ---------------------------------------------------------------- writing


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int | None = None, rows_per_strip: int = 256) -> bytes:
    """A little-endian file of pages, each (height, width, samples) of 8 bits, in strips or, with tile (a multiple of 16), in square tiles."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4

    def packed(block: np.ndarray) -> bytes:
        if predictor == 2:
            block = np.concatenate((block[:, :1], block[:, 1:] - block[:, :-1]), axis=1)
        raw = np.ascontiguousarray(block).tobytes()
        if compression == PACKBITS:
            row = block.shape[1] * block.shape[2]
            return b"".join(packbits_encode(raw[i : i + row]) for i in range(0, len(raw), row))
        return lzw_encode(raw) if compression == LZW else zlib.compress(raw, 6) if compression == DEFLATE else raw

    for page in pages:
        height, width, samples = page.shape
        blocks = []
        if tile:
            for y in range(0, height, tile):
                for x in range(0, width, tile):
                    block = np.zeros((tile, tile, samples), np.uint8)
                    part = page[y : y + tile, x : x + tile]
                    block[: part.shape[0], : part.shape[1]] = part
                    blocks.append(packed(block))
        else:
            blocks = [packed(page[y : y + rows_per_strip]) for y in range(0, height, rows_per_strip)]
        offsets = []
        for b in blocks:
            offsets.append(len(out))
            out += b
        entries = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        if tile:
            entries += [(TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, [len(b) for b in blocks])]
        else:
            entries += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_COUNTS, 4, [len(b) for b in blocks])]
        fields = b""
        for tag, kind, values in sorted(entries):
            raw = struct.pack(f"<{len(values)}{SIZES[kind]}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                raw, at = struct.pack("<I", len(out)), raw
                out += at
            fields += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + fields
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# ---------------------------------------------------------------- reading


def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """The tags of each image directory along the chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(f"{order}I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("the chain of directories has a loop")
        seen.add(at)
        n = struct.unpack_from(f"{order}H", data, at)[0]
        tags = {}
        for i in range(n):
            here = at + 2 + 12 * i
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, here)
            if kind in SIZES:
                form = f"{order}{count}{SIZES[kind]}"
                where = here + 8 if struct.calcsize(form) <= 4 else struct.unpack_from(f"{order}I", data, here + 8)[0]
                tags[tag] = struct.unpack_from(form, data, where)
        yield tags | {0: (order,)}
        at = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]


def samples_of(data: bytes, tags: dict[int, tuple]) -> np.ndarray:
    """A page's samples as (height, width, samples)."""
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, depth, bits = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1)
    if bits not in (8, 16) or set(tags.get(BITS, (bits,))) != {bits}:
        raise ValueError(f"{bits} bits a sample")
    kind, predictor, compression = np.dtype(f"{tags[0][0]}u{bits // 8}"), one(PREDICTOR, 1), one(COMPRESSION, 1)
    if compression not in DECODE or predictor not in (1, 2):
        raise ValueError(f"compression {compression}, predictor {predictor}")
    planes = depth if one(PLANAR, 1) == 2 else 1
    inner = depth // planes
    tiled = TILE_OFFSETS in tags
    across, down = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    out = np.zeros((height, width, depth), kind.newbyteorder("="))
    blocks = zip(tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS], strict=True)
    for plane in range(planes):
        for y in range(0, height, down):
            for x in range(0, width, across):
                offset, size = next(blocks)
                rows = down if tiled else min(down, height - y)
                need = rows * across * inner * kind.itemsize
                raw = DECODE[compression](data[offset : offset + size])
                if len(raw) < need:
                    raise ValueError("a strip or tile is short")
                block = np.frombuffer(raw[:need], kind).reshape(rows, across, inner).astype(out.dtype)
                if predictor == 2:
                    block = np.cumsum(block, axis=1, dtype=out.dtype)
                h, w = min(rows, height - y), min(across, width - x)
                out[y : y + h, x : x + w, plane * inner : (plane + 1) * inner] = block[:h, :w]
    return out


PAGE = T.StructType([T.StructField(n, t) for n, t in (("number", T.IntegerType()), ("width", T.LongType()), ("height", T.LongType()), ("samples", T.IntegerType()), ("bits", T.IntegerType()), ("compression", T.IntegerType()), ("predictor", T.IntegerType()), ("tiled", T.BooleanType()), ("pixels", T.BinaryType()), ("error", T.StringType()))])


def pages_of(data: bytes | None) -> Iterator[dict]:
    """One dict a page; a fault ends the walk with a page of its error."""
    number = 0
    try:
        for tags in directories(data) if data is not None else ():
            pixels = samples_of(data, tags)
            height, width, depth = pixels.shape
            yield {"number": number, "width": width, "height": height, "samples": depth, "bits": 8 * pixels.itemsize, "compression": tags.get(COMPRESSION, (1,))[0], "predictor": tags.get(PREDICTOR, (1,))[0], "tiled": TILE_OFFSETS in tags, "pixels": pixels.tobytes(), "error": None}
            number += 1
    except (ValueError, KeyError, StopIteration, struct.error, zlib.error) as e:
        yield dict.fromkeys(PAGE.names) | {"number": number, "error": str(e) or type(e).__name__}


#: Pixel bytes in an output batch.
_BATCH = 8 << 20


def read_tiff(df: DataFrame, image: str) -> DataFrame:
    """One row per page of the TIFF files in the binary column image, which gives way to a struct `page`.

    All other columns are kept; if one of them is called page, the struct gets underscores before
    its name. A null file has no pages and gives no row; a broken or foreign file gives, after its
    good pages, one row with page.error set. Repeated rows are read each. 8 and 16 bits a sample.
    """
    python_batches(df.sparkSession)
    keep = [f for f in df.schema.fields if f.name != image]
    name = free_name(df.drop(image), "page")
    schema = T.StructType([*keep, T.StructField(name, PAGE)])
    ints = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.BooleanType(): pa.bool_(), T.BinaryType(): pa.binary(), T.StringType(): pa.string()}
    page_type = pa.struct([(f.name, ints[f.dataType]) for f in PAGE.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(image)
            rest = pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at], schema=pa.schema([f for i, f in enumerate(batch.schema) if i != at])) if batch.num_columns > 1 else None
            rows, pages, size = [], [], 0
            for i in range(batch.num_rows):
                for page in pages_of(batch.column(at)[i].as_py()):
                    rows.append(i)
                    pages.append(page)
                    size += len(page["pixels"] or b"")
                    if size > _BATCH:
                        yield _joined(rest, rows, pages, name, page_type)
                        rows, pages, size = [], [], 0
            if pages:
                yield _joined(rest, rows, pages, name, page_type)

    return df.mapInArrow(run, schema)


def _joined(rest: pa.RecordBatch | None, rows: list[int], pages: list[dict], name: str, page_type: pa.DataType) -> pa.RecordBatch:
    kept = rest.take(pa.array(rows, pa.int32())) if rest else None
    return pa.RecordBatch.from_arrays([*(kept.columns if kept else ()), pa.array(pages, page_type)], [*(kept.schema.names if kept else ()), name])


# ---------------------------------------------------------------- the query

UNIT, ACROSS, PAGE_ROWS = 192, 64, 8192


def payload_of(text: str | None) -> bytes:
    """The text in UTF-8, with spaces up to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8")
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT))


def as_tiff(payload: bytes) -> bytes:
    """Pages of up to PAGE_ROWS rows of 64 RGB pixels; the payload's checksum picks the form, so that every codec is used.

    Most are deflate with a predictor, in strips or tiles.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ACROSS, UNIT // ACROSS)
    pages = [rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)]
    form = zlib.crc32(payload) % 8
    if form == 0:
        return write_tiff(pages, LZW, 1 + (len(payload) // UNIT) % 2)
    if form == 1:
        return write_tiff(pages, PACKBITS)
    if form == 2:
        return write_tiff(pages, NONE)
    return write_tiff(pages, DEFLATE, 2 if form % 2 else 1, 64 if form in (3, 4) else None)


def digested(text: str | None) -> tuple:
    """Store a text's payload as a TIFF file, walk the stored bytes again, and return what op2_tiff says of both."""
    payload = payload_of(text)
    size, stored = len((text or "").encode()), as_tiff(payload)
    del payload
    sha, n, tail, height, sums, seen = hashlib.sha256(), 0, b"", 0, np.zeros(UNIT // ACROSS), np.zeros(256, bool)
    for page in pages_of(stored):
        if page["error"] is not None:
            raise ValueError(f"a file that was written here can't be read: {page['error']}")
        pixels = np.frombuffer(page["pixels"], np.uint8)
        sha.update(pixels)
        n, tail, height = n + len(pixels), page["pixels"][-16:], height + page["height"]
        sums += pixels.reshape(-1, UNIT // ACROSS).sum(axis=0, dtype=np.int64)
        seen |= np.bincount(pixels, minlength=256) > 0
    feature = f"{height}:{','.join(f'{m:.3f}' for m in sums / (height * ACROSS))}:{np.count_nonzero(seen)}"
    return size, n, sha.hexdigest(), zlib.crc32(tail), len(stored), hashlib.sha256(stored).hexdigest(), feature


def op2_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file is written, read back page by page and digested before the next one: a task holds one at a time, and one Python worker."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = zip(*[digested(t.as_py()) for t in batch.column("text")], strict=True) if batch.num_rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["doc_id", *names])

    python_batches(spark)
    return table(spark, sf_dir, "documents", "doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
