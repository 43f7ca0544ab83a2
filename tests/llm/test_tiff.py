import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import tiff

bits = st.binary(max_size=3000) | st.builds(lambda a, n: a * n, st.binary(min_size=1, max_size=3), st.integers(1, 6000))


@settings(max_examples=150, deadline=None)
@given(bits)
def test_codecs_round_trip(data):
    assert tiff.packbits_decode(tiff.packbits_encode(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_long_lzw_and_known_values():
    data = np.random.default_rng(1).integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
    assert tiff.packbits_decode(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, 16, 48])
def test_files_round_trip(compression, predictor, tile):
    rng = np.random.default_rng(2)
    pages = [rng.integers(0, 4, (h, w, s), dtype=np.uint8) for h, w, s in ((5, 7, 3), (40, 33, 1), (1, 1, 4))]
    found = list(tiff.pages_of(tiff.write_tiff(pages, compression, predictor, tile, 16)))
    assert [p["error"] for p in found] == [None] * 3
    for page, p in zip(pages, found, strict=True):
        assert (p["height"], p["width"], p["samples"]) == page.shape and p["pixels"] == page.tobytes() and p["tiled"] == bool(tile)


def test_big_endian_planar_16_bit():
    values = np.array([[[1, 300], [5, 299]]], ">u2")  # one row, two pixels, two planes
    diff = [b"".join(struct.pack(">H", v & 0xFFFF) for v in (int(p[0]), int(p[1]) - int(p[0]))) for p in (values[0, :, 0], values[0, :, 1])]
    tags = [(256, 3, [2]), (257, 3, [1]), (258, 3, [16, 16]), (259, 3, [1]), (273, 4, [1000, 1004]), (277, 3, [2]), (278, 3, [1]), (279, 4, [4, 4]), (284, 3, [2]), (317, 3, [2])]
    body, extra = b"", b""
    for tag, kind, v in tags:
        raw = struct.pack(f">{len(v)}{tiff.SIZES[kind]}", *v)
        if len(raw) > 4:
            raw, extra = struct.pack(">I", 500 + len(extra)), extra + raw
        body += struct.pack(">HHI", tag, kind, len(v)) + raw.ljust(4, b"\0")
    data = (b"MM\0*" + struct.pack(">I", 8) + struct.pack(">H", len(tags)) + body + b"\0\0\0\0").ljust(500, b"\0") + extra
    data = data.ljust(1000, b"\0") + diff[0] + diff[1]
    (page,) = tiff.pages_of(data)
    assert page["error"] is None and np.frombuffer(page["pixels"], np.uint16).reshape(1, 2, 2).tolist() == values.tolist()


def test_reader_on_odd_rows(spark):
    good = tiff.write_tiff([np.zeros((2, 2, 3), np.uint8)] * 2)
    rows = [(1, bytearray(good), "a"), (2, None, "b"), (3, bytearray(b""), None), (4, bytearray(b"GIF89a.."), "d"), (5, bytearray(good[:-40]), "e"), (1, bytearray(good), "a"), (None, bytearray(good), "f")]
    df = spark.createDataFrame(rows, "doc_id long, image binary, page string")
    found = tiff.read_tiff(df, "image").collect()
    assert sorted((r.doc_id or 0, r.page or "", r._page.number, r._page.error is None) for r in found) == sorted([(1, "a", 0, True), (1, "a", 1, True)] * 2 + [(0, "f", 0, True), (0, "f", 1, True), (3, "", 0, False), (4, "d", 0, False)] + [(5, "e", 0, True), (5, "e", 1, False)])
    assert tiff.read_tiff(df.limit(0), "image").count() == 0


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = {r.doc_id: r for r in tiff.op2_tiff(spark, sf_dir).collect()}
    assert set(found) == set(texts)
    for k, text in texts.items():
        payload = tiff.payload_of(text)
        assert payload.startswith(text.encode()) and len(payload) % 192 == 0 < len(payload)
        r = found[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = tiff.as_tiff(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_long_payload_has_many_pages():
    payload = tiff.payload_of("word " * 700_000)
    pages = list(tiff.pages_of(tiff.as_tiff(payload)))
    assert len(pages) == 3 and b"".join(p["pixels"] for p in pages) == payload


def test_lzw_at_every_size():
    """The checksum alone picks the form: LZW on both sides of 64 KB."""
    for start in (100, 70_000, 300_000):
        payload = next(p for p in (tiff.payload_of("x y" * start + str(i)) for i in range(100)) if zlib.crc32(p) % 8 == 0)
        assert next(tiff.directories(tiff.as_tiff(payload)))[tiff.COMPRESSION] == (tiff.LZW,)
        assert b"".join(p["pixels"] for p in tiff.pages_of(tiff.as_tiff(payload))) == payload


def test_null_and_repeated_rows(spark, tmp_path):
    spark.createDataFrame([(1, None, 0), (1, None, 0), (None, "", 1), (2, "é" * 500_000, 2)], "doc_id long, text string, n_bytes int").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256) for r in tiff.op2_tiff(spark, str(tmp_path)).collect())
    empty = hashlib.sha256(b" " * 192).hexdigest()
    assert [f[:3] for f in found] == [(0, 0, 192), (1, 0, 192), (1, 0, 192), (2, 1_000_000, 1_000_128)] and found[0][3] == found[1][3] == empty
