import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import warc


@pytest.mark.parametrize("n", [0, 1, 5, 400])
def test_archives_round_trip(n):
    records = [warc.record({"WARC-Type": "response", "X": str(i)}, f"<p>the text of page {i} {'and more ' * (i % 50)}</p>".encode() * (1 + i % 3)) for i in range(n)]
    data = warc.write_archive(records)
    assert list(warc.read_archive(data)) == records
    assert data.startswith((0x184D2A5D).to_bytes(4, "little"))
    if n:
        with pytest.raises(ValueError):
            list(warc.read_archive(data[:-3]))


def test_dictionary_pays():
    records = [f"<html><head><title>{i}</title></head><body class='page'><nav>home about news</nav>{hashlib.sha1(bytes([i % 256, i // 256])).hexdigest()}</body></html>".encode() for i in range(1000)]
    import zstandard

    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(warc.write_archive(records)) < 0.8 * plain


def test_query(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    found = {r.page_id: r for r in warc.op5_warc(spark, sf_dir).collect()}
    assert set(found) == set(pages)
    for k, html in pages.items():
        body = html.encode()
        assert (found[k].payload_bytes, found[k].payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())


def test_revisits_and_odd_rows(spark):
    rows = [(5, "u", "same"), (3, "u", "same"), (9, None, "same"), (None, "u", "same"), (1, "u", None), (2, "u", ""), (4, "a\nb", "ünï" * 5000), (6, "u", "own"), (6, "u", "own")]
    df = spark.createDataFrame([(a, b, c, "x", 0) for a, b, c in rows], "page_id long, url string, html string, digest string, first int")
    read = warc.read_warc(warc.write_warc(df, "page_id", "url", "html"))
    found = sorted((r.headers["X-Page-ID"], r.headers["WARC-Type"], r.headers.get("X-Refers-To-Page-ID", ""), "" if r.payload is None else r.payload.decode()) for r in read.collect())
    assert found == sorted([("5", "revisit", "3", ""), ("3", "response", "", "same"), ("9", "revisit", "3", ""), ("", "revisit", "3", ""), ("1", "response", "", ""), ("2", "revisit", "1", ""), ("4", "response", "", "ünï" * 5000), ("6", "response", "", "own"), ("6", "response", "", "own")])
    assert warc.read_warc(warc.write_warc(df.limit(0), "page_id", "url", "html")).count() == 0
    more = warc.with_revisits(df.select("page_id", "html"), "page_id", "html", min_bytes=5)
    assert more.where(F.col("warc_first").isNotNull()).count() == 0


def test_base32(spark):
    values = [hashlib.sha1(bytes([i])).hexdigest() for i in range(50)]
    found = spark.createDataFrame([(v,) for v in values], "h string").select("h", warc.base32(F.col("h")).alias("b")).collect()
    assert all(r.b == base64.b32encode(bytes.fromhex(r.h)).decode() for r in found)


def test_every_archive_has_a_dictionary():
    """On both sides of what suffices to train one."""
    for records in ([warc.record({"WARC-Type": "response"}, b"x")], [warc.record({"WARC-Type": "response"}, b"same")] * 40, [warc.record({"n": str(i)}, f"page {i} ".encode() * 200) for i in range(100)]):
        data = warc.write_archive(records)
        assert data[:4] == warc.SKIPPABLE.to_bytes(4, "little") and list(warc.read_archive(data)) == records


def test_clashing_names_and_own_record_ids(spark):
    df = spark.createDataFrame([(2, "u", "a", "d", 1), (1, "u", "a", "d", 1), (2, "u", "a", "d", 1), (None, "u", "b", None, None)], "page_id long, url string, html string, digest string, first int")
    found = warc.with_revisits(df, "page_id", "html")
    assert found.columns == [*df.columns, "warc_digest", "warc_first"] and sorted((r.page_id or 0, r.warc_first or 0) for r in found.collect()) == [(0, 0), (1, 0), (2, 1), (2, 1)]
    heads = [r.headers for r in warc.read_warc(warc.write_warc(df, "page_id", "url", "html")).collect()]
    assert len({h["WARC-Record-ID"] for h in heads}) == 4
    assert {h["WARC-Refers-To"] for h in heads if h["WARC-Type"] == "revisit"} == {h["WARC-Record-ID"] for h in heads if h["X-Page-ID"] == "1"}
