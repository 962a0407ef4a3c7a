import base64
import hashlib
import struct

import pytest
import zstandard

from lexispark.llm import warc as W
from lexispark.sources.tables import table

PAGES = "page_id long, url string, html string"
ODD = [(1, "http://a/x y", "<p>same</p>"), (2, None, "<p>same</p>"), (2, None, "<p>same</p>"),
       (1, "http://a/again", "<p>same</p>"), (3, "http://b/\r\nX-Evil: 1", None), (4, "u", ""),
       (None, "n", "<p>same</p>"), (None, None, "only null"), (5, "é", "naïve ☃" * 50_000),
       (6, "v", "\r\n\r\nWARC/1.1\r\n")]


def brute(rows):
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = min(page_id, first.get(html or "", page_id))
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        f = first.get(html or "")
        revisit = f is not None and page_id != f
        out.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_odd_pages(spark):
    df = spark.createDataFrame(ODD, PAGES)
    got = W.read_archives(W.write_archives(df)).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == brute(ODD)
    for r in got:
        assert "\n" not in (r.url or "") and "\r" not in (r.url or "")
        if r.record_type == "response":
            assert hashlib.sha1(r.payload).digest() == base64.b32decode(r.payload_digest)
        else:
            assert r.payload is None


def test_many_files_hold_the_whole_table(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages").repartition(3)
    files = W.write_archives(pages, file_bytes=1 << 18)
    assert files.count() > 3
    got = W.read_archives(files).select(*COLUMNS).collect()
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_least_bytes(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "long"), (4, "d", "long")], PAGES)
    got = {r.page_id: r.refers_to for r in W.read_archives(W.write_archives(
        df, least_bytes=2)).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


def test_file_layout(spark):
    """A leading skippable frame holds the dictionary, and each record is a frame of its own."""
    pages = table(spark, "/root/testdata/sf0.01", "pages").coalesce(1)
    files = W.write_archives(pages).collect()
    assert len(files) == 1
    with open(files[0].path.removeprefix("file:"), "rb") as f:
        raw = f.read()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D
    shared = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8:8 + size]))
    at, n = 8 + size, 0
    while at < len(raw):
        d = zstandard.ZstdDecompressor(dict_data=shared).decompressobj()
        record = d.decompress(raw[at:])
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        at, n = len(raw) - len(d.unused_data), n + 1
    assert n == files[0].n_records == 250
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(W.record(
        r.page_id, r.url, (r.html or "").encode(), None, "d"))) for r in pages.collect())
    assert len(raw) - size < 0.9 * plain      # the dictionary pays


def test_damage_is_seen(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "payload")], PAGES)
    path = W.write_archives(df).first().path.removeprefix("file:")
    for head, block in W.read_records(path):
        assert block.endswith(b"payload") and head["WARC-Type"] == "response"
    with open(path, "rb") as f:
        raw = f.read()
    with open(tmp_path / "cut", "wb") as f:
        f.write(raw[:-5])
    cut = spark.createDataFrame([(str(tmp_path / "cut"), 1)], "path string, n_records long")
    with pytest.raises(Exception, match="holds 0 of 1"):
        W.read_archives(cut).collect()


def test_edges(spark):
    assert W.read_archives(W.write_archives(spark.createDataFrame([], PAGES))).count() == 0
    from pyspark.sql import functions as F
    df = spark.createDataFrame(ODD, PAGES)
    for c in ("payload", "first", "digest", "record_type"):
        df = df.withColumn(c, F.lit("x"))
    assert W.read_archives(W.write_archives(df)).count() == len(ODD)
