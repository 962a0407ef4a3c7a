"""WARC archives whose records are Zstandard frames with a shared dictionary.

Each task writes the records of its rows to files of about ``file_bytes`` of records.  The
dictionary of a file is trained on its first ``sample_bytes`` of records (all of a smaller file),
stands compressed in a leading skippable frame, and every record is a frame of its own, so a
reader can start at any record.  Payloads are deduplicated: of equal payloads of ``least_bytes``
or more, the page with the smallest id is a response record and the others are revisit records
that refer to it.

Defined cases: null html is an empty payload and null url leaves out the target header; a row with
a null page_id is archived under the id "null" and never responds for others; rows that repeat
the smallest page_id of a group are all responses; control and non-ASCII characters of a url are
percent-encoded; extra columns do not matter; an empty table writes no file and reads as empty.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import open_out, settle, shared_folder, write_once

#: Fixed values of the archive formats.
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FILE_BYTES = 64 << 20
SAMPLE_BYTES = 8 << 20
DICTIONARY_BYTES = 112 << 10
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_references(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (binary), first (smallest page_id of an equal payload; null if the
    payload is alone, too small, or no equal one has an id).

    Digests are grouped with partial sums; only groups of two or more come back, so the table that
    rows are joined with is small where copies are few, and Catalyst knows its size."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary")
                        .alias("payload"))
    keyed = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    groups = settle(keyed.filter(F.octet_length("payload") >= least_bytes).groupBy("digest")
                    .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
                    .filter("n > 1 and first is not null").drop("n"), "copies")
    big = F.octet_length("payload") >= least_bytes
    return (keyed.join(groups.withColumnRenamed("digest", "d"),
                       (F.col("digest") == F.col("d")) & big, "left")
            .select("page_id", "url", "payload", "first"))


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None,
           date: str) -> bytes:
    """One WARC record with the blank lines behind it."""
    revisit = first is not None and page_id != first
    block = HTTP if revisit else HTTP + payload
    head = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>",
            f"WARC-Date: {date}", "Content-Type: application/http;msgtype=response",
            f"WARC-Payload-Digest: sha1:{digest32(payload)}",
            f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}"]
    if url is not None:
        target = quote(url, safe="!#$%&'()*+,/:;=?@[]~", errors="replace")
        head.append(f"WARC-Target-URI: {target}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:x-page:{first}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """Trained on the samples; where they are too few to train on, their own last bytes."""
    if len(samples) >= 16 and sum(map(len, samples)) >= 8 * size:
        try:
            return zstandard.train_dictionary(size, samples)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[-size:] or b"\0" * 8,
                                         dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: Iterator[bytes], level: int = 3, sample_bytes: int = SAMPLE_BYTES,
            dictionary_bytes: int = DICTIONARY_BYTES) -> Iterator[bytes]:
    """The bytes of one file; holds ``sample_bytes`` of records and one more at most."""
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r)
        if size >= sample_bytes:
            break
    shared = dictionary(held, dictionary_bytes)
    frame = zstandard.ZstdCompressor(level=19).compress(shared.as_bytes())
    yield struct.pack("<II", DICTIONARY_MAGIC, len(frame)) + frame
    pack = zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=True,
                                      write_checksum=True)
    for r in held:
        yield pack.compress(r)
    held.clear()
    for r in records:
        yield pack.compress(r)


def write_archives(pages: DataFrame, folder: str | None = None, *, least_bytes: int = 0,
                   date: str = "2024-01-01T00:00:00Z", level: int = 3,
                   file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archive ``pages`` (page_id, url, html); the list of files: path, n_records, bytes."""
    from pyspark import TaskContext
    folder = folder or shared_folder(pages.sparkSession, "warc")

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in (
            "page_id", "url", "payload", "first"))))
        row = next(rows, None)
        while row is not None:
            told = {"n": 0, "bytes": 0}

            def records():
                nonlocal row
                while row is not None and told["bytes"] < file_bytes:
                    r = record(*row, date)
                    told["n"] += 1
                    told["bytes"] += len(r)
                    yield r
                    row = next(rows, None)
            path = f"{folder}/part-{task:06d}-{number:06d}.warc.zst"
            size = write_once(path, archive(records(), level))
            yield pa.RecordBatch.from_pydict(
                {"path": [path], "n_records": [told["n"]], "bytes": [size]})
            number += 1
    return settle(with_references(pages, least_bytes).mapInArrow(
        run, "path string, n_records bigint, bytes bigint"), "archives")


def read_records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, one in memory at a time."""
    files, path = open_out(uri)
    with files.open_input_stream(path, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != DICTIONARY_MAGIC:
            raise ValueError(f"{uri} does not begin with a dictionary")
        shared = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(f.read(size)))
        with zstandard.ZstdDecompressor(dict_data=shared).stream_reader(
                f, read_across_frames=True) as s:
            buf = bytearray()

            def need(n):
                while len(buf) < n:
                    more = s.read(max(1 << 16, n - len(buf)))
                    if not more:
                        return False
                    buf.extend(more)
                return True

            while need(1):
                end = buf.find(b"\r\n\r\n")
                while end < 0:
                    if not need(len(buf) + 1):
                        raise ValueError(f"{uri} ends inside a record")
                    end = buf.find(b"\r\n\r\n")
                lines = bytes(buf[:end]).decode().split("\r\n")
                if lines[0] != VERSION:
                    raise ValueError(f"{uri}: no record where one should begin")
                head = dict(x.split(": ", 1) for x in lines[1:])
                n, at = int(head["Content-Length"]), end + 4
                if not need(at + n + 4):
                    raise ValueError(f"{uri} ends inside a record")
                yield head, bytes(buf[at:at + n])
                del buf[:at + n + 4]


def _page(urn: str | None) -> int | None:
    name = (urn or "").rpartition(":")[2].rstrip(">")
    return None if name in ("", "null") else int(name)


def read_archives(files: DataFrame) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null for
    revisits) of every record in ``files`` (path, n_records).  A response whose payload does not
    have its digest and a file that does not hold its number of records are errors."""
    n = max(1, files.count())

    def run(batches):
        for batch in batches:
            for path, n_records in zip(*(batch.column(c).to_pylist() for c in (
                    "path", "n_records"))):
                rows, held, n_read = [], 0, 0
                for head, block in read_records(path):
                    payload, n_read = None, n_read + 1
                    kind = head["WARC-Type"]
                    said = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(head["X-Payload-Length"])
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4:]
                        if digest32(payload) != said or len(payload) != size:
                            raise ValueError(f"{path}: damaged payload {head['WARC-Record-ID']}")
                    rows.append((_page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), kind,
                                 size, said, _page(head.get("WARC-Refers-To")), payload))
                    held += len(block)
                    if held > 8 << 20 or len(rows) == 10_000:
                        yield _frame(rows)
                        rows, held = [], 0
                if n_read != n_records:
                    raise ValueError(f"{path} holds {n_read} of {n_records} records")
                yield _frame(rows)
    return files.select("path", "n_records").repartition(n).mapInArrow(run, SCHEMA)


SCHEMA = ("page_id bigint, url string, record_type string, payload_bytes bigint, "
          "payload_digest string, refers_to bigint, payload binary")
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                    ("refers_to", pa.int64()), ("payload", pa.binary())])


def _frame(rows) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


WARC_SQL = """
with p as (
  select page_id, coalesce(html, '') as body from pages),
d as (
  select page_id, strlen(body)::bigint as payload_bytes, sha1(body) as h from p),
g as (
  select h, min(page_id) as first from d group by h)
select d.page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((
      (strpos('0123456789abcdef', substr(d.h, (5 * i // 4)::int + 1, 1)) - 1) * 16
      + strpos('0123456789abcdef', substr(d.h, (5 * i // 4)::int + 2, 1)) - 1)
      >> (3 - (5 * i) % 4)::int) & 31)::int, 1) for i in range(32)], '') as payload_digest,
  case when d.page_id = g.first then 'response' else 'revisit' end as record_type,
  case when d.page_id = g.first then null else g.first end as refers_to
from d join g using (h)
"""
