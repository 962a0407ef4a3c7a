r"""Token ids in files of patched frame-of-reference blocks.

Documents are dealt by range of doc_id, sorted, encoded, and written one file a task; the ids of a
file are one sequence cut into blocks of 128.  A block stores its minimum, a bit width that holds
the ``percentile`` of its differences to the minimum, the differences packed at that width, and an
exception list (position, whole difference) for those that do not fit.

File: MAGIC, blocks, block starts (uint64), document ids (int64), id-is-null flags (uint8), ids of
each document (uint64), footer (JSON with counts and places), its length (uint32), MAGIC.
Block: minimum (uint32), width (uint8), exceptions (uint8), 16 * width bytes, positions (uint8
each), differences (uint32 each).  Numbers are little-endian.

Defined cases: null and empty texts are the end id alone; null ids come first; rows with equal ids
follow by a hash of their text and then equal rows in any order, as they are the same; extra
columns do not matter; an empty table writes no file and reads as an empty table.
"""

from __future__ import annotations

import json
import math
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import (
    Numbers, open_out, settle, shared_folder, worker_memo, write_once,
)

MAGIC = b"TOKPFOR1"
BLOCK = 128
HEAD = 6                 # bytes before the packed differences
CHUNK = 1 << 12          # blocks packed or unpacked at once
FILE_BYTES = 32 << 20    # text that goes into a file
KNOWN_WORDS = 1_000_000  # words a worker remembers before it starts afresh
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"   # marks that stay one part behind letters
FORMAT = {"block": BLOCK, "version": 1}


# ---- blocks -------------------------------------------------------------------------------------

def bits(x: np.ndarray) -> np.ndarray:
    """Bits that hold each number (0 for 0)."""
    return np.ceil(np.log2(x.astype(np.float64) + 1.0)).astype(np.int64)


def pack(ids: np.ndarray, percentile: float = 90.0) -> tuple[bytes, np.ndarray]:
    """(bytes, size of each block).  The last block may be short; it is filled with its minimum."""
    n = -(-len(ids) // BLOCK)
    full = np.empty(n * BLOCK, np.int64)
    full[:len(ids)] = ids
    if len(ids) % BLOCK:
        full[len(ids):] = ids[(n - 1) * BLOCK:].min()
    full = full.reshape(n, BLOCK)
    low = full.min(1)
    diff = full - low[:, None]
    rank = min(BLOCK - 1, max(0, math.ceil(percentile / 100 * BLOCK) - 1))
    width = bits(np.partition(diff, rank, axis=1)[:, rank])
    over = diff >> width[:, None] != 0
    n_over = over.sum(1)
    size = HEAD + 16 * width + 5 * n_over
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[start[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(n, 4)
    out[start + 4], out[start + 5] = width, n_over
    for w in np.unique(width):
        if w:
            at = np.flatnonzero(width == w)
            plane = np.unpackbits(diff[at].astype("<u4").view(np.uint8).reshape(len(at), BLOCK, 4),
                                  axis=2, bitorder="little")[:, :, :w]
            out[start[at][:, None] + HEAD + np.arange(16 * w)] = np.packbits(
                plane.reshape(len(at), -1), axis=1, bitorder="little")
    b, p = np.nonzero(over)
    nth = np.arange(len(b)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
    lists = start[b] + HEAD + 16 * width[b]
    out[lists + nth] = p
    out[(lists + n_over[b] + 4 * nth)[:, None] + np.arange(4)] = diff[b, p].astype("<u4").view(
        np.uint8).reshape(len(b), 4)
    return out.tobytes(), size


def unpack(raw: bytes, start: np.ndarray) -> np.ndarray:
    """Ids of the whole blocks that begin at ``start`` within ``raw``."""
    buf, n = np.frombuffer(raw, np.uint8), len(start)
    low = np.ascontiguousarray(buf[start[:, None] + np.arange(4)]).view("<u4").reshape(n)
    width, n_over = buf[start + 4].astype(np.int64), buf[start + 5].astype(np.int64)
    diff = np.zeros((n, BLOCK), np.int64)
    for w in np.unique(width):
        if w:
            at = np.flatnonzero(width == w)
            plane = np.zeros((len(at), BLOCK, 32), np.uint8)
            plane[:, :, :w] = np.unpackbits(
                buf[start[at][:, None] + HEAD + np.arange(16 * w)], axis=1,
                bitorder="little").reshape(len(at), BLOCK, w)
            diff[at] = np.packbits(plane, axis=2, bitorder="little").view("<u4").reshape(
                len(at), BLOCK)
    b = np.repeat(np.arange(n), n_over)
    nth = np.arange(len(b)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
    lists = start[b] + HEAD + 16 * width[b]
    where = (lists + n_over[b] + 4 * nth)[:, None] + np.arange(4)
    diff[b, buf[lists + nth]] = np.ascontiguousarray(buf[where]).view("<u4").reshape(len(b))
    return (diff + low[:, None]).reshape(-1)


# ---- encoding -----------------------------------------------------------------------------------

def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts by the tokenizers library, which sees each distinct word once.

    This holds for tokenizers that drop white space before they split and merge: then the ids of a
    text are those of its words one after another.  ``by_word`` says whether a tokenizer does; any
    other one gets whole texts."""

    #: A private-use character that stands between words given to the library at once.
    MARK = "\ue000"

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer
        spec = json.loads(tokenizer_json)
        self.t = Tokenizer.from_str(tokenizer_json)
        self.by_word = drops_spaces(spec)
        self.mark = np.array(self._encode(self.MARK), np.int64)
        suffix = spec["model"].get("end_of_word_suffix")
        size = self.t.get_vocab_size(with_added_tokens=True)
        self.final = np.zeros(size, bool)          # tokens that end a word or a mark
        for token, i in spec["model"]["vocab"].items() if suffix else ():
            self.final[i] = token.endswith(suffix)
        self._forget()

    def _encode(self, text: str) -> list[int]:
        return self.t.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _forget(self):
        self.place, self.ids = Numbers(), np.zeros(0, np.int64)
        self.start = self.count = np.zeros(1, np.int64)
        self.place[""] = 0                             # between blanks; it has no ids

    def batch(self, texts: pa.Array | list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with ``end`` behind it; number of ids of each)."""
        if not self.by_word:
            lists = [self._encode(t or "") + [end] for t in (
                texts.to_pylist() if isinstance(texts, pa.Array) else texts)]
            return (np.array([i for x in lists for i in x], np.int64),
                    np.array([len(x) for x in lists], np.int64))
        if len(self.place) > KNOWN_WORDS:
            self._forget()
        text = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        text = text.fill_null("")
        # the tokenizer lower-cases anyway, but not the names of special tokens
        named = pc.match_substring(text, "<|")
        low = pc.ascii_lower(text)
        words = pc.ascii_split_whitespace(pc.if_else(named, text, low) if pc.any(named).as_py() else low)
        size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()       # a Python object a distinct word only
        known = coded.dictionary.to_pylist()
        at = np.fromiter(map(self.place.__getitem__, known), np.int64, len(known))[
            coded.indices.to_numpy()]
        self._learn()
        n = self.count[at]
        # the end ids stand where the words of each text have run out
        upto = np.append(0, np.cumsum(n))[np.cumsum(size)]
        n_text = np.diff(upto, prepend=0) + 1
        out = np.full(int(n.sum()) + len(texts), end, np.int64)
        stop = np.zeros(len(out), bool)
        stop[np.cumsum(n_text) - 1] = True
        ends = np.cumsum(n)
        out[~stop] = self.ids[np.arange(len(out) - len(texts)) - np.repeat(ends - n, n)
                              + np.repeat(self.start[at], n)]
        return out, n_text

    def _learn(self, at_once: int = 4000):
        words, self.place.new = self.place.new, []
        got = [self._encode_words(words[a:a + at_once]) for a in range(0, len(words), at_once)]
        self.ids = np.concatenate([self.ids, *(x for x, _ in got)])
        self.count = np.concatenate([self.count, *(n for _, n in got)])
        self.start = np.cumsum(self.count) - self.count

    def _encode_words(self, text: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters, and such words with marks behind, are split in a known number of parts,
        each of which ends in a final token; the others stand between marks."""
        parts = np.fromiter((1 if w.isalpha() else 2 if w.rstrip(TAIL).isalpha() else 0
                             for w in text), np.int64, len(text))
        if not parts.all():
            plain, other = np.flatnonzero(parts), np.flatnonzero(parts == 0)
            some = [([text[i] for i in plain], parts[plain])] if len(plain) else []
            got = [self._plain(*x) for x in some] + [self._marked([text[i] for i in other])]
            n = np.zeros(len(text), np.int64)
            order = np.concatenate([plain, other])
            n[order] = np.concatenate([x[1] for x in got])
            ids, sizes = np.concatenate([x[0] for x in got]), n[order]
            back = np.argsort(order)
            begin = (np.cumsum(sizes) - sizes)[back]
            ends = np.cumsum(n)
            return ids[np.arange(len(ids)) - np.repeat(ends - n, n) + np.repeat(begin, n)], n
        return self._plain(text, parts)

    def _plain(self, text: list[str], parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self._encode(" ".join(text)), np.int64)
        stops = np.flatnonzero(self.final[ids]) + 1
        if len(stops) != parts.sum() or (len(ids) and stops[-1] != len(ids)):
            return self._marked(text)
        return ids, np.diff(stops[np.cumsum(parts) - 1], prepend=0)

    def _marked(self, text: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = [self.MARK in w for w in text]
        got = np.array(self._encode(" ".join(x for w, o in zip(text, odd) for x in (
            "" if o else w, self.MARK))), np.int64)
        k = len(self.mark)
        hit = np.ones(max(0, len(got) - k + 1), bool)
        for i, m in enumerate(self.mark):
            hit &= got[i:len(got) - k + 1 + i] == m
        stops = np.flatnonzero(hit)
        if len(stops) != len(text):
            raise ValueError("the tokenizer does not encode words one by one")
        n = np.diff(stops, prepend=-k) - k
        keep = np.ones(len(got), bool)
        keep[(stops[:, None] + np.arange(k)).reshape(-1)] = False
        ids = got[keep]
        if any(odd):
            split = np.split(ids, np.cumsum(n)[:-1])
            for i in np.flatnonzero(odd):
                split[i] = np.array(self._encode(text[i]), np.int64)
            ids, n = np.concatenate(split), np.array([len(p) for p in split])
        return ids, n


def drops_spaces(spec: dict) -> bool:
    """Lower-cases, and splits by a pattern that drops white space, before anything else."""
    norm = spec.get("normalizer") or {}
    kinds = [x["type"] for x in norm.get("normalizers", [norm]) if x]
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    pattern = first.get("pattern", {}).get("Regex", "")
    return ("Lowercase" in kinds and set(kinds) <= {"NFC", "Replace", "Lowercase"}
            and first.get("type") == "Split" and first.get("behavior") == "Removed"
            and bool(spec["model"].get("end_of_word_suffix")) and bool(first.get("invert"))
            and re.search(r"\[\^\\s", pattern) is not None)


# ---- files --------------------------------------------------------------------------------------

def file_parts(batches, coder: WordEncoder, end: int, percentile: float, told: dict):
    """Byte strings of a file for Arrow batches of (doc_id, text) in order; counts go to told."""
    yield MAGIC
    at, rest = len(MAGIC), np.zeros(0, np.int64)
    sizes, doc_ids, doc_null, doc_n = [], [], [], []

    def packed(ids):
        nonlocal at
        for a in range(0, len(ids), CHUNK * BLOCK):
            raw, size = pack(ids[a:a + CHUNK * BLOCK], percentile)
            sizes.append(size)
            at += len(raw)
            yield raw

    for batch in batches:
        ids, n = coder.batch(batch.column("text"), end)
        column = batch.column("doc_id")
        doc_ids.append(column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        doc_null.append(column.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
        doc_n.append(n)
        rest = np.concatenate([rest, ids])
        whole = len(rest) // BLOCK * BLOCK
        yield from packed(rest[:whole])
        rest = rest[whole:]
    yield from packed(rest)
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    n = np.concatenate(doc_n) if doc_n else np.zeros(0, np.int64)
    tables = {"starts": (len(MAGIC) + np.cumsum(size) - size).astype("<u8"),
              "doc_ids": (np.concatenate(doc_ids) if doc_ids else n).astype("<i8"),
              "doc_null": np.concatenate(doc_null) if doc_null else n.astype(np.uint8),
              "doc_n": n.astype("<u8")}
    footer = FORMAT | {"n_ids": int(n.sum()), "n_docs": len(n), "blocks_end": at}
    for name, x in tables.items():
        footer[name] = [at, x.nbytes]
        at += x.nbytes
        yield x.tobytes()
    raw = json.dumps(footer).encode()
    told.update(n_docs=len(n), n_ids=int(n.sum()))
    yield raw + struct.pack("<I", len(raw)) + MAGIC


def read_documents(uri: str):
    """(id or None, ids as uint32 pieces in order) of each document, with bounded memory: a piece is
    at most CHUNK blocks."""
    files, path = open_out(uri)
    with files.open_input_file(path) as f:
        total = f.size()

        def at(place, n):
            f.seek(place)
            return f.read(n)
        tail = at(total - len(MAGIC) - 4, len(MAGIC) + 4)
        if tail[4:] != MAGIC or at(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{uri} is no whole token file")
        n = struct.unpack("<I", tail[:4])[0]
        footer = json.loads(at(total - len(MAGIC) - 4 - n, n))
        table = lambda k, t: np.frombuffer(at(*footer[k]), t)
        starts, doc_n = table("starts", "<u8").astype(np.int64), table("doc_n", "<u8").astype(np.int64)
        doc_ids, doc_null = table("doc_ids", "<i8"), table("doc_null", np.uint8)
        ends = np.append(starts, footer["blocks_end"])
        doc, parts, left = 0, [], int(doc_n[0]) if len(doc_n) else 0
        remaining = footer["n_ids"]
        for a in range(0, len(starts), CHUNK):
            b = min(len(starts), a + CHUNK)
            ids = unpack(at(int(ends[a]), int(ends[b] - ends[a])), starts[a:b] - ends[a])
            ids = ids[:remaining].astype("<u4")
            remaining -= len(ids)
            k = 0
            while doc < len(doc_n) and len(ids) - k >= left:
                yield (None if doc_null[doc] else int(doc_ids[doc])), [*parts, ids[k:k + left]]
                k, parts, doc = k + left, [], doc + 1
                left = int(doc_n[doc]) if doc < len(doc_n) else 0
            if k < len(ids):
                parts.append(ids[k:])
                left -= len(ids) - k


def write_tokens(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None,
                 end: int = 1, percentile: float = 90.0,
                 file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) below ``folder`` and return the list of files:
    file_no (in ascending order of doc_id), path, n_docs, n_ids, bytes, start (ids in all files
    before)."""
    from pyspark import TaskContext
    folder = folder or shared_folder(docs.sparkSession, "tokens")
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_files = max(1, -(-int(size) // file_bytes))
    tie = F.xxhash64("text")
    dealt = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
             .withColumn("tie", tie).repartitionByRange(n_files, "doc_id", "tie")
             .sortWithinPartitions("doc_id", "tie").select("doc_id", "text"))

    def run(batches):
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        number, told = TaskContext.get().partitionId(), {}
        path = f"{folder}/part-{number:06d}.tok"
        coder = worker_memo(("words", spec.value), lambda: WordEncoder(spec.value))

        def every():
            yield first
            yield from batches
        size = write_once(path, file_parts(every(), coder, end, percentile, told))
        yield pa.RecordBatch.from_pydict({"file_no": [number], "path": [path], "bytes": [size],
                                          "n_docs": [told["n_docs"]], "n_ids": [told["n_ids"]]})
    files = settle(dealt.mapInArrow(
        run, "file_no bigint, path string, bytes bigint, n_docs bigint, n_ids bigint"), "files")
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    n = max(1, files.count())

    def run(batches):
        for pdf in batches:
            for path, start in zip(pdf["path"], pdf["start"]):
                rows, at = [], int(start)
                for doc_id, parts in read_documents(path):
                    crc, size = 0, 0
                    for p in parts:
                        crc, size = zlib.crc32(p.tobytes(), crc), size + len(p)
                    rows.append((doc_id, at, size, crc))
                    at += size
                    if len(rows) == 10_000:
                        yield _frame(rows)
                        rows = []
                yield _frame(rows)
    return files.select("path", "start").repartition(n).mapInPandas(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _frame(rows) -> pd.DataFrame:
    got = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    return got.astype({"doc_id": "Int64", "start": "int64", "n_tokens": "int64",
                       "ids_crc32": "int64"})
