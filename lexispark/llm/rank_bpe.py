r"""BPE encoding and decoding with a contiguous rank array.

A short word is a row of parts that lie side by side, and a row with the rank of each border
between neighbours (of the merge that would remove it).  Again and again the border of the lowest
rank is found by scanning the row, deleted, and the ranks on both sides of the new part are looked
up afresh, until no border has a rank.  Rows of words of about one length are scanned together by
numpy.  Words of more than SHORT bytes keep their borders in a heap instead, which takes
n log n steps where scanning takes n^2.

Supported are byte-level models, with or without a suffix at word ends, whose pre-tokenizer
drops white space and whose normaliser is made of NFC, ``\s+`` to a blank, and lower case; others
are refused.  Then the ids of a text are those of its blank-separated chunks one after another, and
each distinct chunk is encoded once and remembered.  Special tokens are found in the text as given.
Letters are classed by the installed Unicode tables (15.1), unassigned characters as neither
letters nor numbers; lower case of letters that came with later versions may differ from the
library's.

Defined cases: null and empty texts (and those of white space) have no ids and decode to the empty
text; null ids decode to the empty text; ids outside the vocabulary are left out; repeated rows are
encoded alike; extra columns are carried, same-named ones replaced; an empty table gives an empty
table; a text of any length is encoded whole.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import Numbers, text_pieces, worker_memo

NO_RANK = np.int32(2 ** 31 - 1)
SHORT = 128              # bytes of a word that is scanned
CELLS = 1 << 20          # bytes of words scanned together
KNOWN_CHUNKS = 400_000   # chunks a worker remembers before it starts afresh
KNOWN_BYTES = 32 << 20   # and bytes of them
TEXT_BYTES = 4 << 20     # text encoded at once


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter that byte-level models write for each byte: printable ones stand for themselves,
    the others for 256, 257, ... in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@dataclass
class Model:
    """Tables of a tokenizer, all bounded by its vocabulary."""
    inner: np.ndarray          # id of each byte within a word
    final: np.ndarray          # id of each byte at a word's end
    pairs: np.ndarray          # sorted left << 32 | right
    pair_rank: np.ndarray
    merged: np.ndarray         # id of the part that a merge makes, by rank
    tokens: list[str | None]   # text of each id
    special: dict[str, int]
    pattern: str
    nfc: bool
    lower: bool

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, norm = spec["model"], spec.get("normalizer") or {}
        kinds = [x["type"] for x in norm.get("normalizers", [norm]) if x]
        split, level = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}])[:2]
        pattern = split.get("pattern", {}).get("Regex", "")
        if (model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges")
                or model.get("continuing_subword_prefix") or model.get("byte_fallback")
                or spec.get("decoder") or not set(kinds) <= {"NFC", "Replace", "Lowercase"}
                or split.get("behavior") != "Removed" or not split.get("invert")
                or r"[^\s" not in pattern or level.get("type") != "ByteLevel"
                or level.get("add_prefix_space") or level.get("use_regex")
                or any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"]
                       for x in spec["added_tokens"])):
            raise ValueError("only byte-level models that drop white space are supported")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        tokens: list[str | None] = [None] * (1 + max([*vocab.values(), *special.values()]))
        for token, i in [*vocab.items(), *special.items()]:
            tokens[i] = token
        letters = byte_letters()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        return cls(np.array([vocab[c] for c in letters], np.int32),
                   np.array([vocab[c + suffix] for c in letters], np.int32),
                   keys[order], order.astype(np.int32),
                   np.array([vocab[a + b] for a, b in pairs], np.int32), tokens, special,
                   pattern, "NFC" in kinds, "Lowercase" in kinds)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each two neighbours; NO_RANK where there is none (or no part)."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], NO_RANK)

    # ---- words ----

    def scan(self, words: list[bytes], width: int) -> np.ndarray:
        """(n, width) ids of words of 1 to ``width`` bytes, -1 behind the last."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        codes = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words),
                              np.uint8).reshape(n, width)
        parts = np.where(np.arange(width) < size[:, None], self.inner[codes], np.int32(-1))
        rows = np.arange(n)
        parts[rows, size - 1] = self.final[codes[rows, size - 1]]
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        out, live = np.full((n, width), -1, np.int32), rows
        while ranks.shape[1] and len(live):
            rows = np.arange(len(live))
            j = ranks.argmin(1)                      # of equal ranks the leftmost
            best = ranks[rows, j]
            on = best != NO_RANK
            if not on.all():
                out[live[~on], :parts.shape[1]] = parts[~on]
                live, parts, ranks, j, best = live[on], parts[on], ranks[on], j[on], best[on]
                rows = np.arange(len(live))
                if not len(live):
                    break
            parts[rows, j] = self.merged[best]
            keep = np.arange(parts.shape[1] - 1)
            parts = np.take_along_axis(parts, keep + (keep > j[:, None]), 1)
            keep = np.arange(ranks.shape[1] - 1)
            ranks = np.take_along_axis(ranks, keep + (keep >= j[:, None]), 1)
            a = np.flatnonzero(j > 0)
            ranks[a, j[a] - 1] = self.rank(parts[a, j[a] - 1], parts[a, j[a]])
            b = np.flatnonzero(j < ranks.shape[1])
            ranks[b, j[b]] = self.rank(parts[b, j[b]], parts[b, j[b] + 1])
        out[live, :parts.shape[1]] = parts
        return out

    def long_word(self, word: bytes) -> np.ndarray:
        """Ids of one word, its borders in a heap by (rank, place)."""
        code = np.frombuffer(word, np.uint8)
        part = self.inner[code]
        part[-1] = self.final[code[-1]]
        ranks = self.rank(part[:-1], part[1:])
        part = part.tolist()
        after, before = [*range(1, len(part)), -1], [*range(-1, len(part) - 1)]
        heap = [(int(r), int(i)) for i, r in enumerate(ranks) if r != NO_RANK]
        heapq.heapify(heap)
        current = ranks.tolist() + [int(NO_RANK)]   # rank of the border behind each part

        def refresh(i):
            if i < 0:
                return
            k = after[i]
            key = -1 if k < 0 else part[i] << 32 | part[k]
            at = min(int(np.searchsorted(self.pairs, key)), len(self.pairs) - 1)
            current[i] = int(self.pair_rank[at]) if self.pairs[at] == key else int(NO_RANK)
            if current[i] != NO_RANK:
                heapq.heappush(heap, (current[i], i))
        while heap:
            r, i = heapq.heappop(heap)
            if part[i] < 0 or current[i] != r:
                continue                             # a border that is gone or has a new rank
            k = after[i]
            part[i], part[k], after[i] = int(self.merged[r]), -1, after[k]
            if after[k] >= 0:
                before[after[k]] = i
            refresh(before[i])
            refresh(i)
        return np.array([p for p in part if p >= 0], np.int32)


class Encoder:
    """Encodes batches of texts with one model, remembering chunks."""

    def __init__(self, model: Model):
        self.m = model
        self.find = regex.compile(model.pattern).findall
        self.cut = (regex.compile("(" + "|".join(
            map(regex.escape, sorted(model.special, key=len, reverse=True))) + ")").split
            if model.special else lambda t: [t])
        self._forget()

    def _forget(self):
        self.place, self.ids = Numbers(), np.zeros(0, np.int32)
        self.place[""] = 0                           # before leading and behind trailing blanks
        self.start = self.count = np.zeros(1, np.int64)
        self.bytes = 0

    def batch(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if len(self.place) > KNOWN_CHUNKS or self.bytes > KNOWN_BYTES:
            self._forget()
        text = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        chunks = pc.ascii_split_whitespace(text)
        size = pc.list_value_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = chunks.flatten().dictionary_encode()  # a Python object a distinct chunk only
        known = coded.dictionary.to_pylist()
        at = np.fromiter(map(self.place.__getitem__, known), np.int64, len(known))[
            coded.indices.to_numpy()]
        if self.place.new:
            self._learn()
        n = self.count[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) - np.repeat(ends - n - self.start[at], n)]
        return ids, np.diff(np.append(0, ends)[np.cumsum(size)], prepend=0)

    def words(self, chunk: str) -> list[bytes | int]:
        """A chunk's words as bytes, and special tokens as their ids."""
        if chunk.isascii() and "<" not in chunk:
            return [w.encode() for w in self.find(chunk.lower() if self.m.lower else chunk)]
        out: list[bytes | int] = []
        for k, piece in enumerate(self.cut(chunk)):
            if k % 2:
                out.append(self.m.special[piece])
                continue
            if self.m.nfc:
                piece = unicodedata.normalize("NFC", piece)
            if self.m.lower:                         # letter by letter: no final form of sigma
                piece = piece.replace("Σ", "σ").lower()
            shape = piece if piece.isascii() else "".join(
                "\ue000" if unicodedata.category(c) == "Cn" else c for c in piece)
            if shape == piece:
                out += [w.encode() for w in self.find(piece)]
            else:
                out += [piece[m.start():m.end()].encode()
                        for m in regex.finditer(self.m.pattern, shape)]
        return out

    def _learn(self):
        chunks, self.place.new = self.place.new, []
        self.bytes += sum(map(len, chunks))
        number = Numbers()
        lists = [[number[w] for w in self.words(c)] for c in chunks]
        ids, count = self._encode(number.new)
        start = np.cumsum(count) - count
        at = np.array([i for x in lists for i in x], np.int64)
        n = count[at]
        ends = np.cumsum(n)
        flat = ids[np.arange(int(n.sum())) - np.repeat(ends - n - start[at], n)]
        upto = np.append(0, ends)[np.cumsum([len(x) for x in lists])]
        sizes = np.diff(upto, prepend=0)
        self.start = np.append(self.start, len(self.ids) + upto - sizes)
        self.count = np.append(self.count, sizes)
        self.ids = np.concatenate([self.ids, flat])

    def _encode(self, words: list[bytes | int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after another, number of ids of each)."""
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            k = 0 if isinstance(w, int) else max(4, 1 << (len(w) - 1).bit_length())
            groups.setdefault(k if k <= SHORT else -1, []).append(i)
        count = np.zeros(len(words), np.int64)
        got = []
        for width, group in groups.items():
            if width > 0:
                step = max(1, CELLS // width)
                for a in range(0, len(group), step):
                    part = group[a:a + step]
                    ids = self.m.scan([words[i] for i in part], width)
                    used = ids >= 0
                    count[part] = used.sum(1)
                    got.append((part, ids[used]))
            else:
                for i in group:
                    ids = (self.m.long_word(words[i]) if width else np.array([words[i]], np.int32))
                    count[i] = len(ids)
                    got.append(([i], ids))
        start = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int32)
        for part, ids in got:
            n = count[part]
            ends = np.cumsum(n)
            out[np.arange(len(ids)) - np.repeat(ends - n - start[part], n)] = ids
        return out, count


class Decoder:
    """Texts of ids: the tokens with a blank between them, as a model without a decoder has it."""

    def __init__(self, model: Model):
        self.tokens = pa.array([None if t is None else t + " " for t in model.tokens], pa.string())

    def batch(self, ids: np.ndarray, n: np.ndarray) -> pa.Array:
        """``n`` ids a text, one text after another."""
        good = (ids >= 0) & (ids < len(self.tokens))
        taken = self.tokens.take(pa.array(np.where(good, ids, 0)))
        if not good.all():
            taken = pc.if_else(pa.array(good), taken, pa.scalar(None, pa.string()))
        taken = taken.fill_null("").cast(pa.large_string())
        # the tokens of all texts lie one after another: a text is a stretch of that buffer
        _, at, data = taken.buffers()
        at = np.frombuffer(at, np.int64)[taken.offset:taken.offset + len(ids) + 1]
        edge = at[np.append(0, np.cumsum(n))] if len(ids) else np.zeros(len(n) + 1, np.int64)
        raw = memoryview(data) if data else memoryview(b"")
        return pa.array([str(raw[a:max(a, b - 1)], "utf-8")
                         for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())], pa.string())


def encode(docs: DataFrame, tokenizer: str | None = None, text: str = "text",
           decoded: bool = False) -> DataFrame:
    """``docs`` with ids (array of int) and, if asked, decoded (the text that these ids stand for,
    made in the same task)."""
    path = tokenizer or default_tokenizer()
    base = docs.drop("ids", *(["decoded"] if decoded else []))
    shared = docs.sparkSession.sparkContext.broadcast(Model.load(path))

    def run(batches):
        coder = worker_memo(("rank_bpe", path), lambda: Encoder(shared.value))
        back = Decoder(coder.m) if decoded else None
        for whole in batches:
            for batch in text_pieces(whole, text, TEXT_BYTES):
                ids, n = coder.batch(batch.column(text))
                at = np.append(0, np.cumsum(n)).astype(np.int32)
                more = [pa.ListArray.from_arrays(at, pa.array(ids, pa.int32()))]
                if back is not None:
                    more.append(back.batch(ids, n))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *more],
                    names=[*batch.schema.names, *["ids", "decoded"][:len(more)]])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(run, f"{schema}, ids array<int>" + ", decoded string" * decoded)


def decode(docs: DataFrame, tokenizer: str | None = None, ids: str = "ids") -> DataFrame:
    """``docs`` with decoded, the text that the ids stand for."""
    path = tokenizer or default_tokenizer()
    base = docs.drop("decoded")
    shared = docs.sparkSession.sparkContext.broadcast(Model.load(path))

    def run(batches):
        back = Decoder(shared.value)
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                column = batch.column(ids)
                n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
                flat = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, back.batch(flat.astype(np.int64), n.astype(np.int64))],
                    names=[*batch.schema.names, "decoded"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(run, f"{schema}, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    """n_tokens and the SHA-256 of the ids (decimal, a blank between) and of the decoded text."""
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
