"""SentencePiece encoding and decoding by batched numpy Viterbi.

Distinct words of a batch are grouped by length and advance together, one character at a time:
hashes of all substrings that end here probe the sorted keys of the pieces, and the best
predecessor of every word is stored as a backpointer.

Unigram models: the best segmentation has the highest sum of piece scores.  BPE models: a path is
admissible if each piece is what its own characters merge to and no merge crosses a border between
neighbours before their own merges are done; exactly one admissible path ends at each character
(a prefix of whole pieces merges to these pieces), so the same forward pass with admissibility as
its score gives the ids of the merge procedure.  Whether two pieces may be neighbours is found by
running the two recorded merge sequences side by side, for all new pairs at once.

Text before segmentation: blanks become U+2581 and one is put in front, as the model's settings
say.  Models that normalise by a character map are refused.  Characters outside the vocabulary
become their UTF-8 bytes' pieces, or the unknown piece where the model has no bytes.

Memory: a task works on about TEXT_BYTES of text at a time.  Words are split and numbered by Arrow, so Python
sees each distinct word of such a piece once, and those that a task remembers are bounded in number and
bytes.  Decoding takes the pieces' bytes from one table: the ids of all texts are one gather.

Defined cases: null and empty texts have no ids and decode to the empty text; repeated rows are
encoded alike; a text that contains U+2581 itself decodes with blanks there; extra columns are
carried, same-named ones replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lexispark.llm.common import Numbers, mix64, text_pieces

_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15)
BLANK = "▁"
LOWEST = -np.inf
UNKNOWN_PENALTY = 10.0   # an unknown character scores this much below the worst piece
KNOWN_WORDS = 300_000    # words a task remembers before it starts afresh
KNOWN_BYTES = 24 << 20   # and bytes of them
TEXT_BYTES = 4 << 20     # text encoded at once
CUT = "\uffff"           # no character: stands between words while they are split
MARK_BITS = 22
PAIR_SLOTS = 1 << 21     # neighbour answers a task remembers
CELLS = 1 << 18          # substrings probed at once


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


@dataclass
class Pieces:
    """Tables of a model, all bounded by its vocabulary; plain arrays, so it can be broadcast."""
    bpe: bool
    prefix: bool                 # put a blank in front
    strings: list[str]
    scores: np.ndarray
    unknown: int
    byte_ids: np.ndarray | None  # id of each byte's piece
    special: set[int]
    longest: int
    cut_words: bool              # no piece goes on with a blank after another character
    cut_lines: bool              # no piece holds a line end
    powers: np.ndarray
    keys: np.ndarray             # sorted substring hashes of the pieces
    key_ids: np.ndarray
    marks: np.ndarray            # by leading hash bits: some key has them
    own: np.ndarray              # hash of each piece
    size: np.ndarray             # characters of each piece
    merges: np.ndarray | None = None    # BPE: scores of a piece's merges in order
    first_part: np.ndarray | None = None  # first and last part before each merge
    last_part: np.ndarray | None = None
    whole: np.ndarray | None = None     # BPE: the piece's characters merge to it

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as proto
        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces:
            raise ValueError("only models without text normalisation are supported")
        if m.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        strings = [p.piece for p in m.pieces]
        kinds = np.array([p.type for p in m.pieces])
        scores = np.array([p.score for p in m.pieces], np.float64)
        by_byte = {int(strings[i][3:5], 16): i for i in np.flatnonzero(kinds == 6)}
        usable = np.flatnonzero((kinds == 1) | (kinds == 4))
        longest = max((len(strings[i]) for i in usable), default=1)
        powers = np.ones(longest + 1, _U)
        for i in range(longest):
            powers[i + 1:i + 2] = powers[i:i + 1] * BASE
        own = np.zeros(len(strings), _U)
        for i in usable:
            own[i] = cls.prefix_hashes(_codes(strings[i])[None])[0, -1]
        order = usable[np.argsort(own[usable], kind="stable")]
        keys = own[order]
        if (keys[1:] == keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        marks = np.zeros(1 << MARK_BITS, bool)
        marks[keys >> _U(64 - MARK_BITS)] = True
        out = cls(m.trainer_spec.model_type == 2, n.add_dummy_prefix, strings, scores,
                  int(np.flatnonzero(kinds == 2)[0]),
                  np.array([by_byte[b] for b in range(256)]) if len(by_byte) == 256 else None,
                  set(np.flatnonzero(kinds == 3).tolist()), longest,
                  not any(re.search(f"[^{BLANK}]{BLANK}", strings[i]) for i in usable),
                  not any("\n" in strings[i] for i in usable),
                  powers, keys, order, marks, own,
                  np.array([len(s) for s in strings]))
        if out.bpe:
            out._record_merges(usable)
        return out

    @staticmethod
    def prefix_hashes(codes: np.ndarray) -> np.ndarray:
        """(n, L) characters -> (n, L + 1) hashes of the prefixes."""
        h = np.zeros((codes.shape[0], codes.shape[1] + 1), _U)
        spread = mix64(codes.astype(_U) + _U(1))
        for j in range(codes.shape[1]):
            h[:, j + 1] = h[:, j] * BASE + spread[:, j]
        return h

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes (flat), -1 where there is none."""
        out = np.full(len(hashes), -1, np.int64)
        where = np.flatnonzero(self.marks[hashes >> _U(64 - MARK_BITS)])  # most others end here
        wanted = hashes[where]
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == wanted
        out[where[hit]] = self.key_ids[at[hit]]
        return out

    def _record_merges(self, usable: np.ndarray) -> None:
        """Merge every piece's own characters, the highest score first and then the leftmost."""
        rank = {self.strings[i]: (self.scores[i], int(i)) for i in usable}
        v, k = len(self.strings), self.longest
        self.merges = np.full((v + 1, k), LOWEST)
        self.first_part, self.last_part = (np.full((v + 1, k), -1, np.int64) for _ in range(2))
        self.whole = np.zeros(v + 1, bool)
        for i in usable:
            parts, step = list(self.strings[i]), 0
            while True:
                self.first_part[i, step:] = rank.get(parts[0], (0, -1))[1]
                self.last_part[i, step:] = rank.get(parts[-1], (0, -1))[1]
                best = max(((rank[a + b][0], -j) for j, (a, b) in enumerate(zip(parts, parts[1:]))
                            if a + b in rank), default=None)
                if best is None:
                    break
                self.merges[i, step] = best[0]
                j, step = -best[1], step + 1
                parts[j:j + 2] = [parts[j] + parts[j + 1]]
            self.whole[i] = len(parts) == 1

    def neighbours(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        """May piece p follow piece q?"""
        ok = np.ones(len(q), bool)
        live = np.arange(len(q))
        i, j = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        last = self.merges.shape[1] - 1
        while len(live):
            ql, pl, il, jl = q[live], p[live], i[live], j[live]
            u = self.last_part[ql, np.minimum(il, last)]
            v = self.first_part[pl, np.minimum(jl, last)]
            a = np.where(il <= last, self.merges[ql, np.minimum(il, last)], LOWEST)
            b = np.where(jl <= last, self.merges[pl, np.minimum(jl, last)], LOWEST)
            size = self.size[v]
            fits = (u >= 0) & (v >= 0) & (self.size[u] + size <= self.longest)
            both = self.find(self.own[u] * self.powers[np.minimum(size, self.longest)]
                             + self.own[v])
            x = np.where(fits & (both >= 0), self.scores[both], LOWEST)
            # the crossing merge comes next; of equal scores the leftmost comes first
            crossed = (x > a) & (x >= b) & (x > LOWEST)
            ok[live[crossed]] = False
            left = a >= b
            i[live] += left
            j[live] += ~left
            live = live[~crossed & ((a > LOWEST) | (b > LOWEST))]
        return ok

    def decode(self, ids) -> str:
        return Decoder(self).batch(np.asarray(list(ids), np.int64), np.array([len(ids)]))[0].as_py()

    def piece_bytes(self) -> list[bytes]:
        """What each id stands for."""
        table = [s.encode() for s in self.strings]
        if self.byte_ids is not None:
            for b, k in enumerate(self.byte_ids):
                table[k] = bytes([b])
        for k in self.special:
            table[k] = b""
        table[self.unknown] = " ⁇ ".encode()
        return table


class Decoder:
    """Decodes batches of ids with one model."""

    def __init__(self, model: Pieces):
        self.table = pa.array(model.piece_bytes(), pa.large_binary())
        self.prefix = model.prefix

    def batch(self, ids: np.ndarray, n: np.ndarray) -> pa.Array:
        """Texts of ``n`` ids each, one text after another."""
        taken = self.table.take(pa.array(ids))
        _, at, data = taken.buffers()             # the bytes of all texts, one after another
        at = np.frombuffer(at, np.int64)[taken.offset:taken.offset + len(ids) + 1] if len(ids) else [0]
        edge = np.asarray(at)[np.append(0, np.cumsum(n))].tolist()
        raw = memoryview(data) if data else memoryview(b"")
        texts = (str(raw[a:b], "utf-8", "replace").replace(BLANK, " ") for a, b in zip(edge, edge[1:]))
        return pa.array([t[1:] if self.prefix and t[:1] == " " else t for t in texts], pa.string())


class Encoder:
    """Encodes batches of texts with one model, remembering words."""

    def __init__(self, model: Pieces):
        self.m = model
        cut = "\n" if model.cut_lines else ""
        self.words = (f"[{BLANK}]+[^{BLANK}{cut}]*|[^{BLANK}{cut}]+" + "|\n" * bool(cut)
                      if model.cut_words else "(?s).+")
        self.find = re.compile(self.words).findall
        # BPE: answers about neighbours, each in the slot of its hash
        self.pairs = np.full(PAIR_SLOTS if model.bpe else 0, -1, np.int64)
        self.pair_ok = np.zeros(len(self.pairs), bool)
        self._forget()

    def _forget(self):
        self.place, self.ids = Numbers(), np.zeros(0, np.int32)
        self.place[""] = 0                        # behind the last word; it has no ids
        self.start = self.count = np.zeros(1, np.int64)
        self.bytes = 0

    def _numbered(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word, words of each text)."""
        text = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        text = pc.replace_substring(text, " ", BLANK)
        if self.m.prefix:
            some = pc.greater(pc.binary_length(text), 0)
            text = pc.if_else(some, pc.binary_join_element_wise(BLANK, text, ""), text)
        if pc.any(pc.match_substring(text, CUT)).as_py():
            lists = [self.find(t) for t in text.to_pylist()]
            flat = pa.array([w for x in lists for w in x], pa.string())
            size = np.array([len(x) for x in lists], np.int64)
        else:
            cut = pc.split_pattern(pc.replace_substring_regex(text, self.words, "\\0" + CUT), CUT)
            size = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = cut.flatten()
        coded = flat.dictionary_encode()          # a Python object a distinct word only
        known = coded.dictionary.to_pylist()
        numbers = np.fromiter(map(self.place.__getitem__, known), np.int64, len(known))
        return numbers[coded.indices.to_numpy()], size

    def batch(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if len(self.place) > KNOWN_WORDS or self.bytes > KNOWN_BYTES:
            self._forget()
        at, size = self._numbered(texts)
        if self.place.new:
            self._learn()
        n = self.count[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) - np.repeat(ends - n - self.start[at], n)]
        return ids, np.diff(np.append(0, ends)[np.cumsum(size)], prepend=0)

    def _learn(self):
        words, self.place.new = self.place.new, []
        self.bytes += sum(map(len, words))
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            groups.setdefault(len(w), []).append(i)
        flat, order, counts = [], [], []
        for size, group in sorted(groups.items()):
            step = max(1, CELLS // (min(size, 4096) * min(size, self.m.longest)))
            for a in range(0, len(group), step):
                part = group[a:a + step]
                ids, n = self._viterbi([words[i] for i in part], size)
                flat.append(ids)
                order += part
                counts.append(n)
        n = np.empty(len(words), np.int64)
        begin = np.empty(len(words), np.int64)
        sizes = np.concatenate(counts)
        n[order], begin[order] = sizes, np.cumsum(sizes) - sizes + len(self.ids)
        self.ids = np.concatenate([self.ids, *flat])
        self.count, self.start = np.append(self.count, n), np.append(self.start, begin)

    def _viterbi(self, words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each) for words of ``size`` characters."""
        m, n = self.m, len(words)
        codes = _codes("".join(words)).reshape(n, size)
        lens = np.arange(1, min(m.longest, size) + 1)
        best = np.full((size + 1, n), LOWEST)
        best[0] = 0.0
        back = np.ones((size + 1, n), np.int32)           # length of the last piece
        piece = np.full((size + 1, n), -1, np.int32)      # -1: unknown character
        piece[0] = -2                                     # start of the word
        alone = 0.0 if m.bpe else m.scores[m.key_ids].min() - UNKNOWN_PENALTY
        h = np.ascontiguousarray(m.prefix_hashes(codes).T)
        block = max(1, CELLS // (n * len(lens)))
        for e0 in range(1, size + 1, block):
            ends = np.arange(e0, min(size, e0 + block - 1) + 1)
            e_of, l_of = (x.reshape(-1) for x in np.meshgrid(ends, lens, indexing="ij"))
            inside = l_of <= e_of
            e_of, l_of = e_of[inside], l_of[inside]
            sub = h[e_of] - h[e_of - l_of] * m.powers[l_of][:, None]
            found = m.find(sub.reshape(-1))
            where = np.flatnonzero(found >= 0)
            span, word = np.divmod(where, n)
            cand, end, length = found[where], e_of[span], l_of[span]
            if m.bpe:
                keep = m.whole[cand]
                cand, end, length, word = cand[keep], end[keep], length[keep], word[keep]
            cuts = np.searchsorted(end, np.append(ends, ends[-1] + 1))
            for k, e in enumerate(ends):
                best[e] = best[e - 1] + alone
                c, ln, w = (x[cuts[k]:cuts[k + 1]] for x in (cand, length, word))
                if m.bpe:
                    ok = self._follow(piece[e - ln, w], c)
                    c, ln, w = c[ok], ln[ok], w[ok]       # one admissible path a word at most
                    value = best[e - ln, w]
                else:
                    value = best[e - ln, w] + m.scores[c]
                    order = np.argsort(value, kind="stable")
                    order = order[value[order] > best[e, w[order]]]
                    c, ln, w, value = c[order], ln[order], w[order], value[order]
                best[e, w], back[e, w], piece[e, w] = value, ln, c   # the last one is the highest
        return self._trace(codes, back, piece)

    def _follow(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        """May p follow q (-2: p starts the word)?"""
        ok = q < 0
        ask = np.flatnonzero(~ok)
        key = q[ask].astype(np.int64) << 32 | p[ask]
        slot = (mix64(key.view(_U)) & _U(PAIR_SLOTS - 1)).astype(np.int64)
        fresh = np.flatnonzero(self.pairs[slot] != key)
        answer = self.pair_ok[slot]
        if len(fresh):
            new, inverse = np.unique(key[fresh], return_inverse=True)
            good = self.m.neighbours(new >> 32, new & 0xFFFFFFFF)
            answer[fresh] = good[inverse]
            at = (mix64(new.view(_U)) & _U(PAIR_SLOTS - 1)).astype(np.int64)
            self.pairs[at] = new
            self.pair_ok[at] = good
        ok[ask] = answer
        return ok

    def _trace(self, codes, back, piece) -> tuple[np.ndarray, np.ndarray]:
        """Follow the backpointers of all words at once."""
        n, size = codes.shape
        out = np.full((n, size), -1, np.int64)
        at, k = np.full(n, size), size
        while (at > 0).any():
            k -= 1
            live = np.flatnonzero(at > 0)
            e = at[live]
            x = piece[e, live].astype(np.int64)
            out[live, k] = np.where(x >= 0, x, -2 - codes[live, e - 1].astype(np.int64))
            at[live] = e - back[e, live]
        used = out != -1
        ids, n_ids = out[used], used.sum(1)
        if len(ids) and ids.min() < 0:
            ids, n_ids = self._spell(ids, n_ids)
        return ids.astype(np.int32), n_ids.astype(np.int64)

    def _spell(self, ids, n_ids) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters (-2 - code point) become bytes or one unknown piece a run."""
        out, sizes, at = [], [], 0
        for n in n_ids.tolist():
            before = len(out)
            for x in ids[at:at + n].tolist():
                if x >= 0:
                    out.append(x)
                elif self.m.byte_ids is not None:
                    out += self.m.byte_ids[list(chr(-2 - x).encode())].tolist()
                elif len(out) == before or out[-1] != self.m.unknown:
                    out.append(self.m.unknown)
            sizes.append(len(out) - before)
            at += n
        return np.array(out, np.int64), np.array(sizes, np.int64)


def encode(docs: DataFrame, model: str | None = None, text: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` with ids (array of int), n_tokens and, if asked, decoded (the text that these ids stand for,
    made in the same task)."""
    spark = docs.sparkSession
    names = ["ids", "n_tokens", *(["decoded"] if decoded else [])]
    base = docs.drop(*names)
    shared = spark.sparkContext.broadcast(Pieces.load(model or default_model()))

    def run(batches):
        coder = Encoder(shared.value)
        back = Decoder(shared.value) if decoded else None
        for whole in batches:
            for batch in text_pieces(whole, text, TEXT_BYTES):
                ids, n = coder.batch(batch.column(text))
                at = np.append(0, np.cumsum(n)).astype(np.int32)
                more = [pa.ListArray.from_arrays(at, pa.array(ids, pa.int32())), pa.array(n, pa.int64())]
                if back is not None:
                    more.append(back.batch(ids, n))
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(run, f"{schema}, ids array<int>, n_tokens bigint" + ", decoded string" * decoded)


def decode(docs: DataFrame, model: str | None = None, ids: str = "ids") -> DataFrame:
    """``docs`` with decoded, the text that the ids stand for."""
    base = docs.drop("decoded")
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(model or default_model()))

    def run(batches):
        back = Decoder(shared.value)
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                column = batch.column(ids)
                n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, back.batch(flat, n.astype(np.int64))],
                                                 names=[*batch.schema.names, "decoded"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(run, f"{schema}, decoded string")
