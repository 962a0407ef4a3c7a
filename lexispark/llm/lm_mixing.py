r"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its words ([^\x20\x09-\x0D]+, A-Z lower-cased) and one end token.  The model codes it
bit by bit and gives its probability:

* an escape bit says whether the token occurs in the training texts;
* a known token is coded by the BITS bits of its hash and then, among the known tokens with the
  same bits, by its count;
* an unknown token is spelled: eight bits a byte and a closing blank.

``score`` has the outcomes of the base model, where all unknown tokens are one outcome: it ends
with the escape bit there.  ``spelled_score`` adds the spelling, which makes it the probability of
the text itself, and ``bits_per_byte`` is its total in bits.

Each bit of either code is predicted by several tables of bit counts, one for each kind of context
(none, the word before, the two words before, the endings of the two words before; for spelling
one, two and three bytes before), addressed by a hash of context and bits coded so far.  Their
log-odds are combined by weights that are gated by bit number and by which contexts are known, and
the mixed probability is refined by an adaptive map from (bit number, quantised log-odds) to
observed frequency.

Learning is online: each task streams its training texts, predicts every small run of tokens
before it updates its counts, weights and map with them.  Weights of all tasks are averaged (by
tokens seen), maps and counts added.  While it learns, a task counts in the contexts of a block,
each node in a place of its own.

The counts that score are those of all training texts.  A block's distinct (context, code) pairs
are sorted 64-bit keys: 44 bits of the context's hash, then the code, so the counters of a node are
the counts of a range of keys.  Keys are dealt into parts by range, about PART_BYTES of text each;
a part adds the counts of all blocks and answers every block's keys with the log-odds along their
codes (in steps of 1/ODDS_STEP), those of a node once.  A block sends FAN rows at most: beyond FAN parts, the keys of about FAN blocks
are first merged (their counts added) and only then dealt further, level by level, and the answers come
back the same way; so rows grow with the text times the number of levels, and a context that
occurs everywhere reaches its part once from each merged group.  This table grows with the training texts, no two contexts share a
counter (but for equal 44 bits), and no task or driver holds more than a part of it.  Of the word
model, only the 2^BITS counts without context, the weights and the map are broadcast; the spelling
model has 2^SLOT_BITS slots a context, a few MB at any size.

Texts are cut into blocks of about BLOCK_BYTES, and into words once: a block is one file in the shared folder
(its words, and its tokens as their places) that each pass reads.  Words and their training counts go to parts
by hash and come back as counts, in cells of many words and over the same levels as the keys, so no task
holds all words.  A block is scored by the task that its answers reach.

Defined cases: null and empty texts are the end token alone; a null doc_id is not held out and
is learned from; rows with equal ids are learned from and scored one by one; without training
texts every count is 0 and all tokens are unknown; extra columns do not matter; an empty table
gives an empty table.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import (
    Numbers, byte_hashes, crc_fold, mix64, open_out, settle, shared_folder, word_numbers, worker_memo, write_once,
)

_U = np.uint64
BITS = 12                  # bits of a known token's code
CONTEXT_BITS = 44          # bits of a context's hash in its keys
SLOT_BITS = 18             # slots of a hashed context's table of the spelling model: 2^SLOT_BITS
RUN = 16_384               # codes predicted before the model learns from them
REFRESH = 200_000          # codes learnt between two computations of a table's log-odds
BLOCK_BYTES = 8 << 20      # text in a block
PART_BYTES = 8 << 20       # text whose contexts make a part of the word model's table
FAN = 256                  # parts that a block, or a group of merged blocks, is dealt over
ODDS_STEP = 10             # log-odds of that table are whole multiples of 1 / ODDS_STEP
LEARN_BYTES = 64 << 20     # text that a task learns from, at least
MAP_BINS = 33              # quantised log-odds of the adaptive map
RATE = 0.05
END = ""                   # the end token; no word is empty
LOG2_10 = math.log2(10.0)


@dataclass
class Mixer:
    """Bit predictors with hashed contexts, gated mixing and an adaptive map.

    Context 0 is empty and has a slot for every node of the code tree; ``contexts`` - 1 hashed
    ones follow."""
    bits: int
    contexts: int
    slot_bits: int = SLOT_BITS
    n: np.ndarray = field(default=None)          # slot x (count of 0, count of 1)
    weight: np.ndarray = field(default=None)     # context x gate
    seen: np.ndarray = field(default=None)       # adaptive map: counts of 0 and 1
    codes: float = 0.0

    def __post_init__(self):
        self.base = (1 << self.bits) + (1 << self.slot_bits) * np.arange(self.contexts - 1)
        self.size = int((1 << self.bits) + (self.contexts - 1) * (1 << self.slot_bits))
        if self.n is None:
            self.n = np.zeros((self.size, 2), np.int64)
            self.weight = np.full((self.contexts, self.gates), 1.0 / self.contexts, np.float32)
            self.seen = np.zeros((2, self.bits * MAP_BINS), np.float64)
        self.square = np.full_like(self.weight, 1e-3)
        self.shift = np.arange(self.bits, dtype=np.int32)
        self._refresh()

    @property
    def gates(self) -> int:
        return self.bits * (1 << (self.contexts - 1))

    def _refresh(self):
        """Log-odds of every slot; 0 where nothing was seen."""
        n = self.n.astype(np.float32)
        self.odds = np.log((n[:, 1] + np.float32(0.4)) / (n[:, 0] + np.float32(0.4)))
        held = self.seen.sum(0)
        # the map starts at the identity, which weighs like 50 observations
        centre = (np.arange(MAP_BINS) - MAP_BINS // 2) / 2.0
        ident = np.tile(1.0 / (1.0 + np.exp(-centre)), self.bits)
        self.refined = ((self.seen[1] + 50 * ident) / (held + 50)).astype(np.float32)

    def _address(self, codes: np.ndarray, contexts: list[np.ndarray]):
        """Slots (code x bit) of each context, and the bits themselves."""
        codes = codes.astype(np.int32)
        node = (1 << self.shift) | (codes[:, None] >> (self.bits - self.shift))
        bit = (codes[:, None] >> (self.bits - 1 - self.shift)) & 1
        spread = node.astype(np.uint32) * np.uint32(0x9E3779B1)
        slots = [node]
        for base, c in zip(self.base, contexts):
            h = (c[:, None] ^ spread) * np.uint32(0x85EBCA77)
            slots.append((h >> np.uint32(32 - self.slot_bits)).astype(np.intp) + base)
        return slots, bit

    def _mix(self, x):
        """Gate and mixed log-odds of a 1, given the inputs (log-odds)."""
        gate = np.zeros(x[0].shape, np.int32)
        gate += self.shift
        for k, v in enumerate(x[1:]):
            gate += (v != 0) * np.int32(self.bits << k)
        z = self.weight[0].take(gate)
        z *= x[0]
        for k in range(1, self.contexts):
            w = self.weight[k].take(gate)
            w *= x[k]
            z += w
        return gate, np.clip(z, -12, 12, out=z)

    def _adapt(self, x, bit) -> None:
        """Predict the bits, then move weights and map."""
        gate, z = self._mix(x)
        error = bit.astype(np.float32) - np.float32(1) / (1 + np.exp(-z))
        g = gate.reshape(-1)
        times = np.maximum(np.bincount(g, minlength=self.gates), 1)
        for c, v in enumerate(x):
            step = np.bincount(g, (error * v).reshape(-1), self.gates) / times
            self.square[c] += step * step
            self.weight[c] += RATE * step / np.sqrt(self.square[c])
        where = np.bincount((2 * self._bin(z) + bit).reshape(-1), minlength=2 * self.seen.shape[1])
        self.seen += where.reshape(-1, 2).T
        self.codes += len(bit)

    def _cost(self, x, bit) -> np.ndarray:
        """log2 of the probability of each row of bits."""
        _, z = self._mix(x)
        p = 0.5 / (1.0 + np.exp(-z)) + 0.5 * self.refined.take(self._bin(z))
        return np.log2(np.where(bit == 1, p, 1.0 - p).astype(np.float64)).sum(1)

    def _bin(self, z):
        return (np.rint(np.clip(z, -8, 8) * 2).astype(np.int32) + (
            MAP_BINS // 2 + self.shift * MAP_BINS))

    def learn(self, codes: np.ndarray, contexts: list[np.ndarray]) -> None:
        for a in range(0, len(codes), RUN):
            part = slice(a, a + RUN)
            slots, bit = self._address(codes[part], [c[part] for c in contexts])
            self._adapt([self.odds.take(t) for t in slots], bit)
            for s in slots:
                _count(self.n, s, bit)
            self.since = getattr(self, "since", 0) + len(codes[part])
            if self.since >= REFRESH or self.codes <= REFRESH:
                self.since = 0
                self._refresh()

    def log2(self, codes: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
        """log2 of the probability of each code."""
        out = np.empty(len(codes))
        for a in range(0, len(codes), RUN):
            part = slice(a, a + RUN)
            slots, bit = self._address(codes[part], [c[part] for c in contexts])
            out[part] = self._cost([self.odds.take(t) for t in slots], bit)
        return out

    # A model leaves a task as rows (table, place, a, b) that add up.
    def rows(self, name: int):
        at = np.flatnonzero(self.n.any(1))
        yield name, at, self.n[at, 0], self.n[at, 1]
        at = np.arange(self.weight.size)
        yield name + 1, at, self.weight.reshape(-1) * self.codes, np.full(len(at), self.codes)
        at = np.flatnonzero(self.seen.any(0))
        yield name + 2, at, self.seen[0][at], self.seen[1][at]

    def load(self, name: int, kind, place, a, b) -> Mixer:
        m = kind == name
        self.n[place[m], 0], self.n[place[m], 1] = a[m], b[m]
        m = kind == name + 2
        self.seen[0, place[m]], self.seen[1, place[m]] = a[m], b[m]
        m = (kind == name + 1) & (b > 0)
        flat = self.weight.reshape(-1)
        flat[place[m]] = a[m] / b[m]
        self._refresh()
        return self


class WordMixer(Mixer):
    """A mixer whose contexts but the empty one have their counters elsewhere: in a block while it
    learns, in the table of all training texts when it scores.  ``n`` is of the empty context."""

    def __post_init__(self):
        if self.n is None:
            self.n = np.zeros((1 << self.bits, 2), np.int64)
            self.weight = np.full((self.contexts, self.gates), 1.0 / self.contexts, np.float32)
            self.seen = np.zeros((2, self.bits * MAP_BINS), np.float64)
        self.size = 1 << self.bits
        self.base = []
        self.square = np.full_like(self.weight, 1e-3)
        self.shift = np.arange(self.bits, dtype=np.int32)
        self._refresh()

    def _places(self, keys: np.ndarray, first: int):
        """(place of each node of each distinct key, distinct key of each token, next free place).
        A node that is met once only tells nothing in the block and shares place 0, which stays 0."""
        distinct, at, count = np.unique(keys, return_inverse=True, return_counts=True)
        place = np.empty((len(distinct), self.bits), np.int32)
        new, before = _first_new(distinct, self.bits), np.append(0, np.cumsum(count))
        for d in range(self.bits):
            start = np.flatnonzero(new <= d)
            often = np.diff(before[start], append=before[-1]) > 1
            node = np.cumsum(often, dtype=np.int32)
            node += np.int32(first - 1)
            node *= often
            place[:, d] = np.repeat(node, np.diff(start, append=len(distinct)))
            first += int(often.sum())
        return place, at, first

    def learn_block(self, codes: np.ndarray, keys: list[np.ndarray]) -> None:
        """Learn from a block's training tokens, given their codes and the keys of each context."""
        if not len(codes):
            return
        held, end = [], 1
        for k in keys:
            place, at, end = self._places(k, end)
            held.append((place, at))
        n = np.zeros((end, 2), np.int32)
        both = n.view(np.int64).reshape(-1)          # a node's two counts are read at once
        for a in range(0, len(codes), RUN):
            part = slice(a, a + RUN)
            (node,), bit = self._address(codes[part], [])
            slots = [place[at[part]] for place, at in held]
            x = [self.odds.take(node)]
            for t in slots:
                c = both.take(t).view(np.int32).reshape(*t.shape, 2)
                x.append(_odds(c[..., 0], c[..., 1]))
            self._adapt(x, bit)
            _count(self.n, node, bit)
            for t in slots:
                _count(n, t, bit)
            n[0] = 0
            self._refresh()

    def log2_of(self, codes: np.ndarray, rows: list[np.ndarray], answers: np.ndarray) -> np.ndarray:
        """log2 of the probability of each code, given the rows of its contexts in the answers."""
        out = np.empty(len(codes))
        for a in range(0, len(codes), RUN):
            part = slice(a, a + RUN)
            (node,), bit = self._address(codes[part], [])
            out[part] = self._cost([self.odds.take(node), *[
                answers[r[part]].astype(np.float32) / np.float32(ODDS_STEP) for r in rows]], bit)
        return out


def _odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones.astype(np.float32) + np.float32(0.4)) / (zeros.astype(np.float32) + np.float32(0.4)))


def _count(n: np.ndarray, slots: np.ndarray, bit: np.ndarray) -> None:
    """Add the bits met in slots to the counts of each slot.  Values of the counts' own type keep ``add.at`` fast."""
    at = (2 * slots + bit).reshape(-1)
    np.add.at(n.reshape(-1), at, np.ones(len(at), n.dtype))


def _first_new(keys: np.ndarray, bits: int) -> np.ndarray:
    """Depth of the first node (from 0, ``bits`` if none) of each sorted distinct key that the key before it has not."""
    out = np.zeros(len(keys), np.int8)
    if len(keys):
        # with x != 0 the topmost differing bit decides; no node is shared beyond the code
        depth = np.zeros((1 << bits) + 1, np.int8)
        for d in range(bits):
            depth[1 << (bits - 1 - d):1 << (bits - d)] = d + 1
        x = np.minimum(keys[1:] ^ keys[:-1], _U(1 << bits)).astype(np.int32)
        out[1:] = depth.take(x)
    return out


def path_odds(keys: np.ndarray, count: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Log-odds (key x bit, in steps) along the codes of sorted distinct keys with their counts."""
    out = np.empty((bits, len(keys)), np.int8)
    count, code = count.astype(np.float64), (keys & _U((1 << bits) - 1)).astype(np.int16)
    new = _first_new(keys, bits)
    for d in range(bits):
        start = np.flatnonzero(new <= d)
        ones = count * ((code >> (bits - 1 - d)) & 1)
        both, ones = np.add.reduceat(count, start), np.add.reduceat(ones, start)
        steps = np.rint(np.clip(_odds(both - ones, ones) * ODDS_STEP, -127, 127)).astype(np.int8)
        out[d] = np.repeat(steps, np.diff(start, append=len(keys)))
    return out.T


def word_mixer() -> WordMixer:
    return WordMixer(BITS, 4)


def byte_mixer() -> Mixer:
    return Mixer(8, 4)


WORDS, LETTERS = 0, 3     # table numbers of the two mixers


class Words:
    """Distinct words of a block and what their contexts are made of."""

    def __init__(self, names: list[str]):
        self.names = names
        self.hash = byte_hashes(names)
        self.tail = byte_hashes([w[-2:] for w in names])


def tokens_of(text, number: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all tokens, number of tokens of each text) of an Arrow array; the end has number 0."""
    words, size = word_numbers(text, number)
    n = size + 1
    out = np.zeros(len(words) + len(size), np.int64)
    stop = np.zeros(len(out), bool)
    stop[np.cumsum(n) - 1] = True
    out[~stop] = words
    return out, n


def code_of(h: np.ndarray) -> np.ndarray:
    return (mix64(h) >> _U(64 - BITS)).astype(np.int64)


def word_keys(words: Words, tokens: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Keys of every token, by context: the word before, the two words before, and the endings of
    the two before."""
    start = np.cumsum(n) - n

    def before(x):
        y = np.empty_like(x)
        y[1:], y[:1] = x[:-1], 0
        y[start] = 1
        return y
    one, tail = before(words.hash[tokens]), before(words.tail[tokens])
    code = code_of(words.hash)[tokens].astype(_U)
    out = []
    for k, x in enumerate((one, one * _U(0x9E3779B97F4A7C15) + before(one),
                           tail * _U(0x9E3779B97F4A7C15) + before(tail))):
        out.append(mix64(x + _U((k + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
                   >> _U(64 - CONTEXT_BITS) << _U(64 - CONTEXT_BITS) | code)
    return out


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Part of each key; it does not fall where the key grows."""
    return ((keys >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)


def _packed(raw: bytes) -> bytes:
    """Compressed bytes behind their size."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(raw) -> bytes:
    raw = memoryview(raw)
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def _planes(a: np.ndarray) -> bytes:
    """The bytes of an array by significance, which compress better."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _from_planes(raw, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size).T).view(kind).reshape(-1)


def _pack(a: np.ndarray) -> bytes:
    """Compressed numbers; of those of eight bytes, small and large ones apart."""
    if a.itemsize < 8:
        return _packed(_planes(a))
    a = a.view(_U)
    large = a >= _U(1 << BITS)
    return _packed(b"".join([len(a).to_bytes(8, "little"), np.packbits(large).tobytes(),
                             _planes(a[~large].astype("u2")), _planes(a[large])]))


def _unpack(raw, kind) -> np.ndarray:
    raw = memoryview(_unpacked(raw))
    if np.dtype(kind).itemsize < 8:
        return _from_planes(raw, kind)
    n = int.from_bytes(raw[:8], "little")
    flags = 8 + -(-n // 8)
    large = np.unpackbits(np.frombuffer(raw[8:flags], np.uint8), count=n).astype(bool)
    middle = flags + 2 * int(np.count_nonzero(~large))
    out = np.empty(n, _U)
    out[~large], out[large] = _from_planes(raw[flags:middle], "u2"), _from_planes(raw[middle:], "u8")
    return out.view(kind)


def _signs(keys: np.ndarray) -> list[np.ndarray]:
    """For each bit of the codes of keys, 1 where it is 1 and -1 where it is 0."""
    code = (keys & _U((1 << BITS) - 1)).astype(np.int16)
    return [(((code >> (BITS - 1 - d)) & 1) * 2 - 1).astype(np.int8) for d in range(BITS)]


def _odds_cell(odds: np.ndarray, keys: np.ndarray, small: bool) -> bytes:
    """Log-odds (bit x key).  Small: who has the keys knows which nodes a key shares with the one before it, so
    only those of new nodes are told, as log-odds of the key's own bits, up to where they change no more."""
    if not small:
        return np.ascontiguousarray(odds).tobytes()
    first = _first_new(keys, BITS)
    own = [x * s for x, s in zip(odds, _signs(keys))]
    last = first.copy()
    for d in range(1, BITS):
        last[(own[d] != own[d - 1]) & (first < d)] = d
    told, by_first = [], np.argsort(first, kind="stable")
    for d, rows in _told(first, last):
        told.append(own[d][rows].tobytes())
    return _packed(b"".join([len(keys).to_bytes(8, "little"), (last - first)[by_first].tobytes(), *told]))


def _told(first: np.ndarray, last: np.ndarray):
    """The keys of which a bit's log-odds are told, bit by bit; keys alike in their first and last are together."""
    order = np.argsort(first.astype(np.int16) * (BITS + 1) + last, kind="stable")
    first, last = first[order], last[order]
    for d in range(BITS):
        yield d, order[(first <= d) & (last >= d)]


def _odds_of(cells, keys: np.ndarray) -> np.ndarray:
    """The log-odds (key x bit) in small cells that together are about these keys."""
    out, done = np.empty((len(keys), BITS), np.int8), 0
    for cell in cells:
        raw = _unpacked(cell.as_buffer())
        n = int.from_bytes(raw[:8], "little")
        mine, told = keys[done:done + n], np.frombuffer(raw, np.int8, offset=8)
        if len(mine) != n:
            break
        first = _first_new(mine, BITS)
        last, told = first.copy(), told[n:]
        last[np.argsort(first, kind="stable")] += np.frombuffer(raw, np.int8, n, 8)
        own, row, signs = np.zeros(n, np.int8), np.arange(n), _signs(mine)
        for d, here in _told(first, last):
            sign, known = signs[d], first <= d
            own[here], told = told[:len(here)], told[len(here):]
            # a node that is not new has the log-odds it has for the key before
            x = own * sign
            out[done:done + n, d] = x.take(np.maximum.accumulate(np.where(known, row, 0)))
        done += n
    if done != len(keys):
        raise ValueError("the contexts of a block are not those that were counted")
    return out


def spelled(words: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Byte codes with a closing blank, their contexts, and the number of the word of each."""
    raw = [w.encode() for w in words]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    word = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    context, out = np.zeros(len(data), _U), []
    for k in range(1, 4):
        back = np.zeros(len(data), np.int64)
        back[k:] = data[:-k]
        context = mix64(context + np.where(at >= k, back + 1, 0).astype(_U) + _U(k << 9))
        out.append((context >> _U(32)).astype(np.uint32))
    return data, out, word


def _blocked(block_bytes: int, folder: str):
    """A row for each block, a run of about block_bytes of text of a partition: its number, file and bytes of text.
    The block is a file in the folder that all tasks share, as whoever works on it reads it whole: its rows (id,
    fold, tokens and bytes of each text) as a compressed Arrow stream, its distinct words, most frequent first,
    and the places of its tokens among them."""
    def run(batches):
        from pyspark import TaskContext
        block, held, parts = TaskContext.get().partitionId() << 24, 0, []

        def row():
            number, tokens, sizes = Numbers(), [], []
            number[END]                      # number 0
            for part in parts:
                text = part.column("text")
                for i in range(0, len(text), 1024):
                    ids, n = tokens_of(text.slice(i, 1024), number)
                    tokens.append(ids.astype(np.uint32))
                    sizes.append(n)
            rows = pa.table({
                "doc_id": pa.chunked_array([x.column("doc_id") for x in parts]),
                "held_out": pa.chunked_array([x.column("held_out") for x in parts]),
                "n_tokens": np.concatenate(sizes),
                "n_bytes": pa.chunked_array([
                    pc.fill_null(pc.binary_length(x.column("text")), 0).cast(pa.int64()) for x in parts])})
            with (out := pa.BufferOutputStream()), pa.ipc.new_stream(
                    out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(rows.combine_chunks())
            tokens, names = np.concatenate(tokens), list(number)
            order = np.argsort(-np.bincount(tokens, minlength=len(names)), kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order))
            cells = out.getvalue().to_pybytes(), _pack_names([names[i] for i in order.tolist()]), _pack(place[tokens])
            uri = f"{folder}/{block}"
            write_once(uri, [x for cell in cells for x in (len(cell).to_bytes(8, "little"), cell)])
            return pa.RecordBatch.from_pydict({"block": [block], "uri": [uri], "n_bytes": [held]})
        for batch in batches:
            first = 0
            for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()):
                if held and held + n > block_bytes:
                    parts.append(batch.slice(first, i - first))
                    yield row()
                    block, held, parts, first = block + 1, 0, [], i
                held += n
            if batch.num_rows > first:
                parts.append(batch.slice(first))
        if parts:
            yield row()
    return run


def _pack_names(names: list[str]) -> bytes:
    """Words, one or more, as bytes; no word holds a line feed."""
    return _packed("\n".join(names).encode())


def _names(raw) -> list[str]:
    return _unpacked(raw).decode().split("\n")


def _block(uri: str) -> tuple[pa.Table, Words, np.ndarray]:
    """doc_id, held_out, n_tokens, n_bytes of a block's texts, its words, and the word of every token."""
    files, path = open_out(uri)
    with files.open_input_stream(path, compression=None) as f:
        rows, names, tokens = (f.read(int.from_bytes(f.read(8), "little")) for _ in range(3))
    return pa.ipc.open_stream(rows).read_all().combine_chunks(), Words(_names(names)), _unpack(tokens, "u4")


CELL_SQL = "block bigint, place bigint, keys binary, n binary"
MODEL_SQL = "kind int, place bigint, a double, b double"


def _model_rows(mixer: Mixer, name: int):
    for kind, at, a, b in mixer.rows(name):
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(at), kind, "i4")), pa.array(at.astype(np.int64)), pa.array(np.asarray(a, np.float64)),
            pa.array(np.asarray(b, np.float64))], names=["kind", "place", "a", "b"])


def _cuts(part: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal parts."""
    at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return list(zip(at, at[1:]))


def _key_cells(block: int, keys: np.ndarray, count: np.ndarray, parts: int) -> dict:
    """Sorted distinct keys with their counts, dealt over parts."""
    part = part_of(keys, parts)
    cuts, count = _cuts(part), np.minimum(count, 2 ** 32 - 1).astype(np.uint32)
    return {"block": np.full(len(cuts), block, np.int64), "place": part[[a for a, _ in cuts]],
            "keys": pa.array([_pack(np.diff(keys[a:b], prepend=_U(0))) for a, b in cuts], pa.binary()),
            "n": pa.array([_pack(count[a:b]) for a, b in cuts], pa.binary())}


def _dealt_words(names: list[str], hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the words by part and name, parts in that order)."""
    order = pc.array_sort_indices(pa.array(names, pa.string())).to_numpy()
    part = part_of(hashes, parts)[order]
    by_part = np.argsort(part, kind="stable")
    return order[by_part], part[by_part]


def _word_cells(block: int, names: list[str], hashes: np.ndarray, count: np.ndarray, parts: int) -> dict:
    """Words with their counts, dealt over parts by hash."""
    order, part = _dealt_words(names, hashes, parts)
    cuts, names, count = _cuts(part), [names[i] for i in order.tolist()], count[order].astype(np.uint64)
    return {"block": np.full(len(cuts), block, np.int64), "place": part[[a for a, _ in cuts]],
            "keys": pa.array([_pack_names(names[a:b]) for a, b in cuts], pa.binary()),
            "n": pa.array([_pack(count[a:b]) for a, b in cuts], pa.binary())}


def _learn_words(parts: int):
    """The three passes over the blocks: the words of each block and part with their training counts, the rows of a
    task's model, and the keys of each block and part with their training counts."""
    def read(batches):
        for batch in batches:
            for block, uri in zip(batch.column("block").to_pylist(), batch.column("uri").to_pylist()):
                rows, words, tokens = _block(uri)
                n = rows.column("n_tokens").to_numpy()
                train = ~rows.column("held_out").to_numpy()
                yield block, words, tokens, n, np.repeat(train, n)

    def worded(batches):
        for block, words, tokens, _, keep in read(batches):
            counts = np.bincount(tokens[keep], minlength=len(words.names))
            yield pa.RecordBatch.from_pydict(_word_cells(block, words.names, words.hash, counts, parts))

    def learn(batches):
        mixer, any_block = word_mixer(), False
        for _, words, tokens, n, keep in read(batches):
            any_block = True
            keys = word_keys(words, tokens, n)
            mixer.learn_block(code_of(words.hash)[tokens[keep]], [k[keep] for k in keys])
        if any_block:
            yield from _model_rows(mixer, WORDS)

    def keyed(batches):
        for block, words, tokens, n, keep in read(batches):
            keys = word_keys(words, tokens, n)
            keys, at = np.unique(np.concatenate(keys), return_inverse=True)
            count = np.bincount(at[np.tile(keep, len(at) // len(keep))], minlength=len(keys))
            yield pa.RecordBatch.from_pydict(_key_cells(block, keys, count, parts))
    return worded, learn, keyed


ANSWER_SQL = "block bigint, place bigint, odds binary"


def _answer_part(small: bool):
    """The log-odds that all training texts give the keys of each block in a part."""
    def run(rows: pa.Table) -> pa.Table:
        every, count, keys = _summed(rows)
        return _answers(rows, keys, every, path_odds(every, count).T, small)
    return run


def _answers(rows: pa.Table, keys: list[np.ndarray], every: np.ndarray, odds: np.ndarray, small: bool) -> pa.Table:
    """The log-odds (bit x key) of all keys, told to each row's."""
    def cell(k):
        at = np.searchsorted(every, k)
        return _odds_cell(odds[:, at], k, small)
    return pa.table({"block": rows.column("block"), "place": rows.column("place"),
                     "odds": pa.array([cell(k) for k in keys], pa.binary())})


def _summed(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct keys, their counts, keys of each row) of the keys of several blocks."""
    keys = [np.cumsum(_unpack(x.as_buffer(), "u8"), dtype=_U) for x in rows.column("keys")]
    count = np.concatenate([_unpack(x.as_buffer(), "u4") for x in rows.column("n")])
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    return every, np.bincount(at, count, len(every)), keys


def _merge(parts: int):
    """The keys of a group of blocks in one place, merged and dealt over finer places."""
    def run(key, rows):
        keys, count, _ = _summed(rows)
        return pa.table(_key_cells(key[0].as_py(), keys, count, parts))
    return run


def _give_back(small: bool):
    """The answers to merged keys, handed to the blocks that the keys came from."""
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        every, _, keys = _summed(rows)
        odds = _odds_of(answers.sort_by("fine").column("odds"), every)
        return _answers(rows, keys, every, odds.T, small)
    return run


def answered(keyed: DataFrame, places: int, parts: int, n_blocks: int, fan: int, small: bool = False) -> DataFrame:
    """block, place, odds for the keys (block, place, keys, n) of each block in ``places`` ranges, by the
    counts of all blocks in ``parts`` ranges; odds as int8 by bit and key, or in small cells (``_odds_of``)."""
    if places >= parts:
        return keyed.groupBy("place").applyInArrow(_answer_part(small), ANSWER_SQL)
    rows, merged, finer, groups = _level(keyed, places, parts, n_blocks, fan, _merge)
    got = answered(merged, places * finer, parts, groups, fan, True)
    return rows.groupBy("up", "place").cogroup(_coarser(got, finer).groupBy("up", "place")).applyInArrow(
        _give_back(small), ANSWER_SQL)


def _level(cells: DataFrame, places: int, parts: int, n_blocks: int, fan: int, merge):
    """(cells with the number of their group of blocks, merged cells, finer places a place, groups)."""
    groups, finer = -(-n_blocks // fan), min(fan, -(-parts // places))
    rows = cells.withColumn("up", F.pmod(F.xxhash64("block"), F.lit(groups)))
    merged = settle(rows.groupBy("up", "place").applyInArrow(merge(places * finer), CELL_SQL), "merged", "zstd")
    return rows, merged, finer, groups


def _coarser(got: DataFrame, finer: int) -> DataFrame:
    return got.select(F.col("block").alias("up"), F.floor(F.col("place") / finer).cast("bigint").alias("place"),
                      F.col("place").alias("fine"), "odds")


COUNTED_SQL = f"{ANSWER_SQL}, names binary, total bigint, distinct bigint, single bigint"


def _summed_words(rows: pa.Table) -> tuple[list[str], np.ndarray, list[np.ndarray]]:
    """(distinct words, their counts, numbers of the words of each row) of the words of several blocks."""
    number = Numbers()
    at = [np.fromiter((number[w] for w in _names(x.as_buffer())), np.int64) for x in rows.column("keys")]
    count = [_unpack(x.as_buffer(), "u8").astype(np.int64) for x in rows.column("n")]
    total = np.zeros(len(number), np.int64)
    for i, c in zip(at, count):
        total[i] += c                        # a row holds a word once
    return list(number), total, at


def _count_part(rows: pa.Table) -> pa.Table:
    """The training counts of the words of each block in a part, and a row without a block of the part's own."""
    names, count, at = _summed_words(rows)
    met = np.flatnonzero(count)
    own = [_pack_names(sorted(names[i] for i in met.tolist()))] if len(met) else []
    cells, k = rows.num_rows, len(own)
    return pa.table({
        "block": pa.concat_arrays([rows.column("block").combine_chunks(), pa.nulls(k, pa.int64())]),
        "place": pa.concat_arrays([rows.column("place").combine_chunks(), pa.nulls(k, pa.int64())]),
        "odds": pa.array([_pack(count[i]) for i in at] + [None] * k, pa.binary()),
        "names": pa.array([None] * cells + own, pa.binary()),
        **{name: pa.array([None] * cells + [int(v)] * k, pa.int64()) for name, v in (
            ("total", count.sum()), ("distinct", len(met)), ("single", (count == 1).sum()))}})


def _merge_words(parts: int):
    def run(key, rows):
        names, count, _ = _summed_words(rows)
        return pa.table(_word_cells(key[0].as_py(), names, byte_hashes(names), count, parts))
    return run


def _give_back_words(parts: int):
    """The counts of merged words, handed to the blocks that the words came from."""
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        names, _, at = _summed_words(rows)
        order, _ = _dealt_words(names, byte_hashes(names), parts)
        count = np.empty(len(names), np.int64)
        count[order] = _counts_of(answers.sort_by("fine").column("odds"))
        return pa.table({"block": rows.column("block"), "place": rows.column("place"),
                         "odds": pa.array([_pack(count[i]) for i in at], pa.binary())})
    return run


def _counts_of(cells) -> np.ndarray:
    return np.concatenate([_unpack(x.as_buffer(), "i8") for x in cells])


def counted(cells: DataFrame, places: int, parts: int, n_blocks: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """The training counts of the words of each block, dealt and merged as the keys are in ``answered``, and for
    each part its distinct words (those that occur), their number, their tokens and how many occur once."""
    if places >= parts:
        got = settle(cells.groupBy("place").applyInArrow(_count_part, COUNTED_SQL), "counts", "zstd")
        return (got.filter("block is not null").select("block", "place", "odds"),
                got.filter("block is null").select("names", "total", "distinct", "single"))
    rows, merged, finer, groups = _level(cells, places, parts, n_blocks, fan, _merge_words)
    got, found = counted(merged, places * finer, parts, groups, fan)
    return rows.groupBy("up", "place").cogroup(_coarser(got, finer).groupBy("up", "place")).applyInArrow(
        _give_back_words(places * finer), ANSWER_SQL), found


def _learn_letters(batches):
    mixer = byte_mixer()
    for batch in batches:
        for cell in batch.column("names"):
            words = [w for w in _names(cell.as_buffer()) if w]
            # not by name: a run of alike words would teach the weights too much of itself
            words = [words[i] for i in np.argsort(byte_hashes(words)).tolist()]
            for a in range(0, len(words), 4096):
                data, context, _ = spelled(words[a:a + 4096])
                mixer.learn(data, context)
    if mixer.codes:
        yield from _model_rows(mixer, LETTERS)


@dataclass
class Scores:
    """What every scoring task needs; its size does not depend on the corpus."""
    rows: dict[str, np.ndarray]
    total: int       # training tokens
    distinct: int    # distinct training tokens
    single: int      # of these, seen once

    def mixers(self) -> tuple[Mixer, Mixer]:
        r = self.rows
        args = r["kind"], r["place"], r["a"], r["b"]
        return word_mixer().load(WORDS, *args), byte_mixer().load(LETTERS, *args)


def _score_blocks(shared, places: int, folder: str):
    key = uuid.uuid4().hex

    def run(told: pa.Table) -> pa.Table:
        s = Scores(*shared.value)
        held = worker_memo("mixers", dict)       # of one model at a time
        if held.get("key") != key:
            held.clear()
            held.update(key=key, made=s.mixers())
        mixer, letters = held["made"]
        # tokens with the same bits as a code: the count at the last bit of the empty context
        leaf = np.arange(1 << BITS)
        bucket = mixer.n[(1 << (BITS - 1)) | (leaf >> 1), leaf & 1].astype(np.float64)
        told = told.sort_by("place")
        parts, known = (told.column(x).drop_null() for x in ("odds", "c"))
        docs, words, tokens = _block(f"{folder}/{told.column('block')[0].as_py()}")
        n_tokens, out = docs.column("n_tokens").to_numpy(), []
        escape = math.log10((s.single + 0.5) / (s.total + 1.0))
        stay = math.log10(1.0 - (s.single + 0.5) / (s.total + 1.0))
        # the block's distinct keys, in the order in which the parts answer them
        keys = word_keys(words, tokens, n_tokens)
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        answers = _odds_of(parts, distinct)
        rows = at.astype(np.int32).reshape(len(keys), -1)
        del keys, distinct, at
        new = words.names
        c = np.zeros(len(new))
        c[_dealt_words(new, words.hash, places)[0]] = _counts_of(known)
        code = code_of(words.hash)
        # known: share of the tokens with its bits; unknown: its spelling
        cost, spell = np.full(len(new), escape), np.zeros(len(new))
        k = c > 0
        cost[k] = stay + np.log10(c[k] / np.maximum(bucket[code[k]], c[k]))
        odd = np.flatnonzero(~k)
        for a in range(0, len(odd), 4096):
            data, context, word = spelled([new[j] for j in odd[a:a + 4096]])
            bits = np.bincount(word, letters.log2(data, context), len(odd[a:a + 4096]))
            spell[odd[a:a + 4096]] = bits / LOG2_10
        base = np.log10((c + 0.5) / (s.total + 0.5 * (s.distinct + 1)))
        done = 0
        for i in range(0, len(n_tokens), 1024):
            n = n_tokens[i:i + 1024]
            part = slice(done, done + int(n.sum()))
            ids, here, done = tokens[part], rows[:, part], part.stop
            value = cost[ids]
            k = c[ids] > 0
            value[k] += mixer.log2_of(code[ids[k]], [r[k] for r in here], answers) / LOG2_10
            doc = np.repeat(np.arange(len(n)), n)
            out.append((n, np.bincount(doc, k, len(n)).astype(np.int64),
                        np.bincount(doc, base[ids], len(n)), np.bincount(doc, value, len(n)),
                        np.bincount(doc, spell[ids], len(n))))
        n, n_known, b, v, letter = (np.concatenate(x) for x in zip(*out))
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"),
                         "n_tokens": n, "n_known": n_known,
                         "train_tokens": np.full(len(n), s.total, np.int64), "base_score": b,
                         "score": v, "spelled_score": v + letter,
                         "n_bytes": docs.column("n_bytes")})
    return run


def score_texts(docs: DataFrame, held_out: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and spelled_score (log10),
    bits_per_byte of every text; it learns from documents whose fold is not ``held_out``."""
    spark = docs.sparkSession
    fold = crc_fold(F.col("doc_id"))
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", (fold == held_out).alias("held_out"))
    folder = shared_folder(spark, "texts")
    blocks = settle(rows.mapInArrow(_blocked(block_bytes, folder), "block bigint, uri string, n_bytes bigint"), "blocks")
    n_bytes, n_blocks = blocks.agg(F.sum("n_bytes"), F.count(F.lit(1))).first()
    n_bytes, n_blocks = n_bytes or 0, max(1, n_blocks)
    # weights and maps are learnt from LEARN_BYTES of text or more, however small the partitions are
    tasks, parts = max(1, -(-n_bytes // LEARN_BYTES)), max(1, -(-n_bytes // PART_BYTES))
    dealt = min(parts, FAN), parts, n_blocks, FAN
    worded, learn, keyed = _learn_words(dealt[0])
    blocks = blocks.select("block", "uri")
    learned = settle(blocks.repartition(tasks).mapInArrow(learn, MODEL_SQL), "learned", "zstd")
    blocks = blocks.repartition(n_blocks)
    counts, found = counted(blocks.mapInArrow(worded, CELL_SQL), *dealt)
    total, distinct, single = found.agg(F.sum("total"), F.sum("distinct"), F.sum("single")).first()
    model = (learned.union(found.select("names").coalesce(tasks).mapInArrow(_learn_letters, MODEL_SQL))
             .groupBy("kind", "place").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    # as many rows as the spelling model has slots and the empty context nodes, whatever the corpus
    got = settle(model, "model").toArrow()
    shared = spark.sparkContext.broadcast((
        {k: got.column(k).to_numpy() for k in ("kind", "place", "a", "b")},
        int(total or 0), int(distinct or 0), int(single or 0)))
    # keys are made again wherever they are read: on disk they would take as much as the shuffle of them
    answers = answered(blocks.mapInArrow(keyed, CELL_SQL), *dealt, small=True)
    told = answers.unionByName(counts.withColumnRenamed("odds", "c"), allowMissingColumns=True)
    scored = told.groupBy("block").applyInArrow(
        _score_blocks(shared, dealt[0], folder),
        f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double, spelled_score double, n_bytes bigint")
    return scored.withColumn("bits_per_byte", -F.col("spelled_score") * F.lit(LOG2_10)
                             / F.greatest(F.col("n_bytes"), F.lit(1))).drop("n_bytes")
