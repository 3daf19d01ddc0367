"""Adaptive context-mixing range coder for token ids, in blocks that are reset and checksummed by themselves.

A block's ids are dealt in order to lanes of equal length, and all lanes advance together, one id a step,
over one model that learns after each step; numpy carries a step out for all lanes at once. The model mixes
three predictions of the next id: order 2 and order 1 each name the id that last followed their context,
with how often in a row that held; order 0 has adaptive frequencies of all ids. What the two names' claims
are worth is itself counted, by their two confidences and whether they agree, and the three shares divide
the coder's interval: [order 2's id | order 1's id | all ids by order 0].

The coder is a carry-less range coder with 64 bits of low and 16-bit words of output, one per lane.
Encoder and decoder use integers alone, so a block decodes alike on every machine.
"""

import struct
import zlib

import numpy as np

MAGIC = b"TMRC"
_HEAD = struct.Struct("<4sIIIIII")  # magic, ids, lanes, bytes of words, bytes of the index, crc32 of the ids, crc32 of the rest
MIX_BITS, ORDER0_BITS, CONTEXT_BITS = 12, 19, 20
_U = np.uint64
_TOP, _BOTTOM = _U(1 << 48), _U(1 << 32)


class Model:
    """Predicts and learns for all lanes at once. ids: how many different ids there may be."""

    def __init__(self, ids: int, lanes: int):
        self.ids, self.steps = ids, 0
        self.after1 = np.zeros(ids, np.int32)  # id << 3 | confidence
        self.after2 = np.zeros(1 << CONTEXT_BITS, np.int32)
        self.counts = np.zeros(ids, np.int64)
        self.mix = np.zeros((128, 3), np.int64) + [4, 2, 4]
        self.last = np.zeros(lanes, np.int64)
        self.before = np.zeros(lanes, np.int64)
        self._order0()
        self._shares()

    def _order0(self) -> None:
        spare = (1 << ORDER0_BITS) - self.ids
        total = int(self.counts.sum())
        self.freq = 1 + (self.counts * spare // total if total else np.full(self.ids, spare // self.ids))
        self.freq[0] += (1 << ORDER0_BITS) - int(self.freq.sum())
        self.low = np.concatenate(([0], np.cumsum(self.freq)[:-1]))
        self.at = None

    def _shares(self) -> None:
        share = self.mix * ((1 << MIX_BITS) - 8) // self.mix.sum(axis=1, keepdims=True)
        self.share2, self.share1 = share[:, 0] + 1, share[:, 1] + 1

    def predict(self) -> None:
        self.place = ((self.last * 0x9E3779B1) ^ (self.before * 0x85EBCA77 >> 3)) >> 7 & ((1 << CONTEXT_BITS) - 1)
        self.e2, self.e1 = self.after2[self.place], self.after1[self.last]
        self.id2, self.id1 = self.e2 >> 3, self.e1 >> 3
        self.cell = (self.e2 & 7) << 4 | (self.e1 & 7) << 1 | (self.id2 == self.id1)
        self.m2, self.m1 = self.share2[self.cell], self.share1[self.cell]
        self.m0 = (1 << MIX_BITS) - self.m2 - self.m1

    def interval(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Low end and width of the ids' shares, of 2^31."""
        self.hit2 = hit2 = x == self.id2
        self.hit1 = hit1 = (x == self.id1) & ~hit2
        two = self.m2 << ORDER0_BITS
        low, width = np.where(hit2, 0, two), np.where(hit2, two, self.m1 << ORDER0_BITS)
        rest = np.flatnonzero(~(hit2 | hit1))
        own, share = x[rest], self.m0[rest]
        low[rest] = ((1 << MIX_BITS) - share << ORDER0_BITS) + self.low[own] * share
        width[rest] = self.freq[own] * share
        self.missed = own
        return low, width

    def find(self, target: np.ndarray) -> np.ndarray:
        """The ids in whose shares the targets lie."""
        if self.at is None:
            self.at = np.repeat(np.arange(self.ids, dtype=np.int32), self.freq)
        share = target >> ORDER0_BITS
        named = self.m2 + self.m1
        out = np.where(share < self.m2, self.id2, self.id1).astype(np.int64)
        rest = np.flatnonzero(share >= named)
        offset = (target[rest] - (named[rest] << ORDER0_BITS)) // self.m0[rest]
        out[rest] = self.at[np.minimum(offset, (1 << ORDER0_BITS) - 1)]
        return out

    def learn(self, x: np.ndarray) -> None:
        """Takes the ids whose intervals were just asked for."""
        new = (x << 3 | 1).astype(np.int32)
        for table, place, e, hit in ((self.after2, self.place, self.e2, self.hit2), (self.after1, self.last, self.e1, x == self.id1)):
            sure = e & 7
            table[place] = np.where(hit, e + (sure < 7), np.where(sure > 1, e - sure + (sure >> 1), new))
        outcome = 2 - self.hit1 - 2 * self.hit2
        self.mix += np.bincount(self.cell * 3 + outcome, minlength=384).reshape(128, 3) << 2
        if (full := self.mix.sum(axis=1) > 1 << 16).any():
            self.mix[full] = (self.mix[full] >> 1) + 1
        self._shares()
        np.add.at(self.counts, self.missed, 1)
        self.before, self.last = self.last, x
        self.steps += 1
        if self.steps & (self.steps - 1) == 0 or self.steps % 32 == 0:
            self._order0()

    def drop(self, n: int) -> None:
        """The last lanes end."""
        self.last, self.before = self.last[:n], self.before[:n]


def _shape(n: int) -> tuple[int, int]:
    """Lanes and the ids of each (the last lanes may have one fewer)."""
    lanes = max(1, min(8192, n // 256))
    return lanes, -(-n // lanes)


def _lanes(n: int, lanes: int, steps: int) -> tuple[np.ndarray, int]:
    """First id of each lane, and how many lanes have the full number of steps."""
    full = n - lanes * (steps - 1)
    sizes = np.where(np.arange(lanes) < full, steps, steps - 1)
    return np.cumsum(sizes) - sizes, full


def _ready(low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Lanes whose first word is settled, or whose width is too small to go on."""
    return ((low ^ (low + width)) < _TOP) | (width < _BOTTOM)


def _full(low: np.ndarray, width: np.ndarray) -> np.ndarray:
    return np.flatnonzero(_ready(low, width))


def _shift(low: np.ndarray, width: np.ndarray, go: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Drops the first word of some lanes, cutting the width where that word isn't settled; which of them go again."""
    b = width[go]
    b = np.where((a ^ (a + b)) < _TOP, b, (_U(0) - a) & (_BOTTOM - _U(1))) << _SHIFT
    a = a << _SHIFT
    low[go], width[go] = a, b
    return _ready(a, b)


def encode(ids: np.ndarray, vocabulary: int) -> tuple[bytes, int]:
    """Words of all lanes, and the number of lanes."""
    n = len(ids)
    lanes, steps = _shape(n)
    if not n:
        return b"", 1
    first, full = _lanes(n, lanes, steps)
    model = Model(vocabulary, lanes)
    low, width = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    out_lane, out_word = [], []
    ids = ids.astype(np.int64)
    for t in range(steps):
        k = full if t == steps - 1 else lanes
        if k < len(model.last):
            model.drop(k)
        x = ids[first[:k] + t]
        model.predict()
        lo, w = model.interval(x)
        r = width[:k] >> _U(31)
        low[:k] += lo.astype(_U) * r
        width[:k] = w.astype(_U) * r
        model.learn(x)
        go = _full(low[:k], width[:k])
        while len(go):
            a = low[go]
            out_lane.append(go.astype(np.uint16))
            out_word.append((a >> _TOP_SHIFT).astype("<u2"))
            go = go[_shift(low, width, go, a)]
    for s in (48, 32, 16, 0):
        out_lane.append(np.arange(lanes, dtype=np.uint16))
        out_word.append((low >> _U(s) & _U(0xFFFF)).astype("<u2"))
    lane, word = np.concatenate(out_lane), np.concatenate(out_word)
    order = np.argsort(lane, kind="stable")
    sizes = np.bincount(lane, minlength=lanes).astype("<u4")
    return sizes.tobytes() + word[order].tobytes(), lanes


_SHIFT, _TOP_SHIFT = _U(16), _U(48)


def decode(data: bytes, n: int, lanes: int, vocabulary: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    steps = -(-n // lanes)
    sizes = np.frombuffer(data, "<u4", lanes).astype(np.int64)
    words = np.concatenate((np.frombuffer(data, "<u2", offset=4 * lanes).astype(_U), np.zeros(1, _U)))
    at = np.cumsum(sizes) - sizes
    first, full = _lanes(n, lanes, steps)
    code = np.zeros(lanes, _U)
    for _ in range(4):
        code = code << _SHIFT | words[at]
        at += 1
    model = Model(vocabulary, lanes)
    low, width = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    out = np.zeros(n, np.int64)
    most = _U((1 << 31) - 1)
    for t in range(steps):
        k = full if t == steps - 1 else lanes
        if k < len(model.last):
            model.drop(k)
        model.predict()
        r = width[:k] >> _U(31)
        target = np.minimum((code[:k] - low[:k]) // r, most).astype(np.int64)
        x = model.find(target)
        lo, w = model.interval(x)
        low[:k] += lo.astype(_U) * r
        width[:k] = w.astype(_U) * r
        out[first[:k] + t] = x
        model.learn(x)
        go = _full(low[:k], width[:k])
        while len(go):
            code[go] = code[go] << _SHIFT | words[at[go]]
            at[go] += 1
            go = go[_shift(low, width, go, low[go])]
    return out


def pack_block(doc_ids: list[int], sizes: list[int], ids: np.ndarray, vocabulary: int) -> bytes:
    """One block of whole documents: header, words, and an index of document ids and sizes."""
    words, lanes = encode(ids, vocabulary)
    index = zlib.compress(np.array([doc_ids, sizes], "<i8").tobytes(), 1)
    rest = words + index
    return _HEAD.pack(MAGIC, len(ids), lanes, len(words), len(index), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(rest)) + rest


def unpack_block(block: bytes, vocabulary: int) -> tuple[list[int], list[int], np.ndarray]:
    """doc_ids, sizes and ids of a block; raises ValueError if either checksum doesn't hold."""
    magic, n, lanes, n_words, n_index, crc_ids, crc_rest = _HEAD.unpack_from(block)
    rest = memoryview(block)[_HEAD.size :]
    if magic != MAGIC or len(rest) != n_words + n_index or zlib.crc32(rest) != crc_rest:
        raise ValueError("damaged block")
    ids = decode(rest[:n_words], n, lanes, vocabulary).astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc_ids:
        raise ValueError("damaged block: the ids' checksum doesn't hold")
    doc_ids, sizes = np.frombuffer(zlib.decompress(rest[n_words:]), "<i8").reshape(2, -1).tolist()
    return doc_ids, sizes, ids
