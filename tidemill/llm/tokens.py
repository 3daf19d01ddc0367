"""Token ids by a public tokenizer file, exactly as its library gives them, with work shared between equal words.

The tokenizer's own rules cut texts at white space and between letters, digits and other characters, so a
text's ids are those of its parts one after the other. Texts of ASCII and Latin-1 letters are cut here by
those rules, some hundred thousand parts at a time; each distinct part is encoded by the library once per worker and
kept in a bounded table under its own bytes. In other texts only the runs between white space that hold other
characters, or what may be a special token, go to the library whole.
"""

from collections.abc import Iterator
import functools
from hashlib import blake2b
from itertools import chain
import os
import re

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

from tidemill.llm.anchors import mixed, spread

#: Fixed value: the id that ends each document.
END = 1
#: Parts kept by a worker, in the table and of other texts each; what is full is emptied. They take some 150 MB at most.
CACHE = 1_000_000
#: Characters looked at together.
SLICE = 1 << 20

_PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
# Fixed value: the split pattern of the tokenizer file, for these characters alone.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+")
# The same rules by byte of Latin-1: 0 white space, 1 letters, 2 digits, 3 others; and the letters after an apostrophe.
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*b"abcdefghijklmnopqrstuvwxyz", *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = 1
_KIND[[*b"0123456789"]] = 2
_ONE, _TWO = np.zeros(256, bool), np.zeros(1 << 16, bool)
_ONE[[*b"stmd"]] = True
_TWO[[x << 8 | y for x, y in (b"re", b"ve", b"ll")]] = True

_U = np.uint64
#: The first n bytes of a word of 8.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)
#: Bytes of a part that are its own key.
KEY = 24


def cut(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts of a lower-cased text in Latin-1 begin and end. The text ends with white space, three bytes at least."""
    kind = _KIND[raw]
    start = kind != 0
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    at = np.flatnonzero(start & (raw == 39))
    if len(at):
        x, y = raw[at + 1], raw[at + 2]
        one = _ONE[x]
        two = _TWO[x.astype(np.int32) << 8 | y] & ~one
        for found, n in ((at[one], 2), (at[two], 3)):
            start[found + 1] = False
            start[found + n] = kind[found + n] != 0
    edges = np.flatnonzero(start | (kind == 0))
    own = np.flatnonzero(start[edges])
    return edges[own], edges[own + 1]


def keys(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Three numbers for each part: its bytes, or a digest of as many bytes of one that is longer. raw: with zeros behind."""
    words = np.frombuffer(raw, "<u8", len(raw) // 8)
    i, shift, n = start >> 3, ((start & 7) << 3).astype(_U), end - start
    out = np.empty((3, len(start)), _U)
    low = words[i]
    for k in range(3):
        high = words[i + k + 1]
        out[k] = (low >> shift | high << (_U(63) - shift) << _U(1)) & _FIRST[np.clip(n - 8 * k, 0, 8)]
        low = high
    for j in np.flatnonzero(n > KEY).tolist():
        out[:, j] = np.frombuffer(blake2b(raw[start[j] : end[j]], digest_size=KEY).digest(), "<u8")
    return out


class Table:
    """Ids by key, for so many keys at most: an open hash table, looked up for many keys at once."""

    def __init__(self, most: int):
        self.most, self.bits = most, max(4, (2 * most - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys, self.first, self.many = np.zeros((3, most), _U), np.zeros(most, np.int64), np.zeros(most, np.int64)
        self.pool, self.used, self.n = np.zeros(2 * most, "<u4"), 0, 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        a, b, c = keys
        return (mixed(a ^ b * _U(0x9E3779B97F4A7C15) ^ c * _U(0xC2B2AE3D27D4EB4F)) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key; -1 where there is none."""
        slot, left, out = self._slot(keys), np.arange(keys.shape[1]), np.full(keys.shape[1], -1, np.int64)
        while len(left):
            e = self.slots[slot[left]]
            same = (self.keys[:, e] == keys[:, left]).all(axis=0) & (e >= 0)
            out[left[same]] = e[same]
            left = left[~same & (e >= 0)]
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, many: np.ndarray) -> None:
        """Takes new keys, which differ, with all their ids and how many each has."""
        m, more = keys.shape[1], len(ids)
        if self.used + more > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(more, len(self.pool)), "<u4")))
        own = np.arange(self.n, self.n + m)
        self.keys[:, own], self.many[own], self.first[own] = keys, many, self.used + np.cumsum(many) - many
        self.pool[self.used : self.used + more] = ids
        slot, left = self._slot(keys), np.arange(m)
        while len(left):
            free = left[self.slots[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.slots[slot[won]] = own[won]
            left = left[self.slots[slot[left]] != own[left]]
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1
        self.n, self.used = self.n + m, self.used + more


class Words:
    """Ids of texts as bytes: unsigned 32-bit, little-endian."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has its own tasks for the other cores
        self.library = Tokenizer.from_file(path)
        # The same model for parts that are cut and lower-cased already.
        self.parts = Tokenizer(self.library.model)
        self.parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ends = [k for v, k in self.library.get_vocab().items() if v.endswith("</w>")]
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[ends] = True
        self.known: dict[str, bytes] = {}
        self.table = Table(CACHE)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, and how many each has. All go in one text; a part's last id, and no other, stands for the end of a word."""
        ids = np.array(self.parts.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, "<u4")
        to = np.flatnonzero(self.ends[ids]) + 1
        if len(to) != len(parts):
            own = [np.frombuffer(x, "<u4") for x in self._whole(parts)]
            ids, to = np.concatenate(own), np.cumsum([len(x) for x in own])
        return ids, np.diff(to, prepend=0)

    def _plain(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        data = "\n".join(texts).lower().encode("latin-1") + b"\n\n\n"
        size = np.cumsum([len(x) + 1 for x in texts])
        raw = np.frombuffer(data, np.uint8)
        start, end = cut(raw)
        padded = data + bytes(48)
        own = keys(padded, start, end)
        entry = self.table.find(own)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new = missing[_distinct(own[:, missing])]
            if self.table.n + len(new) > self.table.most:
                missing, new = np.arange(len(start)), _distinct(own)
                self.table = Table(max(CACHE, len(new)))
            parts = [data[a:b].decode("latin-1") for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            self.table.add(own[:, new], *self._of_parts(parts))
            entry[missing] = self.table.find(own[:, missing])
        many = self.table.many[entry]
        ids = self.table.pool[spread(self.table.first[entry], many)].tobytes()
        upto = np.concatenate(([0], np.cumsum(many)))[np.searchsorted(start, size)] * 4
        return [ids[a:b] for a, b in zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True)]

    def _runs(self, text: str) -> list[str]:
        """Keys of the other cache whose ids make up the text; those of whole runs have a space before them."""
        out = []
        for run in text.encode("utf-8", "replace").split():  # bytes are split at ASCII white space alone
            run = run.decode("utf-8", "replace")
            if _PLAIN.fullmatch(run) and "<|" not in run:
                out += _PARTS.findall(run.lower())
            else:
                out.append(" " + run)
        return out

    def _others(self, texts: list[str]) -> list[bytes]:
        found = [self._runs(x) for x in texts]
        needed = set(chain.from_iterable(found))
        new = needed.difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = needed
        if parts := [x for x in new if x[0] != " "]:
            ids, many = self._of_parts(parts)
            raw, to = ids.tobytes(), np.cumsum(many) * 4
            self.known.update((k, raw[b - 4 * n : b]) for k, n, b in zip(parts, many.tolist(), to.tolist(), strict=True))
        if whole := [x for x in new if x[0] == " "]:
            self.known.update(zip(whole, self._whole([x[1:] for x in whole]), strict=True))
        get = self.known.__getitem__
        return [b"".join(map(get, x)) for x in found]

    def _group(self, texts: list[str]) -> list[bytes]:
        plain = [bool(_PLAIN.fullmatch(x)) and "<|" not in x for x in texts]
        a, b = iter(self._plain([x for x, p in zip(texts, plain, strict=True) if p])), iter(self._others([x for x, p in zip(texts, plain, strict=True) if not p]))
        return [next(a) if p else next(b) for p in plain]

    def encode(self, texts: Iterator[str]) -> Iterator[bytes]:
        """Ids of each text, without the end id. A long text is taken in slices that end before white space."""
        held, size = [], 0
        for text in texts:
            if len(text) > SLICE:
                yield from self._group(held)
                held, size, slices, at = [], 0, [], 0
                while at < len(text):
                    to = text.find(" ", at + SLICE)
                    to = len(text) if to < 0 else to
                    slices += self._group([text[at:to]])
                    at = to
                yield b"".join(slices)
                continue
            held.append(text)
            size += len(text)
            if size > SLICE:
                yield from self._group(held)
                held, size = [], 0
        yield from self._group(held)


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Places of the first of equal keys."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = (keys[:, order[1:]] != keys[:, order[:-1]]).any(axis=0)
    return order[new]


@functools.cache
def words(path: str) -> Words:
    """One per worker process and file."""
    return Words(path)
