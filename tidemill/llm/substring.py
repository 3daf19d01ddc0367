"""Substring dedup over words: every word covered by a window of 20 words that also starts earlier goes.

First pass: each range of windows counts its anchor (see ``anchors``) in a count-min sketch. A window's own
count is at most its anchor's, so the merged sketch overestimates it. Second pass: only windows whose anchor
is estimated as repeated are grouped exactly, by a 128-bit cryptographic digest (BLAKE2b) of their words' own
bytes; none that is repeated can be missing. Hashes of words only choose anchors and buckets: two that collide
cost time, not results. Within some megabytes of text a repeat is settled on the spot and only the first of
equal windows is sent on, so a window that many documents share is sent once a stretch and not once a document. Windows meet by their
anchor. Those of very common anchors meet by their own digest, and a task sends only the first place it has met of each: a window
that a third of all documents share is sent once a task, so what meets in its group is some 40 bytes a task.

Defined cases: null and empty texts have no words; very long texts are read in slices that end at white space, and
all their windows are compared; a doc_id stands for one document, so rows that repeat it with the
same text get equal results and don't remove each other; rows that repeat it with another text, as rows without
one do, are documents of their own, in order of their texts' hashes; an empty table gives no rows; further columns are left alone.
"""

from collections.abc import Iterator
from hashlib import blake2b
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.anchors import Rolling, collapse, groups, hash_runs, ranges, smallest, spread
from tidemill.llm.common import key_back, keyed_texts
from tidemill.llm.sketch import SCHEMA, Estimate, TaskSketch, bits_for

WINDOW, RUN = 20, 6
#: Bytes of text looked at together, bytes whose words are hashed together, and bytes of all texts that one bucket stands for.
STRETCH, SLICE, BUCKET = 1_000_000, 1 << 18, 8 << 20
#: Very common windows that a task holds the first place of, some 20 MB, before it sends them.
MOST_FIRSTS = 100_000
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def slices(text: bytes) -> Iterator[tuple[int, int]]:
    """A text's slices, which end before white space."""
    at = 0
    while at < len(text):
        end = _SPACE.search(text, at + SLICE)
        to = end.start() if end else len(text)
        yield at, to
        at = to


class Words:
    """The words of some documents: keys and numbers of words by document, and of all words the hashes, and where
    each begins and ends in the documents joined by spaces."""

    def __init__(self, keys: list[tuple], texts: list[bytes]):
        self.keys, self.joint = np.array(keys, np.int64), b" ".join(texts)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for at, to in slices(self.joint):
            part = np.frombuffer(self.joint, np.uint8, to - at, at)
            inside = np.concatenate(([False], ~_IS_SPACE[part], [False]))
            edges = np.flatnonzero(inside[1:] != inside[:-1])
            found.append((edges[::2] + at, edges[1::2] + at, hash_runs(part, edges[::2], edges[1::2])))
        self.start, self.end, self.hashes = (np.concatenate(x) for x in zip(*found, strict=True))
        self.n = np.diff(np.searchsorted(self.start, np.cumsum([0, *(len(x) + 1 for x in texts)])))
        # How many gaps before each word aren't one space.
        odd = (self.start[1:] - self.end[:-1] != 1) | (np.frombuffer(self.joint, np.uint8)[self.end[:-1]] != 32)
        self.odd = np.concatenate(([0], np.cumsum(odd)))

    def digests(self, first: np.ndarray, words: int) -> np.ndarray:
        """Two numbers for each run of words: the digest of its bytes, one space between words."""
        joint, last = self.joint, first + words - 1
        runs = zip(self.start[first].tolist(), self.end[last].tolist(), (self.odd[first] == self.odd[last]).tolist(), strict=True)
        own = [blake2b(joint[a:b] if even else b" ".join(joint[a:b].split()), digest_size=16).digest() for a, b, even in runs]
        return np.frombuffer(b"".join(own), "<u8").reshape(-1, 2)


    def wholes(self) -> np.ndarray:
        """Two numbers for each document: the digest of all its words, one space between them."""
        first = np.cumsum(self.n) - self.n
        own = [b""] * len(self.n)
        for i in np.flatnonzero(self.n).tolist():
            a, b = int(first[i]), int(first[i] + self.n[i] - 1)
            run = self.joint[self.start[a] : self.end[b]]
            own[i] = run if self.odd[a] == self.odd[b] else b" ".join(run.split())
        return np.frombuffer(b"".join(blake2b(x, digest_size=16).digest() for x in own), "<i8").reshape(-1, 2)


def word_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Some megabytes of documents at a time; their keys are the columns before the text."""
    keys, held, size = [], [], 0
    for batch in batches:
        for key, text in zip(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True), batch.columns[-1], strict=True):
            keys.append(key)
            held.append(text.as_py().encode())
            size += len(held[-1])
            if size > STRETCH:
                yield Words(keys, held)
                keys, held, size = [], [], 0
    if keys:
        yield Words(keys, held)


class Windows:
    """The windows of a stretch, in ranges that share their anchor."""

    def __init__(self, words: Words, window: int, run: int):
        base = np.cumsum(words.n) - words.n
        many = np.maximum(words.n - window + 1, 0)
        runs = Rolling(words.hashes, 1).all(run)
        anchor, self.first, self.n = ranges(smallest(runs, window - run + 1), spread(base, many))
        self.anchor = runs[anchor]
        self.words, self.window = words, window
        of = np.searchsorted(base + many, self.first, "right")
        self.doc, self.at = words.keys[of], self.first - base[of]

    def pick(self, keep: np.ndarray) -> tuple[np.ndarray, ...]:
        """anchor, doc (a row of two keys), place and digest of each window of the ranges to keep."""
        n = self.n[keep]
        return np.repeat(self.anchor[keep], n), np.repeat(self.doc[keep], n, axis=0), spread(self.at[keep], n), self.words.digests(spread(self.first[keep], n), self.window)


def repeats(doc: np.ndarray, at: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by window, document and place; and in that order whether a window has one before it elsewhere."""
    order = np.lexsort((at, *doc.T[::-1], *own.T))
    d, p, o = doc[order], at[order], own[order]
    new = np.concatenate(([True], (o[1:] != o[:-1]).any(axis=1))) if len(o) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(o)), 0)) if len(o) else np.zeros(0, np.int64)
    return order, (d != d[first]).any(axis=1) | (p != p[first])


_SENT = "bucket int, doc binary, at binary, n binary, own binary"
#: doc: doc_id and sub in turn; own: the digest's two numbers in turn.
_KINDS = {"doc": "<i8", "at": "<i8", "n": "<i4", "own": "<u8"}


def _runs(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, first place and number of windows in a row."""
    s = np.lexsort((at, *doc.T[::-1]))
    doc, at = doc[s], at[s]
    number = np.cumsum(np.concatenate(([True], (doc[1:] != doc[:-1]).any(axis=1)))) - 1 if len(doc) else np.zeros(0, np.int64)
    own = doc[np.unique(number, return_index=True)[1]]
    number, at, n = collapse(number, at)
    return own[number], at, n


def _sketch(bits: int, window: int, run: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = TaskSketch(bits)
        for x in word_stretches(batches):
            yield from sketch.add(Windows(x, window, run).anchor)
        yield sketch.rows()

    return go


class Firsts:
    """The first place that a task has met so far of each very common window, so that it sends that one place and not one a stretch."""

    def __init__(self):
        self.held: dict[bytes, tuple[int, int, int]] = {}

    def meet(self, doc: np.ndarray, at: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """doc and place of those windows, of these and of the ones held, that aren't the first any more."""
        later = []
        for d, p, k in zip(map(tuple, doc.tolist()), at.tolist(), own, strict=True):
            place, k = (*d, p), k.tobytes()
            first = self.held.get(k, place)
            if first != place:
                later.append(max(first, place))
            self.held[k] = min(first, place)
        found = np.array(later, np.int64).reshape(-1, 3)
        return found[:, :2], found[:, 2]

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        places = np.array(list(self.held.values()), np.int64).reshape(-1, 3)
        own = np.frombuffer(b"".join(self.held), "<u8").reshape(-1, 2)
        self.held = {}
        return places[:, :2], places[:, 2], own


def _sent(doc: np.ndarray, at: np.ndarray, own: np.ndarray, bucket: np.ndarray) -> list[tuple]:
    """A row per bucket: its windows in ranges."""
    s = np.lexsort((at, *doc.T[::-1], bucket))
    doc, at, own, bucket = (v[s] for v in (doc, at, own, bucket))
    rows = []
    if len(own):
        same = (bucket[1:] == bucket[:-1]) & (doc[1:] == doc[:-1]).all(axis=1) & (at[1:] == at[:-1] + 1)
        new = np.flatnonzero(np.concatenate(([True], ~same)))
        n = np.diff(np.concatenate((new, [len(own)])))
        for a, b in groups(bucket[new]):
            i = new[a:b]
            rows.append((int(bucket[i[0]]), doc[i], at[i], n[a:b], own[i[0] : i[0] + n[a:b].sum()]))
    return rows


def _send(estimate, buckets: int, window: int, run: int):
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = [pa.array([r[0] for r in rows], pa.int32())]
        cols += [pa.array([r[i].astype(t).tobytes() for r in rows], pa.binary()) for i, t in enumerate(_KINDS.values(), 1)]
        return pa.RecordBatch.from_arrays(cols, names=["bucket", *_KINDS])

    def taken(firsts: Firsts) -> list[tuple]:
        doc, at, own = firsts.take()
        return _sent(doc, at, own, (own[:, 0] % np.uint64(buckets)).astype(np.int64))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = Firsts()
        for turn, x in enumerate(word_stretches(batches)):
            w = Windows(x, window, run)
            anchor, doc, at, own = w.pick(estimate.value.repeated(w.anchor))
            order, again = repeats(doc, at, own)
            mark = np.zeros(len(own), bool)
            mark[order[again]] = True
            common = ~mark & estimate.value.very_common(anchor)
            later = firsts.meet(doc[common], at[common], own[common])
            rows = []
            # What is settled already goes along as ranges without digests.
            d, p, n = _runs(*(np.concatenate(v) for v in zip((doc[mark], at[mark]), later, strict=True)))
            if len(d):
                rows.append((int(d[0, 0] + turn) % buckets, d, p, n, np.zeros(0, "<u8")))
            rest = ~mark & ~common
            rows += _sent(doc[rest], at[rest], own[rest], (anchor[rest] % np.uint64(buckets)).astype(np.int64))
            yield batch_of(rows)
            if len(firsts.held) > MOST_FIRSTS:
                yield batch_of(taken(firsts))
        yield batch_of(taken(firsts))

    return go


def _settle(table: pa.Table) -> pa.Table:
    """The places of a bucket's windows that have an equal one before them, as ranges; and those settled before."""
    got = {k: [np.frombuffer(x, t) for x in table.column(k).to_pylist()] for k, t in _KINDS.items()}
    settled = [i for i, x in enumerate(got["own"]) if not len(x)]
    live = [i for i, x in enumerate(got["own"]) if len(x)]
    got |= {k: [x.reshape(-1, 2) for x in got[k]] for k in ("doc", "own")}
    pick = lambda k, rows: np.concatenate([got[k][i] for i in rows] or [np.zeros((0, 2) if k in ("doc", "own") else 0, _KINDS[k])])
    n = pick("n", live)
    doc, at, own = np.repeat(pick("doc", live), n, axis=0), spread(pick("at", live), n), pick("own", live)
    order, again = repeats(doc, at, own)
    d, p, n = _runs(doc[order[again]], at[order[again]])
    out = [np.concatenate((x, pick(k, settled))) for k, x in (("doc", d), ("at", p), ("n", n))]
    return pa.table({"doc_id": pa.array(out[0][:, 0], pa.int64()), "sub": pa.array(out[0][:, 1], pa.int64()), "at": pa.array(out[1], pa.int64()), "n": pa.array(out[2], pa.int32())})


def repeated_windows(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """doc_id, sub, at, n: n windows from word ``at`` on each have an equal window that starts earlier."""
    spark, rows = docs.sparkSession, keyed_texts(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits, buckets = bits_for(size / 6 * 2 / (window - run + 2)), max(16, size // BUCKET)
    estimate = spark.sparkContext.broadcast(Estimate(rows.mapInArrow(_sketch(bits, window, run), SCHEMA), bits))
    sent = rows.mapInArrow(_send(estimate, buckets, window, run), _SENT)
    return sent.groupBy("bucket").applyInArrow(_settle, "doc_id long, sub long, at long, n int")


def _remove(window: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, marks in zip(batch.column("text"), batch.column("marks").to_pylist(), strict=True):
                words = text.as_py().encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                for m in marks or ():
                    gone[min(m["at"], len(words))] += 1
                    gone[min(m["at"] + m["n"] + window - 1, len(words))] -= 1
                if marks:
                    stay = np.cumsum(gone[:-1]) == 0
                    left = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                else:
                    left = words
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            cols = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept"])

    return go


def remove_repeats(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, one space between, as UTF-8) of each document."""
    marks = repeated_windows(docs, window, run).groupBy("doc_id", "sub").agg(F.collect_set(F.struct("at", "n")).alias("marks"))
    rows = keyed_texts(docs).join(marks, ["doc_id", "sub"], "left").select("doc_id", "text", "marks")
    out = rows.mapInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept binary")
    return out.withColumn("doc_id", key_back(F.col("doc_id")))
