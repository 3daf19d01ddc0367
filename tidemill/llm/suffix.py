"""Exact substring dedup over bytes with a sparse suffix array: every byte covered by a string of 400 bytes
that also starts anywhere else is found.

Sorting the suffixes of all places would move many times the text. Here each window of 400 bytes stands by
its anchor, the place of the smallest-hashed 32 bytes in it; windows in a row with one anchor are one range,
of 185 on average, and equal windows have equal anchors at equal offsets. A count-min sketch of the anchors
leaves out those that occur once. The suffixes at the others, with what precedes them in their ranges, are
dealt to buckets by splitters over their 32 leading bytes, sampled in the first pass. A bucket sorts its
suffixes, and the texts before them read backwards, by multikey quicksort on 8-byte keys, and takes the
lengths of common prefixes of neighbours. A window reaching o bytes before its anchor is repeated if another
range shares its class of prefixes of 400 - o bytes and its class of the o bytes before. That is exact: bytes
are compared, not hashes. Equal leading bytes never lie on both sides of a splitter, so no two buckets have
suffixes to compare.

Ranges whose bytes are equal within some megabytes of text are settled there and sent once. Anchors that occur over
20,000 times in all would fill a bucket: their windows are sent one by one, compared by a 128-bit
cryptographic digest (BLAKE2b) of their bytes, and dealt by it and one of ``SALTS`` numbers of the stretch; one of each
digest in such a group meets those of the others once more.

Defined cases: null and empty texts have nothing to remove; each row is a document of its own when strings are compared, and what is
removed is kept by doc_id and text, so that rows that repeat or lack a doc_id keep what is theirs alone; an empty table gives no rows; long texts are cut into overlapping
slices, which loses no window; further columns are left alone.
"""

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.anchors import Rolling, byte_values, groups, mixed, ranges, smallest, spread
from tidemill.llm.common import drop_stored, key_back, keyed_texts, stored
from tidemill.llm.sketch import SCHEMA, Estimate, TaskSketch, bits_for

WINDOW, LEAD = 400, 32
#: Window starts looked at together, bytes of all texts that one bucket stands for, and leading bytes sampled.
STRETCH, BUCKET, SAMPLE = 1 << 19, 6 << 20, 50_000
#: Groups over which the windows with one very common digest are dealt, by stretch.
SALTS = 4096
_MARKS = "doc_id long, sub long, start long, stop long"


class Stretch:
    """Some texts or slices one after the other, with the ranges of their windows."""

    def __init__(self, entries: list[tuple[int, int, bytes]], window: int, lead: int):
        self.data = np.frombuffer(b"".join(x for _, _, x in entries) + bytes(lead), np.uint8)
        size = np.array([len(x) for _, _, x in entries])
        base, many = np.cumsum(size) - size, np.maximum(size - window + 1, 0)
        grams = Rolling(byte_values(0)[self.data]).all(lead)
        self.anchor, self.first, self.n = ranges(smallest(grams, window - lead + 1), spread(base, many))
        self.gram = grams[self.anchor]
        of = np.searchsorted(base + size, self.first, "right")
        self.doc = np.array([d for d, _, _ in entries], np.int64)[of]
        self.at = self.first - base[of] + np.array([a for _, a, _ in entries], np.int64)[of]
        self.lead = lead

    def leads(self, keep: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(sliding_window_view(self.data, self.lead)[self.anchor[keep]]).view(f"S{self.lead}").ravel()


def _stretches(batches: Iterator[pa.RecordBatch], window: int, lead: int) -> Iterator[Stretch]:
    held, size = [], 0
    for batch in batches:
        for doc, text in zip(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True), batch.columns[-1], strict=True):
            data = text.as_py().encode()
            for at in range(0, max(1, len(data) - window + 1), STRETCH):
                part = data[at : at + STRETCH + window - 1]
                if len(part) < window:
                    continue
                held.append((doc, at, part))
                size += len(part)
                if size >= STRETCH:
                    yield Stretch(held, window, lead)
                    held, size = [], 0
    if held:
        yield Stretch(held, window, lead)


def _first_pass(bits: int, stride: int, window: int, lead: int):
    """Rows of the task's sketch, and under shard -1 every ``stride``-th anchor's leading bytes."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = TaskSketch(bits), 0
        for s in _stretches(batches, window, lead):
            yield from sketch.add(s.gram)
            own = np.arange(-seen % stride, len(s.gram), stride)
            seen += len(s.gram)
            if len(own):
                cols = [pa.array([v], t) for v, t in ((-1, pa.int32()), (0, pa.int32()), (s.leads(own).tobytes(), pa.binary()), (b"", pa.binary()))]
                yield pa.RecordBatch.from_arrays(cols, names=["shard", "part", "cells", "sums"])
        yield sketch.rows()

    return go


# Columns of what is sent to a bucket: ranges (the anchor's offset, the number of windows, their bytes), single
# windows of very common anchors by digest, and marks that are settled. doc, w_doc: doc_id and sub in turn.
_RANGES = {"doc": "<i8", "at": "<i8", "off": "<i4", "n": "<i4", "bytes": "u1"}
_SINGLE = {"w_doc": "<i8", "w_at": "<i8", "w_a": "<u8", "w_b": "<u8"}
_SETTLED = {"m_doc": "<i8", "m_sub": "<i8", "m_start": "<i8", "m_stop": "<i8"}
_ALL = _RANGES | _SINGLE | _SETTLED
_SENT = "bucket int, " + ", ".join(f"{k} binary" for k in _ALL)


def _equal_before(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the keys; in it, which rows equal the row before, and which have any equal."""
    order = np.lexsort(keys)
    again = np.ones(len(order), bool)
    again[:1] = False
    for k in keys:
        again[1:] &= k[order][1:] == k[order][:-1]
    return order, again, again | np.concatenate((again[1:], [False])) if len(again) else again


def _send(estimate, splitters: np.ndarray, buckets: int, window: int, lead: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for turn, s in enumerate(_stretches(batches, window, lead)):
            rows: dict[int, dict[str, np.ndarray]] = {}
            keep = np.flatnonzero(estimate.value.repeated(s.gram))
            common = estimate.value.very_common(s.gram[keep])
            marks = []
            # Ranges whose bytes and offset are equal here: the first stands for all.
            data, seen, twin = s.data.tobytes(), {}, np.zeros(len(s.first), bool)
            first, off, end = s.first[keep], s.anchor[keep] - s.first[keep], s.first[keep] + s.n[keep] + window - 1
            stands = np.array([seen.setdefault((o, data[a:b]), i) for i, o, a, b in zip(keep.tolist(), off.tolist(), first.tolist(), end.tolist(), strict=True)], np.int64)
            twin[keep[stands != keep]] = True
            twin[stands[stands != keep]] = True
            for i in np.flatnonzero(twin):
                marks.append((*s.doc[i], s.at[i], s.at[i] + s.n[i] + window - 1))
            own, hot = keep[(stands == keep) & ~common], keep[(stands == keep) & common]
            bucket = np.searchsorted(splitters, s.leads(own), "right")
            sort = np.argsort(bucket, kind="stable")
            for lo, hi in groups(bucket[sort]):
                i = own[sort[lo:hi]]
                rows[int(bucket[sort[lo]])] = {"doc": s.doc[i], "at": s.at[i], "off": s.anchor[i] - s.first[i], "n": s.n[i], "bytes": s.data[spread(s.first[i], s.n[i] + window - 1)]}
            # Windows of very common anchors, one by one.
            start = spread(s.first[hot], s.n[hot])
            if len(start):
                a, b = np.frombuffer(b"".join([blake2b(data[x : x + window], digest_size=16).digest() for x in start.tolist()]), "<u8").reshape(-1, 2).T
                doc, at = np.repeat(s.doc[hot], s.n[hot], axis=0), spread(s.at[hot], s.n[hot])
                order, again, twin = _equal_before(b, a)
                t = order[twin]
                t = t[np.lexsort((at[t], *doc[t].T[::-1]))]
                marks += _intervals(doc[t], at[t], window)
                i = order[~again]
                bucket = (mixed(a[i] + np.uint64((part + turn) % SALTS)) % np.uint64(buckets)).astype(np.int64)
                sort = np.argsort(bucket, kind="stable")
                for lo, hi in groups(bucket[sort]):
                    j = i[sort[lo:hi]]
                    rows.setdefault(int(bucket[sort[lo]]), {}).update({"w_doc": doc[j], "w_at": at[j], "w_a": a[j], "w_b": b[j]})
            if marks:
                m = np.array(marks, np.int64)
                rows.setdefault(turn * 7919 % buckets, {}).update(dict(zip(_SETTLED, m.T, strict=True)))
            none = np.zeros(0)
            cols = [pa.array([*rows], pa.int32())] + [pa.array([r.get(k, none).astype(t).tobytes() for r in rows.values()], pa.binary()) for k, t in _ALL.items()]
            yield pa.RecordBatch.from_arrays(cols, names=["bucket", *_ALL])

    return go


def _intervals(doc: np.ndarray, at: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """doc_id, sub, start and stop of the bytes of windows given in order of document and place."""
    if not len(at):
        return []
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]).any(axis=1) | (at[1:] > at[:-1] + window))))
    last = np.concatenate((new[1:], [len(at)])) - 1
    return list(zip(*doc[new].T.tolist(), at[new].tolist(), (at[last] + window).tolist(), strict=True))


def multikey(keys: np.ndarray) -> np.ndarray:
    """Order of rows by their columns, first to last: each column sorts only the rows that are still equal."""
    order = np.argsort(keys[:, 0], kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = keys[order[1:], 0] != keys[order[:-1], 0]
    for d in range(1, keys.shape[1]):
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        rows, group = order[at], np.cumsum(new)[at]
        key = keys[rows, d]
        sort = np.lexsort((key, group))
        order[at] = rows[sort]
        key = key[sort]
        new[at[1:]] |= (key[1:] != key[:-1])
    return order


def _classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each row among the sorted rows, and by rank how many leading bytes it shares with the row before."""
    m, wide = rows.shape
    padded = np.zeros((m, -(-wide // 8) * 8), np.uint8)
    padded[:, :wide] = rows
    order = multikey(padded.view(">u8").astype(np.uint64))
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    common = np.zeros(m, np.int64)
    for a in range(1, m, 4096):
        b = min(m, a + 4096)
        differ = padded[order[a:b]] != padded[order[a - 1 : b - 1]]
        common[a:b] = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
    return rank, common


def repeated_windows(data: np.ndarray, off: np.ndarray, n: np.ndarray, window: int = WINDOW, lead: int = LEAD) -> np.ndarray:
    """For the windows of all ranges, one after the other: whether another range has an equal one at the same offset.

    data: the ranges' bytes, one after the other; off: the anchor's offset in each; n: its number of windows.
    """
    m, size = len(n), n + window - 1
    start = np.cumsum(size) - size
    base = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), bool)
    if m < 2:
        return out
    padded = np.concatenate((np.zeros(window, np.uint8), data, np.zeros(window, np.uint8)))
    view = sliding_window_view(padded, window)
    after = view[start + off + window] * (np.arange(window) < (size - off)[:, None])
    left = window - lead
    before = view[start + off][:, ::-1][:, :left] * (np.arange(left) < off[:, None])
    rank_a, common_a = _classes(after)
    rank_b, common_b = _classes(before)
    place = np.arange(m)
    for o in range(left + 1):
        rows = np.flatnonzero((off >= o) & (off - o < n))
        if len(rows) < 2:
            continue
        class_a = np.maximum.accumulate(np.where(common_a < window - o, place, 0))[rank_a[rows]]
        class_b = np.maximum.accumulate(np.where(common_b < o, place, 0))[rank_b[rows]] if o else 0
        key = class_a * m + class_b
        order = np.argsort(key)
        same = np.flatnonzero(key[order][1:] == key[order][:-1])
        hit = rows[order[np.concatenate((same, same + 1))]]
        out[base[hit] + off[hit] - o] = True
    return out


def _compare(window: int, lead: int):
    def go(table: pa.Table) -> pa.Table:
        got = {k: np.concatenate([np.frombuffer(x, t) for x in table.column(k).to_pylist()]) for k, t in _ALL.items()}
        got |= {k: got[k].reshape(-1, 2) for k in ("doc", "w_doc")}
        n = got["n"].astype(np.int64)
        hit = repeated_windows(got["bytes"], got["off"].astype(np.int64), n, window, lead)
        marks = [(got["m_doc"], got["m_sub"], got["m_start"], got["m_stop"])]
        doc, at = np.repeat(got["doc"], n, axis=0)[hit], spread(got["at"], n)[hit]
        order, _, twin = _equal_before(got["w_b"], got["w_a"])
        t = order[twin]
        doc, at = np.concatenate((doc, got["w_doc"][t])), np.concatenate((at, got["w_at"][t]))
        s = np.lexsort((at, *doc.T[::-1]))
        if found := _intervals(doc[s], at[s], window):
            marks.append(tuple(np.array(found, np.int64).T))
        cols = [np.concatenate(c) for c in zip(*marks, strict=True)]
        # One window of each digest goes on, to meet those of the other groups.
        _, one = np.unique(np.stack((got["w_a"], got["w_b"])), axis=1, return_index=True) if len(got["w_a"]) else (0, np.zeros(0, np.int64))
        on = [*got["w_doc"][one].T, got["w_at"][one], got["w_at"][one] + window, got["w_a"][one].view(np.int64), got["w_b"][one].view(np.int64)]
        names = ("doc_id", "sub", "start", "stop", "a", "b")
        out = {k: pa.array(np.concatenate((c, x)), pa.int64()) for k, c, x in zip(names, cols, on, strict=False)}
        out |= {k: pa.concat_arrays([pa.nulls(len(cols[0]), pa.int64()), pa.array(x, pa.int64())]) for k, x in zip(names[4:], on[4:], strict=True)}
        return pa.table(out)

    return go


def _compare_firsts(table: pa.Table) -> pa.Table:
    """The windows whose digest is there more than once."""
    order, _, twin = _equal_before(table.column("b").to_numpy(), table.column("a").to_numpy())
    return table.take(pa.array(np.sort(order[twin]))).select(["doc_id", "sub", "start", "stop"])


def marks(docs: DataFrame, window: int = WINDOW, lead: int = LEAD) -> DataFrame:
    """doc_id, sub, start, stop: byte ranges covered by repeated strings, which may overlap."""
    spark, rows = docs.sparkSession, keyed_texts(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = 2 * size / (window - lead + 2)
    bits, buckets = bits_for(expected), max(16, size // BUCKET)
    first = stored(rows.mapInArrow(_first_pass(bits, max(1, int(expected / SAMPLE)), window, lead), SCHEMA), "suffix-sketch")
    estimate = spark.sparkContext.broadcast(Estimate(first.filter("shard >= 0"), bits))
    sampled = b"".join(bytes(r["cells"]) for r in first.filter("shard < 0").select("cells").collect())  # some SAMPLE times 32 bytes
    drop_stored(first)
    sample = np.sort(np.frombuffer(sampled, f"S{lead}"))
    splitters = np.unique(sample[np.arange(1, buckets) * len(sample) // buckets]) if len(sample) else sample
    sent = rows.mapInArrow(_send(estimate, splitters, buckets, window, lead), _SENT)
    found = stored(sent.groupBy("bucket").applyInArrow(_compare(window, lead), f"{_MARKS}, a long, b long"), "suffix-compared")
    firsts = found.filter("a is not null").withColumn("bucket", F.pmod("a", F.lit(buckets)))
    return found.filter("a is null").drop("a", "b").unionByName(firsts.groupBy("bucket").applyInArrow(_compare_firsts, _MARKS))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("marks").to_pylist(), strict=True):
            data = text.as_py().encode()
            spans, kept, at = [], [], 0
            for m in sorted((m["start"], min(m["stop"], len(data))) for m in found or ()):
                if m[0] >= len(data):
                    continue
                if spans and m[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], m[1])
                else:
                    spans.append([*m])
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            out.append((doc, len(data), sum(b - a for a, b in spans), len(spans), b"".join(kept)))
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 4 else pa.int64()) for i, c in enumerate(cols)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, lead: int = LEAD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the remaining bytes) of each document."""
    found = marks(docs, window, lead).groupBy("doc_id", "sub").agg(F.collect_set(F.struct("start", "stop")).alias("marks"))
    rows = keyed_texts(docs).join(found, ["doc_id", "sub"], "left").select("doc_id", "text", "marks")
    out = rows.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("doc_id", key_back(F.col("doc_id")))
