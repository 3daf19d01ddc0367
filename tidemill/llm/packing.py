"""Packing of token sequences into windows of fixed length by minimum bin slack.

A document longer than the window is cut at multiples of it; its last piece and shorter documents are the
pieces to combine. Only the numbers of pieces by length (2048 at most) reach the driver. There each window
starts with the longest length left, and a subset-sum over the bits of one integer tells which fillings of
the rest the multiset of lengths can make; the one closest to full is traced back to counts of lengths. Where it leaves more than
``SLACK`` ids free, one more piece, of the smallest length that is longer than what is free, is cut: its head fills the window, and its tail
is a piece of its own from then on. So padding is below ``SLACK`` ids a window for any lengths, but for the last window. The
pattern is used as often as its counts allow, which uses up some length. Pieces find their place from their rank among the pieces of their
length: the rank within a task, plus the number in the tasks before; tails follow behind all those. Which of two equally long pieces
comes first depends on how the input is partitioned.

Defined cases: a null or empty text is one piece of the end id alone; a very long text is encoded whole and cut at multiples of the window; repeated rows are packed one by one; an
empty table gives no pieces; further columns are left alone.
"""

from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemill.llm.common import key_back, stored, texts
from tidemill.llm.tokens import END, words

#: Ids of a window, and how many of them may stay free while there are pieces to cut.
WINDOW, SLACK = 2048, 8
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, nth long, ids binary"


def _fill(room: int, left: dict[int, int]) -> dict[int, int]:
    """Counts of lengths, within those left, whose sum is as near to the room as any and not above it."""
    made, steps = 1, []
    for length in sorted((x for x in left if x <= room), reverse=True):
        n, k = min(left[length], room // length), 1
        while n:
            k = min(k, n)
            steps.append((length, k, made))
            made |= (made << (length * k)) & ((2 << room) - 1)
            n, k = n - k, 2 * k
        if made >> room & 1:
            break
    total, used = made.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + k
            total -= length * k
    return used


def patterns(counts: dict[int, int], window: int = WINDOW, slack: int = SLACK) -> list[tuple[int, dict[int, int], tuple[int, int] | None]]:
    """(times, counts of lengths in one window, length of the piece to cut and of its head) until all pieces are placed."""
    left, out = {k: n for k, n in counts.items() if n}, []
    while left:
        longest = max(left)
        rest = {k: n - (k == longest) for k, n in left.items() if n > (k == longest)}
        used = _fill(window - longest, rest)
        used[longest] = used.get(longest, 0) + 1
        free, cut = window - sum(k * n for k, n in used.items()), None
        if free > slack and (longer := [k for k, n in left.items() if k > free and n > used.get(k, 0)]):
            cut = (min(longer), free)
        taken = used | ({cut[0]: used.get(cut[0], 0) + 1} if cut else {})
        times = min(left[k] // n for k, n in taken.items())
        out.append((times, used, cut))
        left = {k: m for k, n in left.items() if (m := n - times * taken.get(k, 0))}
        if cut:
            left[cut[0] - free] = left.get(cut[0] - free, 0) + times
    return out


class Place(NamedTuple):
    """Where pieces of one length go, from a rank on: n of them in a sequence, or cut in a head and a tail that has a rank among its length's."""

    first: int
    sequence: int
    n: int
    offset: int
    head: int = 0
    tail: int = 0
    tail_first: int = 0


def layout(found: list[tuple[int, dict[int, int], tuple[int, int] | None]], counts: dict[int, int]) -> dict[int, list[Place]]:
    """The places of each length's pieces, by rank."""
    out, sequence, rank, total = {}, 0, {}, dict(counts)
    for times, used, cut in found:
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            first = rank.get(length, 0)
            out.setdefault(length, []).append(Place(first, sequence, n, offset))
            rank[length], offset = first + times * n, offset + n * length
        if cut:
            length, head = cut
            first, tail = rank.get(length, 0), length - head
            out.setdefault(length, []).append(Place(first, sequence, 1, offset, head, tail, total.get(tail, 0)))
            rank[length], total[tail] = first + times, total.get(tail, 0) + times
        sequence += times
    return out


def _narrow(ids: memoryview) -> bytes:
    """Ids in two bytes each where that holds them all, else in four."""
    wide = np.frombuffer(ids, "<u4")
    return (wide.astype("<u2") if wide.max(initial=0) < 1 << 16 else wide).tobytes()


def _wide(held: bytes, length: int) -> bytes:
    return np.frombuffer(held, f"<u{len(held) // length}").astype("<u4").tobytes()


def _cut(path: str, window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, task = words(path).encode, END.to_bytes(4, "little"), TaskContext.get().partitionId()
        seen = [0] * (window + 1)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(x.as_py() for x in batch.column(1)), strict=True):
                ids = memoryview(ids + end)
                n = len(ids) // 4
                for at in range(0, n, window):
                    length = min(window, n - at)
                    own = ids[4 * at : 4 * (at + length)]
                    rows.append((doc, at, length, zlib.crc32(own), n, task, seen[length], _narrow(own) if with_ids or length < window else None))  # a whole window's piece is never cut
                    seen[length] += 1
                    if len(rows) == 4_000:
                        yield _batch(rows)
                        rows = []
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _PIECES.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    kinds = {"task": pa.int32(), "ids": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, cols, strict=True)], names=names)


_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _place(by_length: dict[int, list[Place]], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: ([x.first for x in v], v) for k, v in by_length.items()}
        names = [x.split()[0] for x in _PLACED.split(", ")]
        for batch in batches:
            rows = []
            for doc, start, length, crc, tokens, rank, held in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "ids")), strict=True):
                ids = None
                while True:
                    firsts, places = tables[length]
                    at = places[bisect_right(firsts, rank) - 1]
                    nth = rank - at.first
                    if ids is None and (at.head or with_ids):
                        ids = _wide(held, length)
                    if not at.head:
                        break
                    rows.append((doc, start, at.head, zlib.crc32(ids[: 4 * at.head]), tokens, at.sequence + nth, at.offset, ids[: 4 * at.head] if with_ids else None))
                    start, length, ids, rank = start + at.head, at.tail, ids[4 * at.head :], at.tail_first + nth
                    crc = zlib.crc32(ids)
                rows.append((doc, start, length, crc, tokens, at.sequence + nth // at.n, at.offset + nth % at.n * length, ids if with_ids else None))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, cols, strict=True)], names=names)

    return run


def pack(docs: DataFrame, path: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids themselves if asked for."""
    pieces = stored(texts(docs).mapInArrow(_cut(path, window, with_ids), _PIECES), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    by_task = stored(by_task.withColumn("before", before), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # as many rows as the window is long at most
    ranked = pieces.join(by_task.drop("n"), ["length", "task"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", (F.col("nth") + F.col("before")).alias("rank"))
    out = ranked.mapInArrow(_place(layout(patterns(counts, window), counts), with_ids), _PLACED).withColumn("doc_id", key_back(F.col("doc_id")))
    first = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return out.select(*first, *["ids"] * with_ids, "sequence_id", "offset")
