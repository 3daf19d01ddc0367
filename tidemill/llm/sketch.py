"""Count-min sketches of hashes over a whole table, built by tasks, merged by ranges of cells.

A task's sketch is sparse: its cells that aren't 0. Ranges of 2^20 cells are merged apart from each other, in
two steps, so that no group gathers more than 64 tasks' share or the results of the first step. What comes
to the driver and is broadcast are two bits a cell: whether its sum is 2 or more, and whether it is ``HOT`` or
more. ``cells`` is bounded by ``MOST_BITS`` (2 rows of 2^29 cells: 256 MB in all). Sums only overestimate, so a
hash that occurs twice is always estimated as repeated; over some 10^9 hashes the sketch fills up and rules
out less, which costs time and changes no result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.anchors import groups

ROWS = (0xC2B2AE3D27D4EB4F, 0x9E3779B185EBCA87)
MOST_BITS, RANGE_BITS = 29, 20
HOT = 20_000
_FLUSH = 1 << 20
_SPARSE = "shard int, part int, cells binary, sums binary"


def bits_for(hashes: float) -> int:
    """Bits of a row: four cells a hash, within bounds."""
    return min(MOST_BITS, max(16, int(4 * hashes).bit_length()))


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (hashes * np.uint64(ROWS[row]) >> np.uint64(64 - bits)).astype(np.int64)


class TaskSketch:
    """Takes a task's hashes; gives rows of its sketch now and then, and the rest at the end."""

    def __init__(self, bits: int):
        self.bits, self.held, self.n, self.part = bits, [], 0, TaskContext.get().partitionId() // 64

    def add(self, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(hashes)
        self.n += len(hashes)
        if self.n >= _FLUSH:
            yield self.rows()

    def rows(self) -> pa.RecordBatch:
        hashes = np.concatenate(self.held or [np.zeros(0, np.uint64)])
        self.held, self.n = [], 0
        out = []
        for row in range(len(ROWS)):
            cells, sums = np.unique(_cells(hashes, row, self.bits), return_counts=True)
            shard = cells >> RANGE_BITS
            for a, b in groups(shard):
                offset = (cells[a:b] & ((1 << RANGE_BITS) - 1)).astype("<u4")
                out.append((row << 16 | int(shard[a]), self.part, offset.tobytes(), np.minimum(sums[a:b], 0xFFFF).astype("<u2").tobytes()))
        return _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["shard", "part", "cells", "sums"])


def _sums(table: pa.Table) -> np.ndarray:
    total = np.zeros(1 << RANGE_BITS, np.uint32)
    for cells, sums in zip(table.column("cells").to_pylist(), table.column("sums").to_pylist(), strict=True):
        total[np.frombuffer(cells, "<u4")] += np.frombuffer(sums, "<u2")  # a row's cells differ
    return total


def _merge(table: pa.Table) -> pa.Table:
    total = _sums(table)
    cells = np.flatnonzero(total)
    row = (table.column("shard")[0].as_py(), 0, cells.astype("<u4").tobytes(), np.minimum(total[cells], 0xFFFF).astype("<u2").tobytes())
    return pa.Table.from_batches([_batch([row])])


def _bitmaps(table: pa.Table) -> pa.Table:
    total = _sums(table)
    row = (table.column("shard")[0].as_py(), 0, np.packbits(total >= 2, bitorder="little").tobytes(), np.packbits(total >= HOT, bitorder="little").tobytes())
    return pa.Table.from_batches([_batch([row])])


class Estimate:
    """The merged sketch: which hashes may occur twice, and which very often."""

    def __init__(self, sparse: DataFrame, bits: int):
        """sparse: the rows of all tasks' sketches."""
        merged = sparse.groupBy("shard", "part").applyInArrow(_merge, _SPARSE).groupBy("shard").applyInArrow(_bitmaps, _SPARSE)
        size = max(1, 1 << bits >> 3)
        self.bits = bits
        self.twice, self.hot = (np.zeros((len(ROWS), size), np.uint8) for _ in range(2))
        for r in merged.select("shard", F.col("cells").alias("a"), F.col("sums").alias("b")).toLocalIterator():  # 2^29 cells a row at most
            row, at = r["shard"] >> 16, (r["shard"] & 0xFFFF) << RANGE_BITS >> 3
            for to, have in ((self.twice, r["a"]), (self.hot, r["b"])):
                have = np.frombuffer(have, np.uint8)[: size - at]
                to[row, at : at + len(have)] = have
        if not self.hot.any():
            self.hot = self.hot[:, :0]

    def _least(self, bitmaps: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        if not bitmaps.shape[1]:
            return ~out
        for row in range(len(ROWS)):
            cell = _cells(hashes, row, self.bits)
            out &= (bitmaps[row][cell >> 3] >> (cell & 7) & 1).astype(bool)
        return out

    def repeated(self, hashes: np.ndarray) -> np.ndarray:
        return self._least(self.twice, hashes)

    def very_common(self, hashes: np.ndarray) -> np.ndarray:
        return self._least(self.hot, hashes)


SCHEMA = _SPARSE
