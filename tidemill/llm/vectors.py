"""What the operators on vectors share: exact integer vectors, blocks of them, and cells where a batch of vectors meets blocks.

A vector's component x becomes floor(256 * x), x as double. Rows without an id take no part, nor do vectors that are
null or hold a null or non-finite component. Vectors of different lengths are compared as if zeros followed the
shorter one; components and scores that 64 bits can't hold are the nearest number that they can.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors of a block at most, and bytes that they take in a task.
BLOCK, BLOCK_BYTES = 2048, 4 << 20
#: Blocks that one cell reads at most on average.
CELL = 256
LEAST = np.iinfo(np.int64).min


def usable(rows: DataFrame, *more: str | Column) -> DataFrame:
    """vec_id, vec (array of long, without zeros at its end) and further columns of the rows that take part."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~odd)
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vec"), *more)
    last = F.array_max(F.transform("vec", lambda x, i: F.when(x != 0, i + 1).otherwise(0)))
    return kept.withColumn("vec", F.slice("vec", F.lit(1), F.coalesce(last, F.lit(0))))


def squared() -> Column:
    """A vector's squared length, about."""
    return F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def own_product() -> Column:
    """A vector's inner product with itself."""
    return F.when(squared() >= 9.2e18, F.lit(np.iinfo(np.int64).max)).otherwise(F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: s + x * x))


def best_first(score: str, vec_id: str) -> Column:
    """An aggregate: structs (down, vec_id) in order of rank; down is the score with all bits turned, which sorts the other way."""
    return F.sort_array(F.collect_list(F.struct(F.bitwise_not(score).alias("down"), F.col(vec_id).alias("vec_id"))))


def matrix(column: pa.Array) -> np.ndarray:
    """A row per vector, with zeros behind the shorter ones."""
    n = np.asarray(column.value_lengths(), np.int64)
    flat = np.asarray(column.flatten(), np.int64)
    width = int(n.max(initial=0))
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width), np.int64)
    out[np.arange(width) < n[:, None]] = flat
    return out


def lists(vectors: np.ndarray) -> pa.Array:
    """The vectors as ``usable`` has them: without zeros at their ends."""
    some = vectors != 0
    n = np.where(some.any(axis=1), vectors.shape[1] - some[:, ::-1].argmax(axis=1), 0) if vectors.shape[1] else np.zeros(len(vectors), np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(vectors[np.arange(vectors.shape[1]) < n[:, None]], pa.int64()))


def packed(vectors: np.ndarray) -> bytes:
    """The smallest integers that hold all components; ``unpacked`` finds their size from the length."""
    for kind in (np.int16, np.int32):
        if not vectors.size or (np.iinfo(kind).min <= vectors.min() and vectors.max() <= np.iinfo(kind).max):
            return vectors.astype(kind).tobytes()
    return vectors.tobytes()


def unpacked(data: bytes, n: int, width: int) -> np.ndarray:
    size = len(data) // max(1, n * width)
    return np.frombuffer(data, f"<i{size or 2}").reshape(n, width).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of both: by doubles while every partial sum is a whole number that they hold."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if width * most(a) * most(b) < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object) if width else np.zeros((len(a), len(b)), object)
    return np.clip(exact, LEAST, np.iinfo(np.int64).max).astype(np.int64)


def first_of(k: int, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the first k of each group by descending score, then id; in this order."""
    order = np.lexsort((ids, ~score, group))
    own = group[order]
    new = np.concatenate(([True], own[1:] != own[:-1])) if len(own) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0)) if len(own) else np.zeros(0, np.int64)
    return order[np.arange(len(own)) - first < k]


def pieces(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.Table]:
    """The rows of a task as tables of one block each, in order; ``block`` rows, or fewer of long vectors."""
    held, size = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            if not size:
                most = max(1, min(block, BLOCK_BYTES // (8 * max(1, len(batch.column("vec")[at])))))
            take = min(batch.num_rows - at, most - size)
            held.append(batch.slice(at, take))
            at, size = at + take, size + take
            if size == most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def column(table: pa.Table, name: str) -> pa.Array:
    own = table.column(name)
    return own.chunk(0) if own.num_chunks == 1 else own.combine_chunks()


def number(turn: int) -> int:
    """A number for the task's block of this turn, unlike those of all other tasks; what gets it is stored at once."""
    return TaskContext.get().partitionId() << 24 | turn


def parts_of(blocks: int, batches: int, tasks: int) -> int:
    """In how many cells a batch meets the blocks: as many as keep cells small and all tasks busy."""
    return max(1, -(-blocks // CELL), min(blocks, -(-2 * tasks // max(1, batches))))


def part_of(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts).cast("long")).cast("int")


def met(batches: DataFrame, blocks: DataFrame, order: Column | str) -> DataFrame:
    """Rows of cells (batch, part): the batch's own row (a null ``block``), then its blocks in order."""
    both = batches.unionByName(blocks, allowMissingColumns=True)
    return both.repartition("batch", "part").sortWithinPartitions("batch", "part", F.col("block").isNotNull(), order)


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(names)}
