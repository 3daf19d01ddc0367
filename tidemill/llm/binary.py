"""Token ids in a compressed binary format, in ascending order of document id, and back.

Documents are dealt by ranges of doc_id and sorted, so tables of any size are written in order with no task
holding more than one block of ids. A block holds whole documents, about ``block`` ids (one long document
makes a larger block), and is coded by itself; see ``rangecoder``. The blocks are rows of a Spark table, so
they can lie in any store.

Defined cases: a null or empty text is the end id alone; a very long text makes one large block; rows that repeat a doc_id are written one after the
other, ordered by a hash of the text; an empty table gives no blocks; further columns are left alone. A
damaged block raises an error.
"""

from collections.abc import Iterator
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemill.llm.common import key_back, stored, texts
from tidemill.llm.rangecoder import pack_block, unpack_block
from tidemill.llm.tokens import END, words

VOCABULARY = 49408
BLOCK = 1 << 21
#: A broadcast of so many parts takes some 50 MB at most.
MOST_BROADCAST = 1_000_000
_BLOCKS = "part int, block int, before long, n_tokens long, payload binary"
_DOCS = "part int, doc_id long, at long, n_tokens long, ids_crc32 long"


def _write(path: str, vocabulary: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, part = words(path).encode, END.to_bytes(4, "little"), TaskContext.get().partitionId()
        docs, sizes, held, n, number, before = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            payload = pack_block(docs, sizes, np.frombuffer(b"".join(held), "<u4"), vocabulary)
            cols = [pa.array([x], t) for x, t in ((part, pa.int32()), (number, pa.int32()), (before, pa.int64()), (n, pa.int64()), (payload, pa.binary()))]
            return pa.RecordBatch.from_arrays(cols, names=["part", "block", "before", "n_tokens", "payload"])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encode(x.as_py() for x in batch.column(1)), strict=True):
                docs.append(doc)
                sizes.append(len(ids) // 4 + 1)
                held.append(ids + end)
                n += sizes[-1]
                if n >= block:
                    yield flush()
                    before, number = before + n, number + 1
                    docs, sizes, held, n = [], [], [], 0
        if docs:
            yield flush()

    return run


def write_ids(docs: DataFrame, path: str, vocabulary: int = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """The table of blocks: part, block, before (ids of the part before it), n_tokens, payload."""
    rows = texts(docs).withColumn("_h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").drop("_h")
    return stored(ordered.mapInArrow(_write(path, vocabulary, block), _BLOCKS), "token-blocks")


def _read(vocabulary: int, with_ids: bool):
    names = [x.split()[0] for x in _DOCS.split(", ")] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, payload in zip(*(batch.column(k).to_pylist() for k in ("part", "before", "payload")), strict=True):
                docs, sizes, ids = unpack_block(payload, vocabulary)
                to = np.cumsum(np.array(sizes, np.int64))
                raw = memoryview(ids.tobytes())
                cuts = [raw[4 * (b - n) : 4 * b] for b, n in zip(to.tolist(), sizes, strict=True)]
                cols = [pa.array(np.full(len(docs), part, np.int32)), pa.array(docs, pa.int64()), pa.array(before + to - sizes), pa.array(sizes, pa.int64())]
                cols.append(pa.array([zlib.crc32(x) for x in cuts], pa.int64()))
                if with_ids:
                    cols.append(pa.array([bytes(x) for x in cuts], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def read_ids(blocks: DataFrame, vocabulary: int = VOCABULARY, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, unless they aren't wanted, the ids
    (unsigned 32-bit, little-endian) of each document, all decoded from the blocks."""
    # A row per part: there are as many as partitions that wrote them, which is counted before they are broadcast.
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    parts = parts.select("part", base.alias("base"))
    parts = F.broadcast(parts) if blocks.select("part").distinct().limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else parts
    out = blocks.select("part", "before", "payload").mapInArrow(_read(vocabulary, with_ids), _DOCS + ", ids binary" * with_ids).join(parts, "part")
    return out.select(key_back(F.col("doc_id")).alias("doc_id"), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
