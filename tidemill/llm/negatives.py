"""Hard negatives for contrastive training, by a secondary-sort shuffle.

Anchors and rows are packed into blocks, and cells of a batch of anchors and some blocks compute exact integer products.

1. Positives: each cell keeps an anchor's first rows of its own label, and the first of all cells are its positives.
2. Negatives: each cell knows its anchors' positives, so it keeps the first rows of other labels within each
   positive's window; what isn't among a cell's first can't be among all cells' first.
3. Positives and what the cells keep become records with packed keys: anchor, descending score, positive before negative, id, as
   big-endian bytes. ``repartitionAndSortWithinPartitions`` brings each anchor's records together in order, and
   an iterator streams over them: a positive opens its window, negatives are emitted as they come and a window that is
   full passes over the rest. It holds an anchor's open windows, never its records.

Defined cases: see ``vectors`` for what takes no part, and rows with a null label don't either; rows that repeat an id are rows of their own, and
of those equal to an anchor in id, label and vector one is the anchor itself; ties go to the smaller id; a positive with a negative product has no negatives, as
its window is empty; fewer rows than asked for give as many as there are; an empty table gives no rows.
"""

from collections.abc import Iterator
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemill.llm.common import stored
from tidemill.llm.vectors import BLOCK, LEAST, best_first, column, first_of, lists, matrix, met, number, own_product, packed, part_of, parts_of, pieces, products, records, unpacked, usable

#: A negative's score lies between these hundredths of its positive's.
LOW, HIGH = 50, 95
_KEY = struct.Struct(">QQBQ")
_SIGN = 1 << 63
_HELD = "ids binary, labels binary, vecs binary, width int"


def _blocks(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, table in enumerate(pieces(batches, block)):
            ids = column(table, "vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            vec = matrix(column(table, "vec"))[order]
            row = [number(turn), ids[order].astype("<i8").tobytes(), column(table, "label").to_numpy()[order].astype("<i8").tobytes(), packed(vec), vec.shape[1]]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), *[pa.binary()] * 3, pa.int32()), strict=True)], names=["block", "ids", "labels", "vecs", "width"])

    return run


def _held(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels"))
    return ids, labels, unpacked(row["vecs"], len(ids), row["width"])


class _Firsts:
    """The first k rows of each of some groups, over all blocks of a cell."""

    def __init__(self, k: int):
        self.k = k
        self.group = self.score = self.id = np.zeros(0, np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        group, score, ids = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.id, ids)))
        best = first_of(self.k, group, score, ids)
        self.group, self.score, self.id = group[best], score[best], ids[best]


def _tops(allowed: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k highest allowed scores of each row, and of all that equal the last of them."""
    held = np.where(allowed, scores, LEAST)
    if scores.shape[1] > k:
        bar = np.partition(held, -k, axis=1)[:, -k]
        allowed = allowed & (held >= bar[:, None])
    return np.nonzero(allowed)


def _positives(k: int):
    def done(batch: int, best: _Firsts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(best.id), batch), pa.int64()), *(pa.array(x, pa.int64()) for x in (best.group, best.score, best.id))], names=["batch", "nth", "score", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for row in records(batches):
            if row["block"] is None:
                if best:
                    yield done(batch, best)
                batch, best = row["batch"], _Firsts(k)
                _, label, x = _held(row)
            else:
                ids, labels, y = _held(row)
                scores = products(x, y)
                i, j = _tops(label[:, None] == labels, scores, k)
                best.add(i, scores[i, j], ids[j])
        if best:
            yield done(batch, best)

    return run


def key(anchor: int, score: int, positive: bool, vec_id: int) -> bytes:
    """Sorts by anchor, descending score, positives before negatives, id."""
    return _KEY.pack(anchor, _SIGN - 1 - score, not positive, vec_id + _SIGN)


def unkeyed(data: bytes) -> tuple[int, int, bool, int]:
    anchor, down, negative, vec_id = _KEY.unpack(data)
    return anchor, _SIGN - 1 - down, not negative, vec_id - _SIGN


def _negatives(k: int, most: int):
    """Keys and numbers of positives' windows, for the first k rows in the window of each of an anchor's positives, ``most`` at most."""

    def done(batch: int, best: _Firsts) -> pa.RecordBatch:
        anchor = (batch << 12) + best.group // most
        keys = [key(a, s, False, i) for a, s, i in zip(anchor.tolist(), best.score.tolist(), best.id.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(best.group % most, pa.int32())], names=["key", "nth"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for row in records(batches):
            if row["block"] is None:
                if best:
                    yield done(batch, best)
                batch, best = row["batch"], _Firsts(k)
                _, label, x = _held(row)
                windows = np.full((len(label), most), LEAST)
                for p in row["positives"] or ():
                    windows[p["anchor"], p["nth"]] = p["score"]
            else:
                ids, labels, y = _held(row)
                scores = products(x, y)
                others = label[:, None] != labels
                for nth in range(most):
                    own = windows[:, nth]
                    # Whole numbers n with LOW * p <= 100 * n <= HIGH * p; none for negative p.
                    low = np.where(own < 0, 1, own // 100 * LOW + (own % 100 * LOW + 99) // 100)
                    high = np.where(own < 0, 0, own // 100 * HIGH + own % 100 * HIGH // 100)
                    some = np.flatnonzero(low <= high)
                    if len(some):
                        inside = others[some] & (scores[some] >= low[some, None]) & (scores[some] <= high[some, None])
                        i, j = _tops(inside, scores[some], k)
                        best.add(some[i] * most + nth, scores[some[i], j], ids[j])
        if best:
            yield done(batch, best)

    return run


def emitted(records: Iterator[tuple[bytes, int]], k: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """anchor, positive, rank, negative and both scores, from sorted records; at most an anchor's open windows are held."""
    of, windows = None, {}
    for data, nth in records:
        anchor, score, positive, vec_id = unkeyed(data)
        if anchor != of:
            of, windows = anchor, {}
        if positive:
            windows[nth] = [vec_id, score, 0]
        elif nth in windows:
            window = windows[nth]
            window[2] += 1
            if window[2] <= k:
                yield anchor, window[0], window[2], vec_id, window[1], score
            else:
                del windows[nth]


def mine(rows: DataFrame, label: Column, asks: Column, positives: int = 5, negatives: int = 3, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    label: of columns of rows; asks: whether a row (vec_id) is an anchor; block: rows of a block, 4,096 at most.
    """
    spark = rows.sparkSession
    tasks = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    labelled = usable(rows, label.cast("long").alias("label")).filter("label is not null")
    anchors = labelled.filter(F.coalesce(asks, F.lit(False)))
    blocks = stored(labelled.mapInArrow(_blocks(block), f"block long, {_HELD}"), "blocks")
    n_anchors, n_blocks = anchors.count(), blocks.count()
    batches = anchors.repartition(max(1, -(-n_anchors // block))).mapInArrow(_blocks(block), f"block long, {_HELD}")
    batches = stored(batches.withColumnRenamed("block", "batch"), "anchors")
    n_batches = batches.count()
    parts = parts_of(n_blocks, n_batches, tasks)
    cells = batches.select("batch", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    there = cells.join(blocks.withColumn("part", part_of("block", parts)), "part")

    found = met(batches.join(cells, "batch"), there, "block").mapInArrow(_positives(positives + 1), "batch long, nth long, score long, found long")
    best = found.withColumn("_r", F.row_number().over(W.partitionBy("batch", "nth").orderBy(F.desc("score"), "found"))).filter(F.col("_r") <= positives + 1)
    best = best.groupBy("batch", "nth").agg(best_first("score", "found").alias("best"))
    # The anchor itself is one of its label's rows, and goes.
    own = batches.mapInArrow(_anchors, "batch long, nth long, anchor_id long, vec array<long>")
    best = own.withColumn("down", F.bitwise_not(own_product())).drop("vec").join(best, ["batch", "nth"])
    at = F.array_position("best", F.struct("down", F.col("anchor_id").alias("vec_id")))
    best = best.select("batch", "nth", "anchor_id", F.slice(F.filter("best", lambda x, i: i + 1 != at), 1, positives).alias("best"))
    best = stored(best.select("batch", F.col("nth").alias("anchor"), "anchor_id", F.posexplode("best").alias("nth", "_b")).select("batch", "anchor", "anchor_id", "nth", F.bitwise_not("_b.down").alias("score"), F.col("_b.vec_id").alias("vec_id")), "positives")

    by_batch = best.groupBy("batch").agg(F.collect_list(F.struct("anchor", "nth", "score")).alias("positives"))  # a batch's anchors are 2,048 or few more
    kept = met(batches.join(by_batch, "batch", "left").join(cells, "batch"), there, "block").mapInArrow(_negatives(negatives, positives), "key binary, nth int")
    sent = best.select(((F.col("batch") * 4096) + F.col("anchor")).alias("anchor"), "score", "vec_id", F.col("nth").cast("int").alias("nth")).mapInArrow(_keyed, "key binary, nth int").unionByName(kept)
    parted = sent.rdd.map(lambda r: (bytes(r[0]), r[1])).repartitionAndSortWithinPartitions(tasks, lambda k: zlib.crc32(k[:8]))
    out = parted.mapPartitions(lambda part: emitted(part, negatives))
    out = spark.createDataFrame(out, "anchor long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    named = best.select(((F.col("batch") * 4096) + F.col("anchor")).alias("anchor"), "anchor_id").distinct()
    return out.join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per anchor of the batches."""
    for row in records(batches):
        ids, _, vec = _held(row)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["batch"]), pa.int64()), pa.array(np.arange(len(ids)), pa.int64()), pa.array(ids, pa.int64()), lists(vec)], names=["batch", "nth", "anchor_id", "vec"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [key(a, s, True, i) for a, s, i in zip(*(batch.column(c).to_pylist() for c in ("anchor", "score", "vec_id")), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column("nth")], names=["key", "nth"])
