"""Exact top-k search by inner product over a pivot-distance index.

Equal vectors are one vector with the ids of its k + 1 first rows, so copies of one vector, however many, are
compared once. A further coordinate gives all vectors one length, M, the greatest there is, and queries have a zero there:
then d(q, x)^2 = |q|^2 + M^2 - 2 <q, x>, so the highest products are the nearest vectors.

1. Pivots are chosen farthest first from a bounded sample (``SAMPLE`` distinct vectors, those with the smallest hashes).
   The sample decides only how much is pruned: every vector is keyed by its nearest pivot and its distance from it.
2. Vectors are range-partitioned and sorted by this key and cut into annuli: blocks of up to ``block`` vectors of one pivot, between two distances.
3. Each query starts from the annulus that holds its own vector, whose (k + 1)-th best product is its first bar.
4. Batches of queries are held against the annuli's bounds: a vector at distance d of a pivot from which the query is at distance e is at least
   |d - e| from the query, and a product is at most the product of both lengths. Only annuli that some query of the batch
   may need are sent to it.
5. Cells of a batch and some annuli run through these by falling bounds; bars rise as products are found,
   and what no bar admits is skipped. Bounds carry slack for rounding; products are exact.

Defined cases: see ``vectors`` for what takes no part; rows that repeat an id are rows of their own, and of those equal to a query in id and vector
one is the query itself; ties go to the smaller id; fewer rows than k give as many as there are; an empty table gives no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemill.llm.anchors import spread
from tidemill.llm.common import stored
from tidemill.llm.vectors import BLOCK, LEAST, best_first, column, first_of, lists, matrix, met, number, own_product, packed, part_of, parts_of, pieces, products, records, squared, unpacked, usable

PIVOTS, SAMPLE = 64, 4096
#: Annuli whose bounds one task compares with a batch together.
GROUP = 1024


class Space:
    """Distances from the pivots. most: the greatest squared length of all vectors."""

    def __init__(self, sample: np.ndarray, most: float):
        self.most = most
        self.of, self.more = sample.astype(np.float64), self.further(sample.astype(np.float64))
        chosen = [0] if len(sample) else []
        near = self.rows(sample, [0])[:, 0] if chosen else np.zeros(0)
        while len(chosen) < PIVOTS and near.max(initial=0) > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, self.rows(sample, [chosen[-1]])[:, 0])
        self.of, self.more = self.of[chosen], self.more[chosen]

    def further(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.most - (x * x).sum(axis=1)))

    def _squared(self, x: np.ndarray, which) -> np.ndarray:
        width = max(x.shape[1], self.of.shape[1])
        wide = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
        x, p = wide(x), wide(self.of if which is None else self.of[which])
        return (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * x @ p.T

    def rows(self, x: np.ndarray, which=None) -> np.ndarray:
        x = x.astype(np.float64)
        more = self.more if which is None else self.more[which]
        return np.sqrt(np.maximum(0, self._squared(x, which) + (self.further(x)[:, None] - more) ** 2))

    def queries(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, self._squared(x.astype(np.float64), None) + self.more**2))


class Bounds:
    """Upper bounds of the products of a batch of queries with the vectors of annuli."""

    def __init__(self, space: Space, x: np.ndarray):
        self.away, self.squared = space.queries(x), (x.astype(np.float64) ** 2).sum(axis=1)
        self.most = space.most
        # Of the squared distance, rounding may take this much.
        self.slack = 1e-9 * (self.squared + space.most) + 1

    def of(self, pivot: np.ndarray, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
        """A row per query, a column per annulus."""
        away = self.away[:, pivot]
        apart = np.maximum(0, np.maximum(low - away, away - high))
        by_distance = (self.squared + self.most)[:, None] - apart**2
        # Scores are no lower than the lowest number of 64 bits.
        return np.maximum(np.minimum(by_distance / 2, np.sqrt(self.squared)[:, None] * length) + self.slack[:, None], float(LEAST))


class Best:
    """The best rows of each query of a batch so far, and the bar that others must reach."""

    def __init__(self, k: int, bar: np.ndarray):
        self.k, self.bar = k, bar.copy()
        self.query = self.score = self.id = np.zeros(0, np.int64)

    def meet(self, which: np.ndarray, scores: np.ndarray, many: np.ndarray, ids: np.ndarray) -> None:
        """scores: of the queries ``which`` with a block's vectors; many, ids: ids of each vector."""
        bar = self.bar[which]
        if scores.shape[1] > self.k:
            bar = np.maximum(bar, np.partition(scores, -self.k, axis=1)[:, -self.k])
        query, vector = np.nonzero(scores >= bar[:, None])
        n, first = many[vector], (np.cumsum(many) - many)[vector]
        query, score, own = which[np.repeat(query, n)], np.repeat(scores[query, vector], n), ids[spread(first, n)]
        query, score, own = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, own)))
        best = first_of(self.k, query, score, own)
        self.query, self.score, self.id = query[best], score[best], own[best]
        full = np.bincount(self.query, minlength=len(self.bar)) == self.k
        last = np.full(len(self.bar), LEAST)
        last[self.query] = self.score  # the last of each query is its lowest
        self.bar = np.where(full, np.maximum(self.bar, last), self.bar)


_BLOCK = "block long, pivot int, low double, high double, length double, width int, vecs binary, many binary, ids binary, asked binary"


def _near(space, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, block):
            away = space.value.rows(matrix(column(table, "vec")))
            pivot = away.argmin(axis=1)
            table = table.append_column("pivot", pa.array(pivot, pa.int32())).append_column("away", pa.array(away[np.arange(len(away)), pivot], pa.float64()))
            yield from table.to_batches()

    return run


def _annuli(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for table in pieces(batches, block):
            pivot, away = (column(table, c).to_numpy() for c in ("pivot", "away"))
            ids, asked, vec = column(table, "ids"), np.asarray(column(table, "asked")), matrix(column(table, "vec"))
            edges = [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(pivot)]
            rows = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                many = np.asarray(ids[a:b].value_lengths(), np.int64)
                length = np.sqrt((vec[a:b].astype(np.float64) ** 2).sum(axis=1).max(initial=0))
                rows.append((number(turn), pivot[a], away[a:b].min(), away[a:b].max(), length, vec.shape[1], packed(vec[a:b]), many.astype("<i8").tobytes(), np.asarray(ids[a:b].flatten(), "<i8").tobytes(), asked[a:b].tobytes()))
                turn += 1
            kinds = [pa.int64(), pa.int32(), *[pa.float64()] * 3, pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _BLOCK.split(", ")])

    return run


def _held(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    many, ids = np.frombuffer(row["many"], "<i8"), np.frombuffer(row["ids"], "<i8")
    return unpacked(row["vecs"], len(many), row["width"]), many, ids


def _seeds(k: int):
    """The vectors that are asked for, with the bar that their own annulus sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in records(batches):
            vectors, many, ids = _held(row)
            which = np.flatnonzero(np.frombuffer(row["asked"], bool))
            if len(which):
                best = Best(k, np.full(len(which), LEAST))
                best.meet(np.arange(len(which)), products(vectors[which], vectors), many, ids)
                yield pa.RecordBatch.from_arrays([lists(vectors[which]), pa.array(best.bar, pa.int64())], names=["vec", "bar"])

    return run


def _batches(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, table in enumerate(pieces(batches, block)):
            vec = matrix(column(table, "vec"))
            row = [number(turn), vec.shape[1], packed(vec), column(table, "bar").to_numpy().astype("<i8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["batch", "query_width", "queries", "bars"])

    return run


def _asking(row: dict) -> tuple[np.ndarray, np.ndarray]:
    bar = np.frombuffer(row["bars"], "<i8")
    return unpacked(row["queries"], len(bar), row["query_width"]), bar


def _needed(space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in records(batches):
            x, bar = _asking(row)
            block, pivot, low, high, length = (np.array([m[c] for m in row["annuli"]]) for c in ("block", "pivot", "low", "high", "length"))
            bound = Bounds(space.value, x).of(pivot, low, high, length)
            bound = np.where(bound >= bar[:, None], bound, -np.inf).max(axis=0)
            keep = bound > -np.inf
            n = int(keep.sum())
            yield pa.RecordBatch.from_arrays([pa.array([row["batch"]] * n, pa.int64()), pa.array(block[keep], pa.int64()), pa.array(bound[keep], pa.float64())], names=["batch", "block", "bound"])

    return run


def _expand(space, k: int):
    def done(x: np.ndarray, best: Best) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([lists(x[best.query]), pa.array(best.score, pa.int64()), pa.array(best.id, pa.int64())], names=["vec", "score", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for row in records(batches):
            if row["block"] is None:
                if best:
                    yield done(x, best)
                x, bar = _asking(row)
                bounds, best = Bounds(space.value, x), Best(k, bar)
            elif row["bound"] >= best.bar.min(initial=np.iinfo(np.int64).max):
                edge = [np.array([row[c]]) for c in ("pivot", "low", "high", "length")]
                which = np.flatnonzero(bounds.of(*edge)[:, 0] >= best.bar)
                if len(which):
                    vectors, many, ids = _held(row)
                    best.meet(which, products(x[which], vectors), many, ids)
        if best:
            yield done(x, best)

    return run


def search(rows: DataFrame, asks: Column, k: int = 5, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: of each row for which ``asks`` (of vec_id) holds, the k rows of all others with the highest integer inner products. block: vectors of an annulus, and queries of a batch."""
    spark, usual = rows.sparkSession, usable(rows)
    tasks = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = usual.filter(F.coalesce(asks, F.lit(False)))
    # As many rows of a vector as a result may need: Spark drops the others before the shuffle.
    first = usual.withColumn("_r", F.row_number().over(W.partitionBy("vec").orderBy("vec_id"))).filter(F.col("_r") <= k + 1)
    distinct = first.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = distinct.join(asked.select("vec", F.lit(True).alias("asked")).distinct(), "vec", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    distinct = stored(distinct, "vectors")

    most = distinct.agg(F.max(squared())).first()[0] or 0.0
    sample = distinct.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).toArrow()
    space = spark.sparkContext.broadcast(Space(matrix(column(sample, "vec")), most))

    keyed = distinct.mapInArrow(_near(space, block), "vec array<long>, ids array<long>, asked boolean, pivot int, away double")
    ordered = keyed.repartitionByRange(tasks, "pivot", "away", F.xxhash64("vec")).sortWithinPartitions("pivot", "away")
    blocks = stored(ordered.mapInArrow(_annuli(block), _BLOCK), "annuli")
    seeds = stored(blocks.mapInArrow(_seeds(k + 1), "vec array<long>, bar long"), "seeds")
    n = seeds.count()
    batches = stored(seeds.repartition(max(1, -(-n // block))).mapInArrow(_batches(block), "batch long, query_width int, queries binary, bars binary"), "asking")

    n_blocks, n_batches = blocks.count(), batches.count()
    parts, groups = parts_of(n_blocks, n_batches, tasks), max(1, -(-n_blocks // GROUP))
    edges = blocks.select(part_of("block", groups).alias("group"), F.struct("block", "pivot", "low", "high", "length").alias("edge")).groupBy("group").agg(F.collect_list("edge").alias("annuli"))
    pairs = batches.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(edges, "group").select("batch", "queries", "query_width", "bars", "annuli")
    pairs = stored(pairs.mapInArrow(_needed(space), "batch long, block long, bound double").withColumn("part", part_of("block", parts)), "needed")
    there = pairs.join(blocks.drop("asked"), "block")
    own = batches.join(pairs.select("batch", "part").distinct(), "batch")
    found = met(own, there, F.desc("bound")).mapInArrow(_expand(space, k + 1), "vec array<long>, score long, found long")

    best = found.withColumn("_r", F.row_number().over(W.partitionBy("vec").orderBy(F.desc("score"), "found"))).filter(F.col("_r") <= k + 1)
    best = best.groupBy("vec").agg(best_first("score", "found").alias("best"))
    out = asked.select(F.col("vec_id").alias("query_id"), "vec").join(best, "vec")
    at = F.array_position("best", F.struct(F.bitwise_not(own_product()).alias("down"), F.col("query_id").alias("vec_id")))
    out = out.withColumn("best", F.slice(F.filter("best", lambda x, i: i + 1 != at), 1, k))
    return out.select("query_id", F.posexplode("best").alias("rank", "_b")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("_b.vec_id").alias("vec_id"), F.bitwise_not("_b.down").alias("score"))
