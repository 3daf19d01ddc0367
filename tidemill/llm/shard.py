"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, with DataFrame functions alone.

The ring has 2^16 cells. Each shard stands at ``virtual`` of them, and a row falls in the cell of its key's
hash and belongs to the next node clockwise. A shard takes no more rows than its bound; rows beyond it go on
clockwise to the next shards with room. Only the numbers of rows by cell (2^16 at most) reach the driver,
which plans ranges of ranks within cells; rows get their rank in their cell by a window over that cell
alone, so the largest sort is of one 65,536th of the rows. Cells that hold more than one row in ``PARTS``, as one
key with a third of all rows makes them, are ranked in so many parts each, whose sizes (``PARTS`` squared
at most) say where each part's ranks begin.

With bounds that differ by one row at most (``slack`` 0) the shards' counts do so too. With a slack of e,
the bound is (1 + e) times the mean, and adding a shard moves few rows beside those that it takes.

Defined cases: rows with a null key share a cell; null, empty and very long texts are only measured (the query's key is
the doc_id with its text's checksum, so rows that lack or share an id spread); repeated rows are placed one by one; an
empty table gives no rows; further columns are left alone.
"""

from bisect import bisect_left
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemill.llm.common import stored

CELLS = 1 << 16
#: Parts of a cell that holds more than one row in so many, and rows that a cell may always hold.
PARTS, FEW = 256, 1000
#: Types of the plan's columns.
_PLAN = "cell int, first long, last long, shard int, base long"


def _cell(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 48).cast("int")


def ring(spark, shards: int, virtual: int) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes in clockwise order. A shard's nodes don't depend on how many shards there are."""
    nodes = spark.range(shards * virtual, numPartitions=1).select(F.col("id"), _cell(F.concat_ws("/", F.lit("node"), F.col("id").cast("string"))).alias("cell"))
    return sorted((r["cell"], r["id"] // virtual) for r in nodes.collect())


def plan(counts: dict[int, int], nodes: list[tuple[int, int]], bounds: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, last rank + 1, shard, slot of the first): which rows of a cell go to which shard.

    In round r each cell offers what is left of it to the r-th shard clockwise, cells in order.
    """
    places = [c for c, _ in nodes]
    walks: dict[int, list[int]] = {}
    for i in range(len(nodes)):
        walks[i] = list(dict.fromkeys(s for _, s in nodes[i:] + nodes[:i]))
    left, room, used, out = dict(sorted(counts.items())), list(bounds), [0] * len(bounds), []
    done = dict.fromkeys(left, 0)
    for r in range(len(bounds)):
        for cell, n in left.items():
            if not n:
                continue
            s = walks[bisect_left(places, cell) % len(nodes)][r]
            if take := min(n, room[s]):
                out.append((cell, done[cell], done[cell] + take, s, used[s]))
                left[cell], done[cell], room[s], used[s] = n - take, done[cell] + take, room[s] - take, used[s] + take
    assert not any(left.values()), "the bounds are too small for all rows"
    return out


def _parts(placed: DataFrame, full: list[int]) -> tuple[DataFrame, Column]:
    """Adds _s_part, and gives the ranks of its cell that lie before a row's part. Cells that aren't full have one part."""
    if not full:
        return placed.withColumn("_s_part", F.lit(0)), F.lit(0).cast("long")
    part = F.pmod(F.xxhash64("_s_id"), F.lit(PARTS)).cast("int")
    placed = placed.withColumn("_s_part", F.when(F.col("_s_cell").isin(full), part).otherwise(0))
    sizes, begins, at = placed.filter(F.col("_s_cell").isin(full)).groupBy("_s_cell", "_s_part").agg(F.count("*").alias("n")).collect(), [], {}
    for r in sorted(sizes):
        begins.append((r["_s_cell"], r["_s_part"], at.get(r["_s_cell"], 0)))
        at[r["_s_cell"]] = at.get(r["_s_cell"], 0) + r["n"]
    begins = placed.sparkSession.createDataFrame(begins, "_s_cell int, _s_part int, _s_before long")
    return placed.join(F.broadcast(begins), ["_s_cell", "_s_part"], "left"), F.coalesce("_s_before", F.lit(0).cast("long"))


def assign(rows: DataFrame, key: Column, shards: int = 16, virtual: int = 256, slack: float = 0.0) -> DataFrame:
    """Adds shard and slot (gapless from 0 in each shard). The key decides the cell, a shard's bound the rest."""
    # The rows' own columns, of whatever names, lie in a struct meanwhile.
    placed = rows.select(F.struct("*").alias("row"), key.alias("_s_key")).withColumn("_s_hash", F.xxhash64("_s_key")).withColumn("_s_cell", F.shiftrightunsigned("_s_hash", 48).cast("int"))
    # Stored, so that a row's number is the same whenever it is read.
    placed = stored(placed.withColumn("_s_id", F.monotonically_increasing_id()), "shard-rows")
    counts = {r["_s_cell"]: r["n"] for r in placed.groupBy("_s_cell").agg(F.count("*").alias("n")).collect()}  # 2^16 rows at most
    total = sum(counts.values())
    even = [total // shards + (s < total % shards) for s in range(shards)]
    bounds = [max(ceil((1 + slack) * total / shards), even[s]) if slack else even[s] for s in range(shards)]
    ranges = plan(counts, ring(rows.sparkSession, shards, virtual), bounds)
    ranges = rows.sparkSession.createDataFrame(ranges, _PLAN).select(*(F.col(c).alias(f"_s_{c}") for c in ("cell", "first", "last", "shard", "base")))
    placed, before = _parts(placed, [c for c, n in counts.items() if n > max(FEW, total // PARTS)])
    rank = F.row_number().over(W.partitionBy("_s_cell", "_s_part").orderBy("_s_hash", "_s_key", "_s_id")).cast("long") - 1
    out = placed.withColumn("_s_rank", rank + before).join(F.broadcast(ranges), "_s_cell").filter((F.col("_s_rank") >= F.col("_s_first")) & (F.col("_s_rank") < F.col("_s_last")))
    return out.select("row.*", F.col("_s_shard").alias("shard"), (F.col("_s_base") + F.col("_s_rank") - F.col("_s_first")).alias("slot"))
