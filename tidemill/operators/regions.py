"""Join of points with the regions that they lie in."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells are 2^level wide, for these levels; a region's are those of which 16 are at least as wide and high as it is.
LEVELS = range(0, 29, 2)
#: Edges that a region may have to be covered and compared by columns; those with more go by functions of arrays, which aren't compiled. More would make planning slow.
FEW = 4
#: Partitions for each core in which regions are covered, as a file of few regions would be one task.
SPREAD = 4
_ENDS = ("x1", "y1", "x2", "y2")


def _west(x: Column, y: Column, e) -> Column:
    """Whether the point is to the west of the edge's line; in whole numbers, so exact below 2^30. Edges go from north to south."""
    return (x - e["x1"]) * (e["y2"] - e["y1"]) < (y - e["y1"]) * (e["x2"] - e["x1"])


def _crossed(x: Column, y: Column, e) -> Column:
    """Whether a ray from the point to the east crosses the edge."""
    return (e["y1"] <= y) & (y < e["y2"]) & _west(x, y, e)


def _columns(i: int) -> dict[str, Column]:
    """The edge whose ends are the columns of that number."""
    return {k: F.col(f"{k}_{i}") for k in _ENDS}


def _boxed(regions: DataFrame, ring: str) -> DataFrame:
    """b (the region), edges, the ends of its box, and the level of its cells."""
    # Each corner is the start of an edge to the next one, and the last one's goes to the first.
    following = lambda i: F.get(F.col("ring"), (i + 1) % F.size("ring"))
    end = lambda p, q, a, b, k: F.when(p["y"] <= q["y"], a[k]).otherwise(b[k]).cast("long")
    edge = lambda p, q: F.struct(*(end(p, q, *ab, k).alias(f"{k}{n}") for n, ab in ((1, (p, q)), (2, (q, p))) for k in "xy"))
    out = regions.select(F.struct("*").alias("b"), F.col(ring).alias("ring"))
    whole = (F.size("ring") >= 3) & ~F.exists("ring", lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull())
    out = out.filter(F.coalesce(whole, F.lit(False))).withColumn("edges", F.transform("ring", lambda p, i: edge(p, following(i))))
    for c in "xy":
        ends = F.transform("ring", lambda p: p[c].cast("long"))  # noqa: B023
        out = out.withColumns({f"{c}_low": F.array_min(ends), f"{c}_high": F.array_max(ends)})
    wide = F.greatest(F.col("x_high") - F.col("x_low"), F.col("y_high") - F.col("y_low"))
    level = F.lit(LEVELS[-1])
    for k in reversed(LEVELS[:-1]):
        level = F.when(wide <= 16 << k, k).otherwise(level)
    return out.withColumn("level", level.cast("int")).drop("ring")


def _covered(boxed: DataFrame, few: int) -> DataFrame:
    """b, level, cx, cy for each cell in which the region may have a place, 289 at most; the edges to compare there, which are none in a cell inside
    the region; and odd, whether a ray from any place in the cell crosses an odd number of the others. Edges are columns, or an array where few is 0."""
    cells = lambda c: F.explode(F.sequence(F.expr(f"shiftright({c}_low, level)"), F.expr(f"shiftright({c}_high, level)")))
    ends = {f"{k}_{i}": F.coalesce(F.get("edges", F.lit(i))[k], F.lit(0)) for i in range(few) for k in _ENDS}
    boxed = boxed.withColumns(ends).drop("edges") if few else boxed
    out = boxed.withColumn("cx", cells("x")).withColumn("cy", cells("y"))
    west, north, wide = (F.expr(f"shiftleft({c}, level)") for c in ("cx", "cy", "1L"))
    east, south = west + wide - 1, north + wide - 1
    # The edge's rows in the cell are from the first to the last: there its line, and so the ray's crossing, is judged.
    first = lambda e: F.greatest(north, e["y1"])
    last = lambda e: F.least(south, e["y2"] - 1)
    some = lambda e: (first(e) <= last(e)) & (_west(west, first(e), e) | _west(west, last(e), e))
    every = lambda e: (e["y1"] <= north) & (south < e["y2"]) & _west(east, north, e) & _west(east, south, e)
    at = ("b", "level", "cx", "cy")
    if few:
        found = {f"{w}_{i}": f(_columns(i)) for i in range(few) for w, f in (("some", some), ("every", every))}
        out = out.withColumns(found).filter(reduce(lambda a, i: a | F.col(f"some_{i}"), range(few), F.lit(False)))
        odd = reduce(lambda a, i: a != F.col(f"every_{i}"), range(few), F.lit(False))
        rest = {f"{k}_{i}": F.when(F.col(f"some_{i}") & ~F.col(f"every_{i}"), F.col(f"{k}_{i}")).otherwise(0) for i in range(few) for k in _ENDS}
        left = reduce(lambda a, i: a | F.col(f"some_{i}") & ~F.col(f"every_{i}"), range(few), F.lit(False))
        return out.filter(odd | left).select(*at, odd.alias("odd"), *(c.alias(k) for k, c in rest.items()))
    # Exploded with one element: what functions of arrays give is worked out once, not again wherever it is named.
    found = F.filter("edges", some)
    out = out.select(*at, F.explode(F.array(F.struct(found.alias("all"), F.filter(found, lambda e: ~every(e)).alias("rest")))).alias("e"))
    return out.select(*at, ((F.size("e.all") - F.size("e.rest")) % 2 == 1).alias("odd"), F.col("e.rest").alias("rest")).filter(F.col("odd") | (F.size("rest") > 0))


def within_join(points: DataFrame, regions: DataFrame, x: str = "x", y: str = "y", ring: str = "ring") -> DataFrame:
    """a, b: the rows (as structs) of points and of the regions that they lie in, each pair once.

    x and y are whole numbers, ring an array of structs of x and y, all within 2^30 of 0: a region's corners in order, open or closed. A point is
    inside if a line from it to the east crosses the ring an odd number of times; one on the western or northern edge (y grows to the south) of
    a rectangle is inside, one on the others isn't, so regions that share an edge share no points. Nulls, rings that hold nulls and rings of fewer than three corners match nothing.

    Regions are covered by cells of a level that goes by their size, 289 at most, and joined with points by equality of cells. A cell carries the edges
    that a ray from it may cross or not: none in cells inside the region, so only near edges points are compared, exactly. A point is looked up once
    per level that regions have and found in one cell of each, so no pair comes twice, and pairs, which are the result, aren't shuffled.
    """
    boxed = _boxed(regions, ring)
    sizes = boxed.groupBy("level").agg(F.max(F.size("edges")).alias("n")).collect()  # as many as LEVELS at most
    kept = points.select(F.struct("*").alias("a"), F.col(x).cast("long").alias("px"), F.col(y).cast("long").alias("py")).filter("px is not null and py is not null")
    kept = kept.withColumn("level", F.explode(F.array(*(F.lit(r["level"]) for r in sizes)).cast("array<int>")))
    kept = kept.withColumns({"cx": F.expr("shiftright(px, level)"), "cy": F.expr("shiftright(py, level)")})
    most, at = max((r["n"] for r in sizes), default=0), (F.col("px"), F.col("py"))
    boxed = boxed.repartition(SPREAD * points.sparkSession.sparkContext.defaultParallelism)
    # A cover is many times larger than its regions, by whose size it would be broadcast.
    join = lambda cells, inside: kept.hint("merge").join(cells, ["level", "cx", "cy"]).filter(inside).select("a", "b")
    few = max(3, min(FEW, most))
    odd = reduce(lambda odd, i: odd != _crossed(*at, _columns(i)), range(few), F.col("odd"))
    small = join(_covered(boxed.filter(F.size("edges") <= few) if most > few else boxed, few), odd)
    if most <= few:
        return small
    many = F.size(F.filter("rest", lambda e: _crossed(*at, e))) % 2 == 1
    return small.unionByName(join(_covered(boxed.filter(F.size("edges") > few), 0), F.col("odd") != many))
