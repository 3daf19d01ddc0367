"""Join of intervals that overlap."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.times import bin_of, micros

#: Microseconds of each level's bins: an hour, and 8 times the level before, as far as 64 bits go.
WIDTHS = [3600 * 1_000_000 * 8**k for k in range(11)]


def _level(length: Column) -> Column:
    """The first level whose bins are as wide as the interval is long."""
    out = F.lit(len(WIDTHS) - 1)
    for k in reversed(range(len(WIDTHS) - 1)):
        out = F.when(length <= WIDTHS[k], k).otherwise(out)
    return out.cast("int")


def _width(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WIDTHS)), level + 1)


def _binned(rows: DataFrame, side: str, on: str, start: str, end: str) -> DataFrame:
    out = rows.select(F.struct("*").alias(side), F.col(on).alias("_key"), micros(start).alias(f"{side}_from"), micros(end).alias(f"{side}_to"))
    # Nulls and empty intervals overlap nothing.
    return out.filter(F.col("_key").isNotNull() & (F.col(f"{side}_from") < F.col(f"{side}_to"))).withColumn(f"{side}_level", _level(F.col(f"{side}_to") - F.col(f"{side}_from")))


def _spread(rows: DataFrame, side: str, levels: list[int]) -> DataFrame:
    """A row for each bin that an interval touches, at its own level and at those wider ones that the other side has: two a level at most."""
    wanted = F.array_distinct(F.concat(F.array(F.col(f"{side}_level")), F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda x: x > F.col(f"{side}_level"))))
    rows = rows.withColumn("_level", F.explode(wanted))
    width = _width(F.col("_level"))
    return rows.withColumn("_bin", F.explode(F.sequence(bin_of(f"{side}_from", width), bin_of(F.col(f"{side}_to") - 1, width))))


def overlap_join(left: DataFrame, right: DataFrame, on: str, start: str, end: str, condition: Column | None = None) -> DataFrame:
    """a, b: the rows (as structs) of left and right with the same ``on`` whose intervals [start, end) overlap, each pair once.

    condition: of a and b, what pairs must also meet, before they are made rows. Intervals of a length fall into bins as wide as they are long, in levels
    that are 8 times wider each, so an interval has one or two bins at its level, however long it is. A
    pair meets at the wider of both levels, where the shorter interval has one or two bins too. Pairs that
    meet in two bins count in the one where both have begun. Intervals are compared exactly; bins are joined by equality, with
    the key, so many short intervals of one key are many groups.
    """
    a, b = _binned(left, "a", on, start, end), _binned(right, "b", on, start, end)
    found = a.select("a_level", F.lit(0).alias("s")).distinct().unionByName(b.select(F.col("b_level").alias("a_level"), F.lit(1).alias("s")).distinct()).collect()  # 11 levels a side at most
    has = [sorted({r["a_level"] for r in found if r["s"] == s}) for s in (0, 1)]
    a, b = _spread(a, "a", has[1]), _spread(b, "b", has[0])
    out = a.join(b, ["_key", "_level", "_bin"])
    out = out.filter((F.col("a_from") < F.col("b_to")) & (F.col("b_from") < F.col("a_to")) & (F.col("_level") == F.greatest("a_level", "b_level")) & (F.col("_bin") == bin_of(F.greatest("a_from", "b_from"), _width(F.col("_level")))))
    return (out if condition is None else out.filter(condition)).select("a", "b")
