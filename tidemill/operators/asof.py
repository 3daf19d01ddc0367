"""As-of join: to each row the latest row of the other side that isn't after it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemill.functions.times import bin_of, micros


def asof_join(left: DataFrame, right: DataFrame, on: str, left_ts: str, right_ts: str, tie: str, bin_seconds: int = 86_400, within: int | None = None, prefix: str = "") -> DataFrame:
    """All rows and columns of left, with the columns of the last row of right that has the same ``on`` and is at the same time or earlier.

    tie: a column of right; of rows at one time the one with the largest value counts. within: how old a row may be, in seconds.
    prefix: before the names of right's columns. A null key or time on either side matches nothing; then the columns are null.

    Both sides are put in one order and the last row of right is carried forward. Keys are cut into time bins first, so one
    that holds a third of all rows is many groups: within a bin rows are carried by a running frame, and what goes from bin to
    bin is the last row of each, aggregated before the shuffle. There is no join by inequality.
    """
    wide = bin_seconds * 1_000_000
    names = [c for c in right.columns if c != on]
    payload = F.struct(*(F.col(c).alias(prefix + c) for c in names))
    a = left.select(F.struct("*").alias("_row"), F.col(on).alias("_key"), micros(left_ts).alias("_at"))
    b = right.select(payload.alias("_other"), F.col(on).alias("_key"), micros(right_ts).alias("_at"), F.col(tie).alias("_tie"))
    b = b.filter(F.col("_key").isNotNull() & F.col("_at").isNotNull())
    a, b = (df.withColumn("_bin", bin_of("_at", wide)) for df in (a, b))

    matched = a.filter(F.col("_key").isNotNull() & F.col("_at").isNotNull())
    both = matched.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    # Rows of right stand before rows of left of the same time.
    order = W.partitionBy("_key", "_bin").orderBy("_at", "_side", "_tie")
    found = F.struct("_at", "_other")
    carried = both.withColumn("_found", F.last(F.when(F.col("_side") == 0, found), ignorenulls=True).over(order)).filter("_side = 1").select("_row", "_key", "_at", "_bin", "_found")

    last = b.groupBy("_key", "_bin").agg(F.max_by(found, F.struct("_at", "_tie")).alias("_last"))
    every = last.unionByName(matched.select("_key", "_bin").distinct(), allowMissingColumns=True).groupBy("_key", "_bin").agg(F.first("_last", ignorenulls=True).alias("_last"))
    before = every.withColumn("_before", F.last("_last", ignorenulls=True).over(W.partitionBy("_key").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1))).select("_key", "_bin", "_before")

    out = carried.join(before, ["_key", "_bin"], "left").withColumn("_found", F.coalesce("_found", "_before"))
    if within is not None:
        out = out.withColumn("_found", F.when(F.col("_at") - F.col("_found._at") <= within * 1_000_000, F.col("_found")))
    rest = a.filter(F.col("_key").isNull() | F.col("_at").isNull()).select("_row", F.lit(None).cast(b.schema["_other"].dataType).alias("_other"))
    out = out.select("_row", F.col("_found._other").alias("_other")).unionByName(rest)
    return out.select("_row.*", *(F.col("_other")[prefix + c].alias(prefix + c) for c in names))
