"""Islands: what a key's moments make when those at most a gap apart belong together."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemill.functions.times import bin_of, micros


def islands(rows: DataFrame, key: str, ts: str, gap: int) -> DataFrame:
    """key, started, ended (timestamps), n: the islands of each key, of moments at most ``gap`` seconds from the one before.

    Moments that fall in one time bin as wide as the gap always belong together. So bins are aggregated first, on the map side
    too, and only they are put in order: a key that holds a third of all rows brings a row per bin at most. Rows without a
    time are left out; a null key is a key.
    """
    at = micros(ts)
    wide = gap * 1_000_000
    bins = rows.filter(F.col(ts).isNotNull()).groupBy(F.col(key).alias("key"), bin_of(at, wide).alias("bin")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    order = W.partitionBy("key").orderBy("bin")
    new = F.coalesce((F.col("first") - F.lag("last").over(order) > wide).cast("int"), F.lit(1))
    found = bins.withColumn("new", new).withColumn("island", F.sum("new").over(order))
    out = found.groupBy("key", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return out.select(F.col("key").alias(key), F.timestamp_micros("first").alias("started"), F.timestamp_micros("last").alias("ended"), "n")


def transitions(rows: DataFrame, key: str, ts: str, timeout: int) -> DataFrame:
    """key, changed_at, status: a key starts working at the first moment of an island and is idle again ``timeout`` seconds after its last."""
    found = islands(rows, key, ts, timeout)
    idle = F.timestamp_micros(F.unix_micros("ended") + timeout * 1_000_000)
    both = F.inline(F.array(F.struct(F.col("started").alias("changed_at"), F.lit("working").alias("status")), F.struct(idle.alias("changed_at"), F.lit("idle").alias("status"))))
    return found.select(key, both)
