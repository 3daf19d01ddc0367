"""Outages: from a key's first failed response to the next one that isn't."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemill.functions.times import bin_of, micros


def outages(rows: DataFrame, key: str, ts: str, down: Column, bin_seconds: int = 86_400) -> DataFrame:
    """key, started, ended, n: the outages of each key, in order of its rows' times.

    down: whether a row failed; null counts as failed. A moment is down if all of the key's rows at it are. An outage starts at the first moment that is down and ends
    at the next one that isn't; ended is null if there is none yet. n: failed rows at its moments. Rows without a time are left out; a null key is a key.

    Keys are cut into time bins, so one that holds a third of all rows is many groups. What goes from bin to bin (the last
    state, failures so far, the next change) is aggregated to a row per bin before it is put in order.
    """
    held = rows.filter(F.col(ts).isNotNull()).select(F.col(key).alias("key"), micros(ts).alias("at"), F.coalesce(down, F.lit(True)).alias("down"))
    held = held.withColumn("bin", bin_of("at", bin_seconds * 1_000_000))
    moments = held.groupBy("key", "bin", "at").agg(F.bool_and("down").alias("down"), F.count("*").alias("rows"))
    moments = moments.withColumn("failed", F.when(F.col("down"), F.col("rows")).otherwise(0)).drop("rows")

    within, across = W.partitionBy("key", "bin").orderBy("at"), W.partitionBy("key").orderBy("bin")
    earlier = W.unboundedPreceding, -1
    bins = moments.groupBy("key", "bin").agg(F.max_by("down", "at").alias("last"), F.sum("failed").alias("failed"))
    bins = bins.select("key", "bin", F.lag("last").over(across).alias("down_before"), F.coalesce(F.sum("failed").over(across.rowsBetween(*earlier)), F.lit(0)).alias("failed_before"), F.sum("failed").over(W.partitionBy("key")).alias("failed_ever"))

    moments = moments.withColumns({"before": F.lag("down").over(within), "failed_here": F.coalesce(F.sum("failed").over(within.rowsBetween(*earlier)), F.lit(0))})
    known = _with(moments, bins)
    turns = known.filter(F.col("down") != F.coalesce("before", "down_before", F.lit(False))).select("key", "bin", "at", "down", (F.col("failed_before") + F.col("failed_here")).alias("so_far"), "failed_ever")

    turn = F.struct("at", "so_far")
    first = turns.groupBy("key", "bin").agg(F.min(turn).alias("first"))
    following = first.select("key", "bin", F.lead("first").over(across).alias("later"))
    turns = _with(turns.withColumn("next", F.lead(turn).over(within)), following)
    end = F.coalesce("next", "later")
    out = turns.filter("down").select("key", "at", end.alias("end"), (F.coalesce(end["so_far"], F.col("failed_ever")) - F.col("so_far")).alias("n"))
    return out.select(F.col("key").alias(key), F.timestamp_micros("at").alias("started"), F.timestamp_micros("end.at").alias("ended"), "n")


def _with(rows: DataFrame, bins: DataFrame) -> DataFrame:
    """Rows with what is known of their key's bin."""
    other = bins.withColumnsRenamed({"key": "_key", "bin": "_bin"})
    return rows.join(other, F.col("key").eqNullSafe(F.col("_key")) & (F.col("bin") == F.col("_bin"))).drop("_key", "_bin")
