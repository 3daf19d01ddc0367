"""Approximate distinct counts and quantiles from sketches that are rows, so that they can be stored and merged in any order.

A distinct sketch keeps, for each register of a key, the highest rank that a value's hash had there; a quantile sketch, for each
bucket of a key, how many values fell in. Maxima and sums don't depend on how rows were parted, so any parts, merged in any
order and in any steps, give one and the same sketch.
"""

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Bits of the hash, whose lowest choose the register.
HASH_BITS = 60


def hash60(value: Column) -> Column:
    """60 bits of a value, by a hash that SQL engines share; null for null."""
    return F.conv(F.substring(F.md5(value.cast("string").cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def distinct_sketch(rows: DataFrame, by: list[str], value: Column, bits: int = 10) -> DataFrame:
    """by, register, rank: 2^bits rows a key at most, aggregated before the shuffle. Nulls aren't counted."""
    held = rows.select(*by, hash60(value).alias("h")).filter("h is not null")
    rest = F.shiftright("h", bits)
    used = F.when(rest > 0, F.length(F.bin(rest))).otherwise(0)
    return held.groupBy(*by, F.col("h").bitwiseAND(2**bits - 1).cast("int").alias("register")).agg(F.max(HASH_BITS - bits + 1 - used).cast("int").alias("rank"))


def merge_distinct(sketch: DataFrame, by: list[str]) -> DataFrame:
    return sketch.groupBy(*by, "register").agg(F.max("rank").alias("rank"))


def distinct_estimate(sketch: DataFrame, by: list[str], bits: int = 10) -> DataFrame:
    """by, estimate (long) of merged sketches: the standard error is 1.04 / 2^(bits / 2), some 3 % for 10 bits. Few values are counted by empty registers."""
    m = 2**bits
    sums = sketch.groupBy(*by).agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"), F.count("*").alias("filled"))
    # Sums of powers of two are exact in any order, as ranks differ by less than a double has bits.
    empty = m - F.col("filled")
    raw = 0.7213 / (1 + 1.079 / m) * m * m / (F.col("s") + empty)
    few = m * F.log(m / F.nullif(empty, F.lit(0)))
    return sums.select(*by, F.round(F.when((raw <= 2.5 * m) & (empty > 0), few).otherwise(raw)).cast("long").alias("estimate"))


def quantile_sketch(rows: DataFrame, by: list[str], value: Column, error: float = 0.01) -> DataFrame:
    """by, sign, bucket, n. Buckets grow by a factor each, so what is in one lies within ``error`` of its middle, as a share. Nulls, NaN and infinities aren't counted."""
    held = rows.select(*by, value.cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    bucket = F.when(F.col("v") == 0, 0).otherwise(F.ceil(F.log(F.abs("v")) / log((1 + error) / (1 - error)))).cast("int")
    return held.groupBy(*by, F.signum("v").cast("int").alias("sign"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge_quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    return sketch.groupBy(*by, "sign", "bucket").agg(F.sum("n").alias("n"))


def quantile_estimate(sketch: DataFrame, by: list[str], shares: list[float], error: float = 0.01) -> DataFrame:
    """by, share, estimate of merged sketches: within ``error``, as a share, of the value of rank ceil(share * n), the first for share 0.

    A key's buckets are put in order by one task: some 1,400 from a millionth to a million, and 72,000 for all doubles there are.
    """
    factor = (1 + error) / (1 - error)
    order = W.partitionBy(*by).orderBy(F.col("sign") * F.lit(2**32) + F.col("sign") * F.col("bucket"))
    seen = sketch.withColumns({"upto": F.sum("n").over(order), "of": F.sum("n").over(W.partitionBy(*by))})
    wanted = seen.withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    rank = F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("of")))
    return wanted.filter((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)).select(*by, "share", (F.col("sign") * 2 * F.pow(F.lit(factor), F.col("bucket")) / (factor + 1)).alias("estimate"))


def write_batch(sketch: DataFrame, folder: str, batch: str) -> None:
    """Stores the sketch of a batch of rows. A batch that is written again replaces what it wrote before, so a replay counts nothing twice."""
    sketch.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def batches(schema_of: DataFrame, folder: str) -> DataFrame:
    """The sketches of all batches in the folder, to be merged."""
    return schema_of.sparkSession.read.schema(schema_of.schema).parquet(folder)
