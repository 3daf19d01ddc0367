"""Tile pyramids: sums over the tiles of one zoom, rolled up to all coarser ones."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: What a tile holds, and how four tiles' values make their parent's.
MERGE = {"n": F.sum, "total": F.sum, "lowest": F.min, "highest": F.max}


def tile_sums(rows: DataFrame, x: Column, y: Column, value: Column, by: list[str] | None = None) -> DataFrame:
    """by, x, y, n, total, lowest, highest: the rows of each tile; a row without a tile is left out, a null value counts in n only.

    A whole or decimal value is summed exactly, so that every zoom equals what its rows give directly; doubles are summed in any order.
    Sums are partial before the shuffle: a tile with a third of all rows brings a row per task.
    """
    held = rows.select(*(by or []), x.alias("x"), y.alias("y"), value.alias("value")).filter("x is not null and y is not null")
    return held.groupBy(*(by or []), "x", "y").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("lowest"), F.max("value").alias("highest"))


def parents(tiles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The tiles of the next coarser zoom, each from four at most."""
    up = [F.shiftright(c, 1).alias(c) for c in ("x", "y")]
    return tiles.groupBy(*(by or []), *up).agg(*(merge(c).cast(tiles.schema[c].dataType).alias(c) for c, merge in MERGE.items()))


def write_pyramid(tiles: DataFrame, zoom: int, folder: str, by: list[str] | None = None) -> DataFrame:
    """Writes the tiles of ``zoom`` and of all coarser zooms to the folder, as ``z=<zoom>``, and gives them as one table.

    Each zoom is made from the one below as it was written, so rows are read once, however many zooms there
    are, and a lost executor costs tasks of one zoom. A folder written before is overwritten zoom by zoom. A filter by z reads that zoom only.
    """
    spark = tiles.sparkSession
    level = tiles
    for z in range(zoom, -1, -1):
        path = f"{folder}/z={z}"
        level.write.mode("overwrite").parquet(path)
        level = parents(spark.read.schema(tiles.schema).parquet(path), by)
    return spark.read.schema(StructType([*tiles.schema.fields, StructField("z", IntegerType())])).parquet(folder)


def in_box(pyramid: DataFrame, zoom: int, west: int, north: int, east: int, south: int) -> DataFrame:
    """The tiles of one zoom in a box of tile numbers, both ends included; only that zoom's files are read."""
    return pyramid.filter((F.col("z") == zoom) & F.col("x").between(west, east) & F.col("y").between(north, south))
