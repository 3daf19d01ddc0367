"""Readers: parquet tables of a data folder, and whole text files."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the folder; Spark resolves the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row ``value`` per file, the whole content as UTF-8 text (not one row per line)."""
    return spark.read.text(path, wholetext=True)
