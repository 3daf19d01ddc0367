"""Runs a stream over what is there, once, and gives its rows as a table."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession, name: str = "stream") -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a session on this machine alone gets a temporary one and any other is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir isn't set: name a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        found = _own[0]
    return f"{found}/{name}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The files of a parquet table, be it a folder or one file, as a stream; ``files`` in a micro-batch."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    # A plain path would have to be a folder; a pattern that fits this path alone may be a file.
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{path[:-1]}[{path[-1]}]")


def replayed(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows that an append-mode stream emits for all input there is now. A folder used before goes on from its checkpoint,
    and rows of earlier runs are among the result, each once."""
    spark = stream.sparkSession
    folder = folder or shared_folder(spark)
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
