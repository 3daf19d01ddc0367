"""Polled responses: each round of requests is recorded once, and the recording is a stream that can be replayed.

An endpoint answers a request once, so a stream that asked again after a failure would see other responses, or none. Here a
round of polls is a Spark job (``polled``: tasks ask, and a request that fails has no body), its rows are written once to a
recording (``record``), and ``polls`` reads the recording as a stream. The stream's offset is the number of the last round; where a
restart asks for the same offsets, the same files are read, so no response is lost and none comes twice.

A round is written aside and then renamed to the number after the last one, so rounds appear whole and in order. That holds where
the file system renames folders at once (local, HDFS); one writer at a time. A round that fails while it is written never appears.
Rounds that a stream may still ask for must stay.

Defined cases: a round without rows is a round; nulls come back as nulls; repeated rows stay repeated; columns of any name are kept, but a
recording whose rounds have columns other than the schema's is refused, as is one that has lost rounds that were read from it before.
Each file is a task of its own, read some rows at a time, so neither the driver nor a worker holds a round.
"""

from collections.abc import Callable, Iterator
import uuid

import pandas as pd
import pyarrow as pa
from pyarrow import fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a file that are decoded at a time; what a round's folder is called.
ROWS, ROUND = 256, "round-"


def polled(endpoints: DataFrame, url: str, fetch: Callable[[str], str]) -> DataFrame:
    """The endpoints with asked_at, body and error: one request for each row whose url isn't null, made by tasks.

    A request that raises has a null body and the exception as its error, as has one that wasn't made. Evaluating the
    result again asks again, so it is recorded before anything else reads it.
    """

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            asked, bodies, errors = [], [], []
            for u in frame[url]:
                asked.append(pd.Timestamp.now("UTC"))
                try:
                    if u is None:
                        raise ValueError("no address")
                    body, error = fetch(u), None
                except Exception as e:  # noqa: BLE001: whatever a request raises, the round goes on
                    body, error = None, f"{type(e).__name__}: {e}"
                bodies.append(body)
                errors.append(error)
            yield frame.assign(asked_at=pd.Series(asked, frame.index, "datetime64[us, UTC]"), body=pd.Series(bodies, frame.index, object), error=pd.Series(errors, frame.index, object))

    schema = StructType([*endpoints.schema.fields]).add("asked_at", "timestamp").add("body", "string").add("error", "string")
    return endpoints.mapInPandas(ask, schema)


def record(responses: DataFrame, folder: str) -> int:
    """Writes the rows as the recording's next round and returns its number."""
    spark = responses.sparkSession
    aside = f"{folder}/.writing-{uuid.uuid4().hex}"
    responses.write.parquet(aside)
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    number = max((_number(s.getPath().getName()) for s in store.listStatus(path(folder))), default=0) + 1
    if not store.rename(path(aside), path(f"{folder}/{ROUND}{number:09d}")):
        raise RuntimeError(f"Round {number} of {folder} couldn't be named")
    return number


def _number(name: str) -> int:
    return int(name.removeprefix(ROUND)) if name.startswith(ROUND) else 0


class RecordedFile(InputPartition):
    """One file of a round."""

    def __init__(self, path: str):
        self.path = path


class RecordedRounds(DataSourceStreamReader):
    """Offsets are numbers of rounds; a micro-batch has the files of the rounds behind its start, to its end."""

    def __init__(self, folder: str, schema: StructType):
        self.folder, self.schema = folder, schema

    def _rounds(self) -> dict[int, str]:
        store, path = fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return {n: x.path for x in found if (n := _number(x.base_name))}

    def initialOffset(self) -> dict:
        return {"round": 0}

    def latestOffset(self) -> dict:
        return {"round": max(self._rounds(), default=0)}

    def partitions(self, start: dict, end: dict) -> list[RecordedFile]:
        rounds, (store, _) = self._rounds(), fs.FileSystem.from_uri(self.folder)
        wanted = range(start["round"] + 1, end["round"] + 1)
        if end["round"] < start["round"] or not rounds.keys() >= set(wanted):
            raise ValueError(f"{self.folder} lacks rounds that were there: asked from {start['round']} to {end['round']}, there are {len(rounds)} to {max(rounds, default=0)}")
        files = (x for n in wanted for x in store.get_file_info(fs.FileSelector(rounds[n], recursive=True)))
        return [RecordedFile(p) for p in sorted(x.path for x in files if x.base_name.endswith(".parquet") and x.base_name[0] not in "._")]

    def read(self, partition: RecordedFile) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.folder)
        shape = to_arrow_schema(self.schema)
        with store.open_input_file(partition.path) as f:
            file = pq.ParquetFile(f)
            if sorted(file.schema_arrow.names) != sorted(shape.names):
                raise ValueError(f"{partition.path} has the columns {file.schema_arrow.names}, not {shape.names}")
            for batch in file.iter_batches(ROWS):
                yield pa.RecordBatch.from_arrays([batch.column(x.name).cast(x.type) for x in shape], schema=shape)


class RecordedPolls(DataSource):
    """The source ``recorded_polls``; option ``folder``."""

    @classmethod
    def name(cls) -> str:
        return "recorded_polls"

    def streamReader(self, schema: StructType) -> RecordedRounds:
        return RecordedRounds(self.options["folder"], schema)


def polls(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """The recording as a stream: all rounds there are, then those that come."""
    spark.dataSource.register(RecordedPolls)
    return spark.readStream.format("recorded_polls").schema(schema).option("folder", folder).load()


def latest(responses: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """key, n (responses), n_failed (those without a body) and, of the response with the greatest ``at``, at and the columns.

    Of responses with one ``at``, that with the greatest columns counts; those without ``at`` come before all others.
    """
    last = F.max(F.struct(at, *columns)).alias("_last")
    found = responses.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("body").isNull()).alias("n_failed"), last)
    return found.select(key, "n", "n_failed", "_last.*")
