"""What the operators share: the folder that all executors see, stored tables, and rows keyed by document."""

import re
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside the operators: the smallest id. Operators that compare texts tell such rows apart by ``text_key``.
NO_ID = -(2**63)


_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir. Where that is unset, a session on this machine alone (as in
    tests) gets a folder of its own, and any other is refused: no folder of one machine serves a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir isn't set: name a folder that the driver and all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _local[0]


class _Stored(threading.local):
    """Paths of the tables that this thread has stored, in order: a run in another thread has its own."""

    def __init__(self):
        self.paths: list[str] = []


_own = _Stored()


def clear_stored(spark: SparkSession, since: int = 0, but: DataFrame | None = None) -> int:
    """Deletes the tables that this thread has stored, once no result that reads them is needed any more.

    since: how many (see ``stored_so_far``) were there before and stay; but: a stored table that stays too.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = [p for p in _own.paths[since:] if p != getattr(but, "stored_path", None)]
    n = 0
    for p in gone:
        _own.paths.remove(p)
        path = jvm.org.apache.hadoop.fs.Path(p)
        n += path.getFileSystem(conf).delete(path, True)
    return n


def stored_so_far() -> int:
    return len(_own.paths)


def drop_stored(df: DataFrame) -> None:
    """Deletes one stored table, which nothing reads any more."""
    if df.stored_path in _own.paths:
        _own.paths.remove(df.stored_path)
    _own.paths.append(df.stored_path)
    clear_stored(df.sparkSession, len(_own.paths) - 1)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to a new table in the shared folder and reads them from there: lineage ends here, and
    a lost executor costs no more than its own tasks. Like checkpoints, the tables stay until ``clear_stored`` or the cluster clears them."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _own.paths.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def doc_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def key_back(column: Column) -> Column:
    return F.when(column != NO_ID, column)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id (never null) and text (null: empty) of documents; other columns, of whatever name, stay out."""
    return docs.select(doc_key().alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def text_key(column: str = "text") -> Column:
    """Tells texts apart that share a doc_id, as all rows without one do: a 64-bit hash, compared within one doc_id only."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, sub and text: rows are one document if both keys are equal."""
    return texts(docs).select("doc_id", text_key().alias("sub"), "text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
