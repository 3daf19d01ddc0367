"""A training corpus from ``documents``: quality, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before it kept, and returns a
DataFrame that is written as Parquet and read again. All but the last return the columns of documents. Null, empty
and very long texts, repeated rows, null ids, further columns and empty tables have the results that the operators'
docstrings state; a null or empty text fails the quality base, so it goes in the first stage.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import decontaminate, ngram_join, packing, quality, secrets
from tidemill.llm.common import clear_stored, stored, stored_so_far
from tidemill.llm.registry import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or are probably bad go."""
    return quality.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document with the smallest id stays."""
    return ngram_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which 1 word in 20 or more lies in benchmark windows go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the names of their kinds; n_chars follows."""
    return secrets.redact(docs, secrets.train(docs)).withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of 2048 ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("secrets", secrets_stage), ("packing", packing_stage)]

#: SQL can tell neither the fitted models nor the tokenizer's ids; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has stored for itself, and the rows of the one before it, go when its own rows are written."""
    docs, begun = spark.read.parquet(f"{sf_dir}/documents.parquet"), stored_so_far()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        clear_stored(spark, begun, but=docs)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
