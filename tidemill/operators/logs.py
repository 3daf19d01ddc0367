"""Keep log records by a root level and overrides per logger, and route what stays."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.logs import level_number


def thresholds(overrides: dict[str, str]) -> dict[str, int]:
    """Level numbers of overrides given by name (unknown: WARNING), without those that defer to the parent."""
    found = {k: level_number(v, 30) for k, v in overrides.items()}
    return {k: v for k, v in found.items() if v}


def effective_level(logger: Column, root: str, overrides: dict[str, str]) -> Column:
    """Threshold of a logger: its nearest ancestor in the dotted name that has an override, else the root's.

    The overrides are configuration, so they become one CASE of literals: no join, no shuffle.
    """
    out = None
    found = thresholds(overrides)
    for name in sorted(found, key=len, reverse=True):
        test = (logger == name) | logger.startswith(name + ".")
        out = F.when(test, found[name]) if out is None else out.when(test, found[name])
    last = F.lit(level_number(root, 10))
    return last if out is None else out.otherwise(last)


def filter_levels(records: DataFrame, root: str = "DEBUG", overrides: dict[str, str] | None = None) -> DataFrame:
    """Records at or over their logger's threshold. A null logger is the root's; a null level is dropped."""
    return records.filter(F.col("levelno") >= effective_level(F.coalesce("logger", F.lit("")), root, overrides or {}))


def filter_levels_by(records: DataFrame, overrides: DataFrame, root: str = "DEBUG") -> DataFrame:
    """As ``filter_levels``, for overrides in a table (logger, level int) of any size.

    Each distinct logger name is expanded to its dotted prefixes, which join by equality; the longest
    that has an override wins. The names, not the records, go through the prefix join. Of several overrides
    for one logger the highest level holds; a null logger or level overrides nothing.
    """
    names = records.select(F.coalesce("logger", F.lit("")).alias("_name")).distinct()
    parts = F.split("_name", r"\.")
    prefixes = names.select("_name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("_prefix"))
    own = overrides.filter(F.col("level") != 0).groupBy(F.col("logger").alias("_prefix")).agg(F.max("level").alias("_level"))
    found = prefixes.join(own, "_prefix").groupBy("_name").agg(F.max_by("_level", F.length("_prefix")).alias("_level"))
    kept = records.withColumn("_name", F.coalesce("logger", F.lit(""))).join(found, "_name", "left")
    return kept.filter(F.col("levelno") >= F.coalesce("_level", F.lit(level_number(root, 10)))).drop("_name", "_level")


def sinks(log_file: Column) -> Column:
    """Where a record goes: always the console, and the rotating file where a path is set."""
    return F.when(F.coalesce(log_file != "", F.lit(False)), F.array(F.lit("console"), F.lit("file"))).otherwise(F.array(F.lit("console")))
