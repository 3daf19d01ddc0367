"""Log lines over a stream: the batch transformations unchanged, and a sink for notifications."""

from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemill.functions.logs import log_line
from tidemill.operators.logs import filter_levels
from tidemill.operators.notify import deliver, plan


def log_lines(records: DataFrame, root: str = "DEBUG", overrides: dict[str, str] | None = None, colour: bool = False) -> DataFrame:
    """Lines of the records that pass their thresholds; stateless, for batch and stream alike."""
    c = F.col
    kept = filter_levels(records, root, overrides)
    return kept.withColumn("line", log_line(c("ts"), c("levelno"), c("levelname"), c("filename"), c("lineno"), c("msg"), c("exc"), colour))


def notify_sink(notes: DataFrame, send: Callable[[Row], None]) -> DataStreamWriter:
    """A writer that plans and delivers the notifications of each micro-batch."""
    return notes.writeStream.foreachBatch(lambda batch, _: deliver(plan(batch), send) and None)
