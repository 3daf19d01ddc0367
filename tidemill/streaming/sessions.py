"""Event-time windows over streams: sessions and fixed windows, closed by a watermark.

The watermark is the latest time seen in earlier micro-batches less the delay. A row is late if the window that it would make
by itself ends at or before the watermark: for a session, its time and the gap. Late rows are dropped and change no result; Spark counts
them in the query's progress (``dropped``). A window is emitted once, when the watermark has reached its end, so every row that isn't late is in
exactly one emitted window in the end.
Sessions of one key merge in each task before the shuffle, so a key with a third of all rows sends a row per session and task.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Set on the session, lets tasks merge sessions before the shuffle.
MERGE_FIRST = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def _timed(events: DataFrame, ts: str, delay: int) -> DataFrame:
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, f"{delay} seconds") if events.isStreaming else timed


def sessions(events: DataFrame, key: str, ts: str, gap: int, delay: int, *sums: Column) -> DataFrame:
    """key, started, ended, n and the sums of each session: rows of a key at most ``gap`` seconds from the one before.

    ended is the end of the window: the last row's time and the gap. Over a table, all sessions; over a stream, those closed by the watermark.
    """
    events.sparkSession.conf.set(MERGE_FIRST, "true")
    # Aggregates, not the window's own ends: Spark would push a later filter by those below the merging of sessions.
    edges = [F.min(ts).alias("started"), (F.max(ts) + F.make_dt_interval(secs=F.lit(gap))).alias("ended")]
    found = _timed(events, ts, delay).filter(F.col(ts).isNotNull()).groupBy(F.session_window(ts, f"{gap} seconds").alias("_w"), key).agg(*edges, F.count("*").alias("n"), *sums)
    return found.drop("_w")


def tumbling(events: DataFrame, key: str, ts: str, width: int, delay: int, *sums: Column) -> DataFrame:
    """key, started, n and the sums of each window of ``width`` seconds that has rows."""
    found = _timed(events, ts, delay).filter(F.col(ts).isNotNull()).groupBy(F.window(ts, f"{width} seconds").alias("_w"), key).agg(F.count("*").alias("n"), *sums)
    more = [c for c in found.columns if c not in ("_w", key, "n")]
    return found.select(key, F.col("_w.start").alias("started"), "n", *more)


def dropped(query: StreamingQuery) -> int:
    """Rows (for windows, rows of the map side's partial sums) that a query's recent micro-batches dropped as late."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
