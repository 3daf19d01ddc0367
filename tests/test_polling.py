"""Recorded polls: rounds, restarts, failures of requests and of streams, against plain Python."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemill.operators import status
from tidemill.sources.polling import latest, polled, polls, record
from tidemill.streaming.replay import replayed

SCHEMA = "node string, at timestamp, body string"


def answers(spark, k: int, n: int = 300):
    """Round k: a node has a third of the responses; nulls, repeated rows, empty and very long bodies."""
    rows = [("hot" if i % 3 else f"n{i % 7}", datetime(2024, 1, 1, k, i // 60, i % 60), f"{k}-{i}") for i in range(n)]
    return spark.createDataFrame([*rows, rows[0], rows[0], (None, None, None), ("a", None, ""), ("b", None, "x" * 2_000_000)], SCHEMA)


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_rounds_come_once_over_restarts(spark, tmp_path):
    folder, out, want = str(tmp_path / "recording"), str(tmp_path / "out"), []
    assert replayed(polls(spark, folder, SCHEMA), out).count() == 0  # nothing recorded yet
    for k in range(1, 5):
        assert record(answers(spark, k).repartition(3), folder) == k
        want += rows_of(answers(spark, k))
        if k != 2:  # two rounds in one micro-batch
            got = replayed(polls(spark, folder, SCHEMA), out)
            assert rows_of(got) == sorted(want, key=str)
    assert record(answers(spark, 5).limit(0), folder) == 5
    assert rows_of(replayed(polls(spark, "file://" + folder, SCHEMA), out)) == sorted(want, key=str)


def test_a_failed_batch_is_read_again_and_unfinished_rounds_are_not(spark, tmp_path):
    folder, seen = str(tmp_path / "recording"), []

    def run(fails: bool) -> None:
        def take(batch, number):
            found = rows_of(batch)
            if fails:
                raise RuntimeError("lost")
            seen.append((number, found))

        query = polls(spark, folder, SCHEMA).writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()

    record(answers(spark, 1), folder)
    run(False)
    record(answers(spark, 2), folder)
    with pytest.raises(Exception, match="lost"):
        run(True)
    record(answers(spark, 3), folder)  # comes after the planned batch, not in it
    with pytest.raises(Exception, match="division|DIVIDE|zero"):
        record(answers(spark, 4).withColumn("body", F.expr("string(1 div (length(body) - length(body)))")), folder)
    run(False)
    run(False)
    assert [n for n, _ in seen] == [0, 1, 2]
    assert [x for _, x in seen] == [rows_of(answers(spark, k)) for k in (1, 2, 3)]


def test_a_changed_recording_is_refused(spark, tmp_path):
    folder, out = tmp_path / "recording", str(tmp_path / "out")
    record(answers(spark, 1), str(folder))
    record(answers(spark, 2), str(folder))
    replayed(polls(spark, str(folder), SCHEMA), out)
    (folder / "round-000000002").rename(tmp_path / "away")
    with pytest.raises(Exception, match="lacks rounds"):
        replayed(polls(spark, str(folder), SCHEMA), out)
    (tmp_path / "away").rename(folder / "round-000000003")
    with pytest.raises(Exception, match="lacks rounds"):
        replayed(polls(spark, str(folder), SCHEMA), str(tmp_path / "fresh"))
    other = tmp_path / "other"
    record(answers(spark, 1).drop("at"), str(other))
    with pytest.raises(Exception, match="has the columns"):
        replayed(polls(spark, str(other), SCHEMA), str(tmp_path / "out2"))


def test_polled_statuses(spark, tmp_path):
    """Ask, record, stream, show: what fails or isn't JSON is unreachable."""

    def fetch(url: str) -> str:  # local, so that it is sent to workers by value
        if url.endswith("7"):
            raise TimeoutError("no answer")
        return '{"version": "1.2", "status": "working"}' if url.endswith("1") else "<html>"

    folder = str(tmp_path / "recording")
    asked = polled(spark.createDataFrame([(i, None if i == 5 else f"http://node/{i}") for i in range(20)], "id int, url string").repartition(3), "url", fetch)
    record(asked, folder)
    out = replayed(polls(spark, folder, asked.schema), str(tmp_path / "out"))
    out = status.view_state(out.withColumn("response", status.parsed(F.col("body"))))
    got = {r["id"]: (r["label"], r["error"]) for r in out.collect()}
    want = {i: ("unreachable", "TimeoutError: no answer" if i % 10 == 7 else "ValueError: no address" if i == 5 else None) if i % 10 != 1 else ("working", None) for i in range(20)}
    assert got == want and out.filter("asked_at is null").count() == 0


def test_latest(spark):
    rows = [("a", 1, "x"), ("a", 3, None), ("a", 3, None), ("b", None, "y"), ("b", 2, "p"), ("b", 2, "q"), (None, None, None)]
    got = latest(spark.createDataFrame(rows, "node string, at int, body string"), "node", "at", "body")
    assert rows_of(got) == sorted([("a", 3, 2, 3, None), ("b", 3, 0, 2, "q"), (None, 1, 1, None, None)], key=str)
