"""Streams against their batch twins over replays and restarts, and joins in time against plain Python."""

from datetime import datetime, timedelta
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions.times import bin_of
from tidemill.operators import islands
from tidemill.operators.asof import asof_join
from tidemill.operators.overlap import WIDTHS, overlap_join
from tidemill.streaming import sessions, status
from tidemill.streaming.replay import replayed, table_stream

ZERO = datetime(2024, 1, 1)
EVENTS = "user string, ts timestamp_ntz, value int"


def at(seconds: float) -> datetime:
    return ZERO + timedelta(seconds=seconds)


def events(seed: int, n: int = 400) -> list[tuple]:
    """One user has a third of all events; times in order, within some hours; a null user and null times."""
    rng = random.Random(seed)
    out, now = [], 0.0
    for i in range(n):
        now += rng.choice((1, 5, 20, 200)) * rng.random()
        out.append((rng.choice(("hot", "hot", "a", "b", "c", None)), at(now), i))
    return [*out, ("a", None, 1), (None, None, 2)]


def arrivals(rows: list[tuple], parts: int, jitter: int, seed: int) -> list[list[tuple]]:
    """Rows in an order in which each comes at most ``jitter`` places late, cut into parts."""
    rng = random.Random(seed)
    order = sorted(range(len(rows)), key=lambda i: i + rng.randint(0, jitter))
    return [[rows[i] for i in order[len(order) * k // parts : len(order) * (k + 1) // parts]] for k in range(parts)]


def write(spark, folder, part) -> None:
    spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def mark(rows: list[tuple], delay: int) -> datetime:
    """The watermark behind all rows: whole milliseconds."""
    last = max(t for _, t, _ in rows if t)
    return last.replace(microsecond=last.microsecond // 1000 * 1000) - timedelta(seconds=delay)


def naive(rows) -> list[tuple]:
    return sorted(((r[0] or "", *r[1:]) for r in rows), key=str)


@pytest.mark.parametrize(("seed", "parts", "jitter"), [(1, 6, 0), (2, 5, 12)])
def test_transitions_over_replay_and_restart(spark, tmp_path, seed, parts, jitter):
    rows, timeout, delay = events(seed), 60, 1500
    folder, out = str(tmp_path / "events"), str(tmp_path / "out")
    stream = lambda: status.transitions(table_stream(spark, folder, 1), "user", "ts", timeout, delay)
    for k, part in enumerate(arrivals(rows, parts, jitter, seed)):
        write(spark, folder, part)
        if k % 2:
            replayed(stream(), out)  # each run goes on from the checkpoint of the one before
    got = replayed(stream(), out)
    again = replayed(stream(), out)  # nothing is new
    batch = islands.transitions(spark.createDataFrame(rows, EVENTS), "user", "ts", timeout).filter(F.col("changed_at") < F.lit(mark(rows, delay)).cast("timestamp"))
    want = naive(batch.collect())
    assert naive(got.collect()) == naive(again.collect()) == want and len(want) > 100
    assert {r[2] for r in want} == {"idle", "working"}


def test_a_late_event_changes_nothing(spark, tmp_path):
    folder, out = str(tmp_path / "events"), str(tmp_path / "out")
    stream = lambda: status.transitions(table_stream(spark, folder, 1), "user", "ts", 60, 100)
    write(spark, folder, [("a", at(0), 0), ("b", at(1000), 1)])
    replayed(stream(), out)  # the watermark is at 900 now
    write(spark, folder, [("a", at(30), 2), ("a", at(899), 3), ("a", at(900), 4), ("a", at(901), 5), ("b", at(3000), 6)])
    got = naive((r["user"], (r["changed_at"] - ZERO).total_seconds(), r["status"]) for r in replayed(stream(), out).collect())
    assert got == naive([("a", 0.0, "working"), ("a", 60.0, "idle"), ("a", 901.0, "working"), ("a", 961.0, "idle"), ("b", 1000.0, "working"), ("b", 1060.0, "idle")])


def test_advance_is_the_same_in_any_steps():
    rng = np.random.default_rng(0)
    times = np.sort(rng.integers(0, 5000, 60))
    _, _, _, whole = status.advance(times, 0, False, 6000, 70)
    for _ in range(20):
        cuts = np.unique([*rng.integers(0, 6000, 9).tolist(), 6000]).tolist()
        waiting, last, working, found = np.zeros(0, np.int64), 0, False, []
        for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True):
            waiting = np.sort(np.concatenate((waiting, times[(times >= lo) & (times < hi)])))
            waiting, last, working, more = status.advance(waiting, last, working, hi, 70)
            found += more
        assert found == whole and not working and not len(waiting)


def test_sessions_drop_late_rows_and_equal_their_twin(spark, tmp_path):
    rows, gap, delay = events(3), 60, 600
    folder, out = str(tmp_path / "events"), str(tmp_path / "out")
    stream = lambda: sessions.sessions(table_stream(spark, folder, 1), "user", "ts", gap, delay, F.sum("value").alias("total"))
    for part in arrivals(rows, 4, 3, 3):
        write(spark, folder, part)
        got = replayed(stream(), out)
    late = [("late", at(1), 1), ("hot", at(2), 1000)]
    before = naive(got.collect())
    write(spark, folder, late)
    query = stream().writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/rows")
    query.awaitTermination()
    assert sessions.dropped(query) == len(late)
    twin = sessions.sessions(spark.createDataFrame(rows, EVENTS), "user", "ts", gap, delay, F.sum("value").alias("total")).filter(F.col("ended") <= F.lit(mark(rows, delay)).cast("timestamp"))
    assert before == naive(replayed(stream(), out).collect()) == naive(twin.collect()) and len(before) > 50


def test_tumbling_windows(spark, tmp_path):
    rows, folder = events(4), str(tmp_path / "events")
    for part in arrivals(rows, 3, 2, 4):
        write(spark, folder, part)
    got = replayed(sessions.tumbling(table_stream(spark, folder, 1), "user", "ts", 600, 300, F.max("value").alias("top")), str(tmp_path / "out"))
    twin = sessions.tumbling(spark.createDataFrame(rows, EVENTS), "user", "ts", 600, 300, F.max("value").alias("top")).filter(F.col("started") + F.expr("interval 600 seconds") <= F.lit(mark(rows, 300)).cast("timestamp"))
    assert naive(got.collect()) == naive(twin.collect()) and got.count() > 20


def test_islands(spark):
    rows = events(5)
    got = naive(islands.islands(spark.createDataFrame(rows, EVENTS), "user", "ts", 30).collect())
    want = []
    for user in {r[0] for r in rows}:
        times = sorted(t for u, t, _ in rows if u == user and t)
        start = 0
        for i in range(1, len(times) + 1):
            if i == len(times) or times[i] - times[i - 1] > timedelta(seconds=30):
                want.append((user, times[start], times[i - 1], i - start))
                start = i
    assert got == naive(want)
    exact = [("a", at(-0.5), 1), ("a", at(29.5), 1), ("a", at(59.500001), 1)]
    assert [r["n"] for r in islands.islands(spark.createDataFrame(exact, EVENTS), "user", "ts", 30).orderBy("started").collect()] == [2, 1]
    assert islands.islands(spark.createDataFrame([], EVENTS), "user", "ts", 30).count() == 0


@pytest.mark.parametrize("within", [None, 40])
def test_asof(spark, within):
    rng = random.Random(6)
    left = [(i, rng.choice(("hot", "hot", "a", "b", None)), rng.choice((None, *[rng.randint(-500, 500)] * 9)), "x") for i in range(300)]
    right = [(rng.choice(("hot", "hot", "a", "c", None)), rng.choice((None, *[rng.randint(-500, 500)] * 9)), i, rng.choice((None, "p", "q"))) for i in range(200)]
    a = spark.createDataFrame([(i, k, None if t is None else at(t), x) for i, k, t, x in left], "id int, k string, t timestamp_ntz, note string")
    b = spark.createDataFrame([(k, None if t is None else at(t), i, n) for k, t, i, n in right], "k string, u timestamp_ntz, n int, note string")
    out = asof_join(a, b, "k", "t", "u", tie="n", bin_seconds=100, within=within, prefix="r_")
    assert out.columns == ["id", "k", "t", "note", "r_u", "r_n", "r_note"]
    want = {}
    for i, k, t, _ in left:
        fit = [(u, n, note) for key, u, n, note in right if None not in (k, t, u) and key == k and u <= t and (within is None or t - u <= within)]
        want[i] = max(fit, key=lambda x: x[:2])[1:] if fit else (None, None)
    got = {r["id"]: (r["r_n"], r["r_note"]) for r in out.collect()}
    assert got == want and len({v for v in want.values()}) > 40
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert asof_join(a.limit(0), b, "k", "t", "u", tie="n").count() == 0
    assert asof_join(a, b.limit(0), "k", "t", "u", tie="n", prefix="r_").filter("r_n is null").count() == len(left)


def test_overlaps(spark):
    rng = random.Random(7)
    longest = WIDTHS[6] // 1_000_000
    span = lambda: rng.choice((0, -5, 1, 3600, 3601, 30_000, 10**6, longest, longest + 7)) + rng.choice((0, 1, 17))
    make = lambda n: [(i, rng.choice(("a", "b", None)), s := rng.randint(-(10**6), 10**6), s + span()) for i in range(n)]  # noqa: E731, F841
    left, right = make(120), make(150)
    frame = lambda rows: spark.createDataFrame([(i, k, at(s), at(e) if i % 13 else None) for i, k, s, e in rows], "id int, k string, s timestamp, e timestamp")
    out = overlap_join(frame(left), frame(right), "k", "s", "e")
    got = [(r["a"]["id"], r["b"]["id"]) for r in out.collect()]
    want = [(i, j) for i, k, s, e in left for j, x, t, u in right if k and k == x and i % 13 and j % 13 and s < e and t < u and s < u and t < e]
    assert sorted(got) == sorted(want) and len(want) > 500
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert overlap_join(frame(left).limit(0), frame(right), "k", "s", "e").count() == 0


def test_touching_intervals_do_not_overlap(spark):
    rows = [(1, "a", at(0), at(3600)), (2, "a", at(3600), at(7200)), (3, "a", at(3599.999999), at(3600.000001))]
    df = spark.createDataFrame(rows, "id int, k string, s timestamp, e timestamp")
    out = overlap_join(df, df, "k", "s", "e", F.col("a.id") < F.col("b.id"))
    assert sorted((r["a"]["id"], r["b"]["id"]) for r in out.collect()) == [(1, 3), (2, 3)]


def test_bins_are_exact(spark):
    rows = [(x, w) for w in (1, 7, 3_600_000_000) for k in (-(10**9), -1, 0, 1, 10**8) for x in (k * w - 1, k * w, k * w + 1)]
    got = spark.createDataFrame(rows, "x long, w long").select("x", "w", bin_of("x", F.col("w")).alias("b")).collect()
    assert all(r["b"] == r["x"] // r["w"] for r in got)
