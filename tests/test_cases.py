"""Case rows for each behaviour, with values derived by hand."""

import pytest
from pyspark.sql import functions as F

from tidemill.functions.config import sender
from tidemill.functions.logs import log_line, shown_level
from tidemill.functions.text import version_of
from tidemill.operators import driver_log, logs, notify, status
from tidemill.sources.tables import whole_texts


@pytest.mark.parametrize(("text", "want"), [
    ("x img.shields.io/badge/version-0.1-blue y", "0.1"), ("no badge", "unknown"), ("img.shields.io/badge/version-0.1--rc1-blue", "0.1"), ("img.shields.io/badge/version--blue", "unknown"),
    (None, "unknown"), ("img.shields.io/badge/version-1\n2-blue", "1\n2"), ("img.shields.io/badge/version-1-a img.shields.io/badge/version-2-b", "1"), ("", "unknown"),
])
def test_version(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(version_of(F.col("t"))).first()[0] == want


def test_version_of_file(spark, tmp_path):
    (tmp_path / "a.md").write_text("line\n![v](https://img.shields.io/badge/version-3.2-blue)\n")
    assert [r[0] for r in whole_texts(spark, str(tmp_path)).select(version_of(F.col("value"))).collect()] == ["3.2"]


@pytest.mark.parametrize(("place", "want"), [(("server.py", 64), "server.py:64" + " " * 13), (("a_very_long_module_filename_x.py", 1234), "a_very_long_module_filename_x.py:1234")])
def test_line(spark, place, want):
    df = spark.createDataFrame([(*place, 10, "DEBUG", "hi", "boom")], "f string, n int, l int, ln string, m string, e string").withColumn("ts", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    c = F.col
    plain, colour = df.select(log_line(c("ts"), c("l"), c("ln"), c("f"), c("n"), c("m"), c("e")), log_line(c("ts"), c("l"), c("ln"), c("f"), c("n"), c("m"), c("e"), True)).first()
    assert plain == f"2024-01-02 03:04:05 | Debug    | {want} | hi\nboom"
    assert colour == f"\x1b[36m2024-01-02 03:04:05 | Debug    | {want} |\x1b[0m \x1b[90mhi\nboom\x1b[0m"


def test_unknown_level(spark):
    df = spark.createDataFrame([(125, "Level 125"), (5, "T")], "l int, n string")
    assert [r[0] for r in df.select(shown_level(F.col("l"), F.col("n"))).collect()] == ["Level 125", "T       "]


def kept(spark, root, overrides, rows):
    df = spark.createDataFrame(rows, "logger string, levelno int")
    a = [tuple(r) for r in logs.filter_levels(df, root, overrides).collect()]
    own = spark.createDataFrame([(k, logs.level_number(v, 30)) for k, v in overrides.items()], "logger string, level int")
    b = [tuple(r) for r in logs.filter_levels_by(df, own, root).collect()]
    key = lambda r: (r[0] or "", r[1])
    assert sorted(a, key=key) == sorted(b, key=key)
    return a


def test_levels(spark):
    got = kept(spark, "debug", {"waitress": "error", "urllib3": "ERROR"}, [("waitress.queue", 30), ("waitress", 40), ("waitressx", 30), ("urllib3.util.retry", 50), ("server", 10), (None, 10)])
    assert set(got) == {("waitress", 40), ("waitressx", 30), ("urllib3.util.retry", 50), ("server", 10), (None, 10)}


def test_nested_levels_like_logging(spark):
    import logging

    overrides = {"a": "ERROR", "a.b": "DEBUG", "a.b.c": "NOTSET", "z": "nonsense"}
    manager = logging.Manager(root := logging.RootLogger(logging.WARNING))
    for k, v in overrides.items():
        manager.getLogger(k).setLevel(logs.level_number(v, 30))
    rows = [(name, level) for name in ("a", "a.b", "a.b.c", "a.b.c.d", "ab", "z.y", "q") for level in (10, 20, 30, 40)]
    want = {(n, x) for n, x in rows if x >= manager.getLogger(n).getEffectiveLevel()}
    assert root.level == 30 and set(kept(spark, "WARNING", overrides, rows)) == want


@pytest.mark.parametrize(("config", "want"), [({"smtp_user": "", "notify_email": "a@x"}, ""), ({"notify_email": "a@x"}, "a@x"), ({"smtp_user": "u", "notify_email": "a@x"}, "u")])
def test_sender(spark, config, want):
    assert spark.createDataFrame([(config,)], "c map<string,string>").select(sender(F.col("c"))).first()[0] == want


@pytest.mark.parametrize(("host", "to", "topic", "want"), [("", "", "", []), ("h", "", "", []), ("h", "a", "", ["email"]), ("", "a", "t", ["push"]), ("h", "a", "t", ["email", "push"]), (None, None, None, [])])
def test_channels(spark, host, to, topic, want):
    df = spark.createDataFrame([("s", "b", {"smtp_host": host, "notify_email": to, "ntfy_topic": topic})], "subject string, body string, config map<string,string>")
    planned = notify.plan(df)
    assert [r["channel"] for r in planned.orderBy("position").collect()] == want
    seen = []

    def send(row):
        seen.append(row["channel"])
        if row["channel"] == "email":
            raise OSError("down")

    assert notify.deliver(planned, send) == want.count("push") and seen == want


def test_view(spark):
    rows = [(1, ("0.1", "idle")), (2, ("0.1", "working")), (3, ("", "idle")), (4, None)]
    got = status.view_state(spark.createDataFrame(rows, "i int, response struct<version:string,status:string>")).orderBy("i").collect()
    assert [tuple(r)[2:] for r in got] == [("status-dot idle", "idle", False, "v0.1"), ("status-dot working", "working", True, "v0.1"), ("status-dot idle", "idle", False, None), ("status-dot", "unreachable", False, None)]


@pytest.mark.parametrize(("body", "want"), [
    ('{"version": "0.1", "status": "idle"}', ("status-dot idle", "idle", False, "v0.1")), ('{"status": "working", "more": [1]}', ("status-dot working", "working", True, None)),
    (' \n{"status": "idle", "version": "a,b]}"}\t', ("status-dot idle", "idle", False, "va,b]}")),
    *((x, ("status-dot", "unreachable", False, None)) for x in ('{"version":"1","status":"idle"} xyz', "{'status':'idle'}", '{"status":"idle"}{"status":"idle"}', '{"status":"idle"},{"status":"idle"}', '{"status":"idle"},"x":2', '{"status":"idle"}] [', '{"status":"idle","n":NaN}', "{status:1}", None, "", "<html>", '{"version": "0.1"', '{"version": "0.1"}', "[]", "7", "null")),
])
def test_view_of_raw_body(spark, body, want):
    df = spark.createDataFrame([(body,)], "b string").select(status.parsed(F.col("b")).alias("response"))
    assert tuple(status.view_state(df).first())[1:] == want


def test_repeated_overrides(spark):
    df = spark.createDataFrame([("a.b", 20), ("a.b", 40), ("c", 10)], "logger string, levelno int")
    own = spark.createDataFrame([("a", 30), ("a", 40), ("a", 20), (None, 50), ("c", None)], "logger string, level int")
    assert [tuple(r) for r in logs.filter_levels_by(df, own, "DEBUG").collect()] == [("a.b", 40), ("c", 10)]


def test_driver_log_rotates(tmp_path, capsys):
    import logging

    top = logging.getLogger()
    before, level = [*top.handlers], top.level
    top.handlers = []
    try:
        path = tmp_path / "latest.log"
        driver_log.configure("nonsense", str(path), 300, 2, {"quiet": "ERROR"})
        driver_log.configure("debug", str(path), 300, 2, {"quiet": "ERROR"})  # once more: no line is doubled
        logging.getLogger("quiet.x").warning("dropped")
        for i in range(12):
            logging.getLogger("x").info("line %d", i)
        try:
            raise ValueError("boom")
        except ValueError:
            logging.getLogger("x").exception("failed")
        shown = capsys.readouterr().out
        assert shown.count("line 7") == 1 and "dropped" not in shown and "ValueError: boom" in shown and " | Info     | test_cases.py:" in shown
        assert sorted(p.name for p in tmp_path.iterdir()) == ["latest.log", "latest.log.1", "latest.log.2"]
        logging.getLogger("quiet").addHandler(own := logging.NullHandler())
        driver_log.configure("INFO", "", overrides={"quiet": "NOTSET", "odd": "nonsense"})
        assert logging.getLogger("quiet.x").getEffectiveLevel() == 20 and logging.getLogger("odd").level == 30 and logging.getLogger("quiet").handlers == [own]
        assert [type(h).__name__ for h in top.handlers] == ["StreamHandler"] and top.level == 20
    finally:
        for h in [*top.handlers]:
            top.removeHandler(h)
            h.close()
        top.handlers, top.level = before, level
        logging.getLogger("quiet").setLevel(0)


@pytest.mark.parametrize(("level", "failed"), [(10, True), (20, True), (50, False), (45, False)])
def test_driver_log_like_columns(spark, level, failed):
    """Both renderings of one record are the same, in plain and in colour."""
    import logging
    from logging.config import dictConfig
    import time

    record = logging.LogRecord("x", level, "/a/some.py", 7, "hi %s", ("you",), None)
    if failed:
        try:
            raise ValueError("boom")
        except ValueError:
            import sys

            record.exc_info = sys.exc_info()
    text = logging.Formatter().formatException(record.exc_info) if failed else None
    at = time.strftime("%Y-%m-%d %H:%M:%S", time.localtime(record.created))
    c = F.col
    df = spark.createDataFrame([(level, logging.getLevelName(level), "some.py", 7, "hi you", text)], "l int, ln string, f string, n int, m string, e string").withColumn("ts", F.lit(at).cast("timestamp"))
    for coloured in (False, True):
        declared = driver_log.settings("DEBUG", coloured=coloured)
        dictConfig(declared | {"handlers": {"console": declared["handlers"]["console"]}, "root": {"handlers": []}, "loggers": {"tidemill.test": {"handlers": ["console"]}}})
        handler = logging.getLogger("tidemill.test").handlers[0]
        assert handler.filter(record)
        assert handler.format(record) == df.select(log_line(c("ts"), c("l"), c("ln"), c("f"), c("n"), c("m"), c("e"), coloured)).first()[0]


def test_stream(spark, sf_dir, tmp_path):
    from tidemill.plans.queries import records
    from tidemill.streaming.logs import log_lines

    batch = records(spark, sf_dir)
    batch.write.parquet(str(tmp_path / "in"))
    q = log_lines(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), "ERROR").writeStream.format("memory").queryName("lines").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("lines").count() == log_lines(batch, "ERROR").count() > 0
