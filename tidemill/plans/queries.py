"""Registered queries over the given tables, each with the SQL that gives the same rows.

The tables hold no log records, configurations or badges. Each query derives them from table columns by
an expression stated in its docstring, so its work grows with the table.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.config import push_url, sender, setting, smtp_port
from tidemill.functions.logs import log_line
from tidemill.functions.text import version_of
from tidemill.operators import logs, notify, status
from tidemill.sources.tables import table

#: Overrides used by the log queries, by logger name.
OVERRIDES = {"app.error": "ERROR", "app.click": "CRITICAL", "app.click.u3": "NOTSET", "app.view": "WARNING", "app.view.u1": "DEBUG", "app.sign": "CRITICAL"}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records from ``events``, a stand-in: the logger is app.<type>.u<user % 5>, the level goes by event_id."""
    e = table(spark, sf_dir, "events")
    names = {10: "DEBUG", 20: "INFO", 30: "WARNING", 40: "ERROR", 50: "CRITICAL", 60: "Level 60"}
    levelno = ((F.col("event_id") % 6 + 1) * 10).cast("int")
    return e.select(
        "event_id",
        F.concat(F.lit("app."), "event_type", F.lit(".u"), (F.col("user_id") % 5).cast("string")).alias("logger"),
        F.col("ts").cast("timestamp").alias("ts"),
        levelno.alias("levelno"),
        F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), levelno).alias("levelname"),
        F.concat("event_type", F.lit(".py")).alias("filename"),
        F.col("user_id").alias("lineno"),
        F.col("props").alias("msg"),
        F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("Error: "), F.col("event_type"))).alias("exc"),
    )


_LINE = "ts", "levelno", "levelname", "filename", "lineno", "msg", "exc"


def log_render(spark, sf_dir):
    """Every event as a plain and as a coloured log line."""
    cols = [F.col(c) for c in _LINE]
    return records(spark, sf_dir).select("event_id", log_line(*cols).alias("line"), log_line(*cols, colour=True).alias("coloured"))


def log_level_filter(spark, sf_dir):
    """Events that pass the thresholds of their loggers, as lines."""
    cols = [F.col(c) for c in _LINE]
    return logs.filter_levels(records(spark, sf_dir), "INFO", OVERRIDES).select("event_id", "logger", "levelno", log_line(*cols).alias("line"))


def log_level_filter_table(spark, sf_dir):
    """The same with overrides in a table: each event type is a logger whose level goes by its name's length."""
    r = records(spark, sf_dir)
    own = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("app."), "event_type").alias("logger")).agg(((F.length(F.first("event_type")) % 4 + 2) * 10).cast("int").alias("level"))
    return logs.filter_levels_by(r, own, "INFO").select("event_id", "logger", "levelno")


def log_routing(spark, sf_dir):
    """How many records go to each sink, the file being set for two event types only."""
    path = F.when(F.col("filename").isin("click.py", "error.py"), "latest.log").when(F.col("filename") == "view.py", "")
    return records(spark, sf_dir).select(F.explode(logs.sinks(path)).alias("sink"), "filename").groupBy("sink", "filename").agg(F.count("*").alias("n"))


def version_extract(spark, sf_dir):
    """Version of every page: two of three get a badge built from the page's id put behind its text."""
    p = table(spark, sf_dir, "pages")
    i = F.col("page_id")
    badge = F.when(i % 3 == 0, F.concat(F.lit(" img.shields.io/badge/version-"), (i % 7).cast("string"), F.lit("."), (i % 10).cast("string"), F.when(i % 2 == 0, "--rc1").otherwise(""), F.lit("-blue"))).when(i % 3 == 1, " img.shields.io/badge/version--blue").otherwise("")
    return p.select("page_id", version_of(F.concat("html", badge)).alias("version"))


def status_row(spark, sf_dir):
    """The status object of every customer's node as JSON, its version made of the customer's keys."""
    v = F.concat(F.col("c_nationkey").cast("string"), F.lit("."), F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", v.alias("version")).select("c_custkey", status.status_of(F.col("version")).alias("s")).select("c_custkey", "s.version", "s.status", F.to_json("s").alias("body"))


def responses(spark, sf_dir):
    """The raw response body in every event, as parsed: a third is cut short, missing, followed by text or in single quotes; the others are idle, working, or without version."""
    i = F.col("event_id")
    whole = F.to_json(F.struct(F.when(i % 5 == 0, "").otherwise((i % 9).cast("string")).alias("version"), F.when(i % 2 == 0, status.WORKING).otherwise(status.IDLE).alias("status")))
    body = F.when(i % 3 != 0, whole).when(i % 4 == 0, F.substring(whole, 1, 9)).when(i % 4 == 1, F.concat(whole, F.lit(" xyz"))).when(i % 4 == 2, F.translate(whole, '"', "'"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", status.parsed(body).alias("response"))


def status_view(spark, sf_dir):
    """View state of every event's response."""
    return status.view_state(responses(spark, sf_dir)).drop("user_id", "ts", "response")


def configs(spark, sf_dir):
    """A configuration for each customer: keys are missing, empty or set by the customer's key."""
    k = F.col("c_custkey")
    entry = lambda name, gone, empty, value: F.when(k % gone != 0, F.struct(F.lit(name).alias("key"), F.when(k % empty == 0, "").otherwise(value).alias("value")))
    mail = F.concat("c_name", F.lit("@example.org"))
    entries = F.array(
        entry("notify_email", 11, 7, mail), entry("smtp_host", 13, 5, F.lit("smtp.example.org")), entry("smtp_user", 3, 4, F.col("c_mktsegment")),
        entry("smtp_password", 4, 3, F.lit("x")), entry("smtp_port", 2, 17, F.lit("25")), entry("ntfy_topic", 5, 3, F.lower("c_mktsegment")), entry("ntfy_server", 2, 19, F.lit("https://push.example.org/")),
    )
    return table(spark, sf_dir, "customer").select("c_custkey", F.map_from_entries(F.filter(entries, lambda x: x.isNotNull())).alias("config"))


def config_defaults(spark, sf_dir):
    """Sender, port, server and push address of every customer's configuration."""
    c = F.col("config")
    return configs(spark, sf_dir).select("c_custkey", sender(c).alias("sender"), smtp_port(c).alias("port"), setting(c, "ntfy_server", F.lit("https://ntfy.sh")).alias("server"), push_url(c).alias("url"))


def notify_plan(spark, sf_dir):
    """The channels over which every customer's notification would go."""
    return notify.plan(configs(spark, sf_dir)).drop("config")


QUERIES = {f.__name__: f for f in (log_level_filter, log_render, log_level_filter_table, log_routing, version_extract, status_row, status_view, config_defaults, notify_plan)}

_RECORDS = """records AS (
  SELECT event_id, 'app.' || event_type || '.u' || (user_id % 5) AS logger, ts, CAST((event_id % 6 + 1) * 10 AS INT) AS levelno, event_type,
    CASE event_id % 6 WHEN 0 THEN 'Debug   ' WHEN 1 THEN 'Info    ' WHEN 2 THEN 'Warning ' WHEN 3 THEN 'Error   ' WHEN 4 THEN 'Critical' ELSE 'Level 60' END AS shown,
    CASE event_id % 6 WHEN 0 THEN chr(27) || '[36m' WHEN 1 THEN chr(27) || '[94m' WHEN 2 THEN chr(27) || '[33m' WHEN 3 THEN chr(27) || '[31m' WHEN 4 THEN chr(27) || '[91m' ELSE '' END AS colour,
    rpad(event_type || '.py:' || user_id, CAST(greatest(25, length(event_type || '.py:' || user_id)) AS INT), ' ') AS place,
    props || CASE WHEN event_id % 10 = 0 THEN chr(10) || 'Error: ' || event_type ELSE '' END AS msg
  FROM events), lines AS (
  SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' | ' || shown || ' | ' || place AS head FROM records)"""

_CONFIG = """c AS (
  SELECT c_custkey,
    CASE WHEN c_custkey % 11 <> 0 THEN CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name || '@example.org' END END AS email,
    CASE WHEN c_custkey % 13 <> 0 THEN CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'smtp.example.org' END END AS host,
    CASE WHEN c_custkey % 3 <> 0 THEN CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END END AS usr,
    CASE WHEN c_custkey % 4 <> 0 THEN CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'x' END END AS pw,
    CASE WHEN c_custkey % 2 <> 0 THEN CASE WHEN c_custkey % 17 = 0 THEN '' ELSE '25' END ELSE '587' END AS port,
    CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 3 = 0 THEN '' ELSE lower(c_mktsegment) END END AS topic,
    CASE WHEN c_custkey % 2 <> 0 THEN CASE WHEN c_custkey % 19 = 0 THEN '' ELSE 'https://push.example.org/' END ELSE 'https://ntfy.sh' END AS server
  FROM customer), d AS (SELECT *, CASE WHEN c_custkey % 3 <> 0 THEN usr ELSE email END AS sender, server || '/' || topic AS url FROM c)"""

ORACLE_SQL = {
    "log_render": f"WITH {_RECORDS} SELECT event_id, head || ' | ' || msg AS line, colour || head || ' |' || chr(27) || '[0m ' || CASE WHEN levelno = 10 THEN chr(27) || '[90m' || msg || chr(27) || '[0m' ELSE msg END AS coloured FROM lines",
    "log_level_filter": f"""WITH {_RECORDS} SELECT event_id, logger, levelno, head || ' | ' || msg AS line FROM lines WHERE levelno >= CASE
      WHEN event_type = 'view' AND logger = 'app.view.u1' THEN 10 WHEN event_type = 'error' THEN 40 WHEN event_type = 'click' THEN 50 WHEN event_type = 'view' THEN 30 ELSE 20 END""",
    "log_level_filter_table": f"WITH {_RECORDS} SELECT event_id, logger, levelno FROM records WHERE levelno >= (length(event_type) % 4 + 2) * 10",
    "log_routing": """WITH r AS (SELECT event_type || '.py' AS filename, event_type FROM events)
      SELECT 'console' AS sink, filename, count(*) AS n FROM r GROUP BY ALL
      UNION ALL SELECT 'file', filename, count(*) FROM r WHERE event_type IN ('click', 'error') GROUP BY ALL""",
    "version_extract": """SELECT page_id, CASE WHEN v = '' OR v IS NULL THEN 'unknown' ELSE v END AS version FROM (
      SELECT page_id, regexp_extract(html || CASE page_id % 3 WHEN 0 THEN ' img.shields.io/badge/version-' || (page_id % 7) || '.' || (page_id % 10) || CASE WHEN page_id % 2 = 0 THEN '--rc1' ELSE '' END || '-blue'
        WHEN 1 THEN ' img.shields.io/badge/version--blue' ELSE '' END, 'img\\.shields\\.io/badge/version-([^-]+)-', 1) AS v FROM pages)""",
    "status_row": """SELECT c_custkey, c_nationkey || '.' || c_custkey AS version, 'idle' AS status,
      '{"version":"' || c_nationkey || '.' || c_custkey || '","status":"idle"}' AS body FROM customer""",
    "status_view": """SELECT event_id, CASE WHEN s IS NULL THEN 'status-dot' ELSE 'status-dot ' || s END AS dot_class, coalesce(s, 'unreachable') AS label, coalesce(s = 'working', false) AS working,
      CASE WHEN s IS NOT NULL AND event_id % 5 <> 0 THEN 'v' || (event_id % 9) END AS badge
      FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CASE WHEN event_id % 2 = 0 THEN 'working' ELSE 'idle' END END AS s FROM events)""",
    "config_defaults": f"WITH {_CONFIG} SELECT c_custkey, sender, port, server, url FROM d",
    "notify_plan": f"""WITH {_CONFIG}, e AS (SELECT *, coalesce(host <> '' AND email <> '', false) AS mail, coalesce(topic <> '', false) AS push FROM d)
      SELECT c_custkey, CAST(0 AS INT) AS position, 'email' AS channel, email AS target, sender, port, coalesce(usr <> '' AND pw <> '', false) AS login FROM e WHERE mail
      UNION ALL SELECT c_custkey, CAST(mail AS INT), 'push', url, NULL, NULL, false FROM e WHERE push""",
}
