"""Queries of the extensions: what the surveyed code names or leaves to later, over the given tables, with their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.tiles import PIXEL_BITS, tile_x, tile_y
from tidemill.operators import sketches, status as states
from tidemill.operators.asof import asof_join
from tidemill.operators.interpolate import WEIGHT, interpolate
from tidemill.operators.islands import islands
from tidemill.operators.outages import outages
from tidemill.operators.overlap import overlap_join
from tidemill.operators.pyramid import tile_sums, write_pyramid
from tidemill.operators.regions import within_join
from tidemill.plans.queries import responses
from tidemill.sources import polling
from tidemill.sources.tables import table
from tidemill.streaming import sessions as windows
from tidemill.streaming import status
from tidemill.streaming.replay import replayed, shared_folder, table_stream

#: Seconds: a job's timeout and a session's gap; how late an event may come; days between the orders' years and the events'.
TIMEOUT, DELAY, DAYS = 14_400, 600, 8_400
#: Zooms of the pyramid and of the tiles between whose stations is interpolated.
FINEST, STATIONS_AT = 8, 5
#: The zoom whose pixels are the corners of regions.
REGIONS_AT = 8


def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each user, as a job, starts working and is idle again: a stream over all events, as far as its watermark gets."""
    return replayed(status.transitions(table_stream(spark, f"{sf_dir}/events.parquet"), "user_id", "ts", TIMEOUT, DELAY))


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of all users, closed by the watermark of a stream over all events."""
    return replayed(windows.sessions(table_stream(spark, f"{sf_dir}/events.parquet"), "user_id", "ts", TIMEOUT, DELAY, F.max("value").alias("highest")))


def hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and hour, for the hours that the watermark of a stream over all events has passed."""
    return replayed(windows.tumbling(table_stream(spark, f"{sf_dir}/events.parquet"), "event_type", "ts", 3600, DELAY, F.min("event_id").alias("first_id")))


def activity_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of activity of all users in the table of events, open ones too."""
    return islands(table(spark, sf_dir, "events"), "user_id", "ts", TIMEOUT)


def latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the latest order before it of the customer whose key is the user's; orders are moved into the events' years."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("custkey"), F.col("ts").cast("timestamp").alias("ts"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey", (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(DAYS))).alias("ordered"))
    return asof_join(events, orders, "custkey", "ts", "ordered", tie="o_orderkey", bin_seconds=30 * 86_400)


def order_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of orders of one customer that were open at one time: from the order's date to the last shipment of its lines."""
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(last, "o_orderkey")
    pairs = overlap_join(orders, orders, "o_custkey", "o_orderdate", "shipped", F.col("a.o_orderkey") < F.col("b.o_orderkey"))
    return pairs.select(F.col("a.o_custkey").alias("custkey"), F.col("a.o_orderkey").alias("first_order"), F.col("b.o_orderkey").alias("second_order"), F.greatest("a.o_orderdate", "b.o_orderdate").alias("both_from"), F.least("a.shipped", "b.shipped").alias("both_to"))


def status_outages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each user's responses, as a node's, couldn't be read, by the view state of every event's response."""
    view = states.view_state(responses(spark, sf_dir))
    return outages(view, "user_id", "ts", F.col("label") == "unreachable")


def _placed(rows: DataFrame, lon: str, lat: str, zoom: int) -> DataFrame:
    """Rows with x and y of the places that two whole numbers stand for: the tables hold no coordinates. Longitudes and latitudes are whole hundredths of degrees."""
    east, north = F.expr(f"({lon}) % 36000 / 100.0D - 180.0D"), F.expr(f"({lat}) % 17000 / 100.0D - 85.0D")
    return rows.withColumns({"x": tile_x(east, zoom), "y": tile_y(north, zoom)})


_EVENT_AT, _CUSTOMER_AT = ("event_id * 7919", "event_id * 31 + user_id * 1047"), ("c_custkey * 6113", "c_custkey * 977")
#: Suppliers' places, how far their regions reach, and the regions' corners, as SQL.
_SUPPLIER_AT, _REACH = ("s_suppkey * 4513", "s_suppkey * 1933"), "s_suppkey * 37 % 30 * 100 + 200"
_DART = ("x", "y - r"), ("x + r", "y + r"), ("x", "y + shiftright(r, 2)"), ("x - r", "y + r")


def tile_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, their values in hundredths, by type and tile, of all zooms to the finest."""
    events = _placed(table(spark, sf_dir, "events"), *_EVENT_AT, FINEST)
    sums = tile_sums(events, F.col("x"), F.col("y"), F.round(F.col("value") * 100).cast("long"), ["event_type"])
    return write_pyramid(sums, FINEST, shared_folder(spark, "pyramid"), ["event_type"])


def station_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with an estimate between the balances, in hundredths, of the customers around it, who stand for stations."""
    zoom = STATIONS_AT + PIXEL_BITS
    events = _placed(table(spark, sf_dir, "events"), *_EVENT_AT, zoom).select("event_id", "x", "y")
    stations = _placed(table(spark, sf_dir, "customer"), *_CUSTOMER_AT, zoom).select("x", "y", F.round(F.col("c_acctbal") * 100).cast("long").alias("value"))
    return interpolate(events, stations, STATIONS_AT, "x", "y")


def daily_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By type: how many different events there are and quantiles of their values, from sketches stored by day and merged."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    folder, by = shared_folder(spark, "sketches"), ["event_type"]
    ids, values = (sketches.distinct_sketch(events, ["day", *by], F.col("event_id")), sketches.quantile_sketch(events, ["day", *by], F.col("value")))
    for name, sketch in (("ids", ids), ("values", values)):
        sketch.write.partitionBy("day").parquet(f"{folder}/{name}")
    ids, values = (spark.read.schema(s.schema).parquet(f"{folder}/{n}") for n, s in (("ids", ids), ("values", values)))
    different = sketches.distinct_estimate(sketches.merge_distinct(ids, by), by).withColumnRenamed("estimate", "n_ids")
    shares = sketches.quantile_estimate(sketches.merge_quantiles(values, by), by, [0.5, 0.95])
    return shares.withColumn("estimate", F.round("estimate", 6)).join(different, by)


def events_in_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the suppliers in whose regions it is. A supplier's region is a dart, which is hollow to the south, of a size that goes by the key."""
    zoom = REGIONS_AT + PIXEL_BITS
    events = _placed(table(spark, sf_dir, "events"), *_EVENT_AT, zoom).select("event_id", "x", "y")
    suppliers = _placed(table(spark, sf_dir, "supplier"), *_SUPPLIER_AT, zoom).withColumn("r", F.expr(_REACH))
    corner = lambda x, y: F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))
    darts = suppliers.select("s_suppkey", F.array(*(corner(x, y) for x, y in _DART)).alias("ring"))
    return within_join(events, darts).select("a.event_id", "b.s_suppkey")


def _page_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, as the responses of their hosts, recorded as a round and read again as a stream."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", _HOST, 1).alias("host"), F.col("html").alias("body"))
    folder = shared_folder(spark, "polls")
    polling.record(pages, folder)
    return polling.polls(spark, folder, pages.schema)


_HOST = "^[a-z]+://([^/]+)"


def page_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recorded response with the length and the digest of its body, as the stream over the recording gives it."""
    return replayed(_page_stream(spark, sf_dir).select("page_id", "host", F.length("body").alias("n_chars"), F.md5("body").alias("body_md5")))


def latest_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By host: responses, those without a body, and the digest of the latest."""
    told = replayed(_page_stream(spark, sf_dir).select("page_id", "host", F.md5("body").alias("body")))
    return polling.latest(told, "host", "page_id", "body")


QUERIES = {f.__name__: f for f in (page_polls, latest_polls, status_transitions, session_windows, hourly_windows, activity_islands, latest_orders, order_overlaps, status_outages, tile_pyramid, station_estimates, daily_sketches, events_in_regions)}

_TILES = """least({n} - 1, floor((({lon}) % 36000 / 100.0::DOUBLE - 180 + 180) / 360 * {n}))::BIGINT AS x, least({n} - 1, greatest(0,
  floor((0.5 - ln((1 + sin(radians(({lat}) % 17000 / 100.0::DOUBLE - 85))) / (1 - sin(radians(({lat}) % 17000 / 100.0::DOUBLE - 85)))) / (4 * pi())) * {n})))::BIGINT AS y"""
_PIXELS = 2 ** (STATIONS_AT + PIXEL_BITS)
_FACTOR = 1.01 / 0.99

_ISLANDS = f"""passed AS (SELECT 1000 * (epoch_ms(max(ts)) - {DELAY * 1000}) AS mark FROM events),
  gaps AS (SELECT user_id, ts, value, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL {TIMEOUT} SECOND, true) AS new FROM events),
  numbered AS (SELECT user_id, ts, value, sum(CAST(new AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM gaps),
  islands AS (SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n, max(value) AS highest FROM numbered GROUP BY user_id, island)"""

ORACLE_SQL = {
    "status_transitions": f"""WITH {_ISLANDS}, every AS (SELECT user_id, started AS changed_at, 'working' AS status FROM islands UNION ALL SELECT user_id, ended + INTERVAL {TIMEOUT} SECOND, 'idle' FROM islands)
      SELECT user_id, changed_at, status FROM every, passed WHERE epoch_us(changed_at) < mark""",
    "session_windows": f"WITH {_ISLANDS} SELECT user_id, started, ended + INTERVAL {TIMEOUT} SECOND AS ended, n, highest FROM islands, passed WHERE epoch_us(ended) + {TIMEOUT * 1_000_000} <= mark",
    "hourly_windows": f"""WITH {_ISLANDS}, hours AS (SELECT event_type, date_trunc('hour', ts) AS started, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY ALL)
      SELECT event_type, started, n, first_id FROM hours, passed WHERE epoch_us(started) + 3600000000 <= mark""",
    "page_polls": f"SELECT page_id, regexp_extract(url, '{_HOST}', 1) AS host, CAST(length(html) AS INT) AS n_chars, md5(html) AS body_md5 FROM pages",
    "latest_polls": f"""WITH h AS (SELECT page_id, regexp_extract(url, '{_HOST}', 1) AS host, md5(html) AS body FROM pages),
      r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id DESC NULLS LAST, body DESC NULLS LAST) AS k, count(*) OVER (PARTITION BY host) AS n, count(*) FILTER (body IS NULL) OVER (PARTITION BY host) AS n_failed FROM h)
      SELECT host, n, n_failed, page_id, body FROM r WHERE k = 1""",
    "activity_islands": f"WITH {_ISLANDS} SELECT user_id, started, ended, n FROM islands",
    "latest_orders": f"""SELECT event_id, user_id AS custkey, ts, o_orderkey, ordered FROM events ASOF LEFT JOIN
      (SELECT o_custkey, ordered, max(o_orderkey) AS o_orderkey FROM (SELECT *, o_orderdate + INTERVAL {DAYS} DAY AS ordered FROM orders) GROUP BY ALL) o ON user_id = o_custkey AND ts >= ordered""",
    "order_overlaps": """WITH o AS (SELECT o_orderkey, any_value(o_custkey) AS c, any_value(o_orderdate) AS s, max(l_shipdate) AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)
      SELECT a.c AS custkey, a.o_orderkey AS first_order, b.o_orderkey AS second_order, greatest(a.s, b.s) AS both_from, least(a.e, b.e) AS both_to
      FROM o a JOIN o b ON a.c = b.c AND a.o_orderkey < b.o_orderkey AND a.s < b.e AND b.s < a.e AND a.s < a.e AND b.s < b.e""",
    "status_outages": """WITH m AS (SELECT user_id, ts, bool_and(event_id % 3 = 0) AS down, count(*) AS k FROM events GROUP BY ALL),
      r AS (SELECT *, sum(CAST(NOT down AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS ups, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS following FROM m)
      SELECT user_id, min(ts) AS started, nullif(max(coalesce(following, TIMESTAMP '9999-01-01')), TIMESTAMP '9999-01-01') AS ended, CAST(sum(k) AS BIGINT) AS n FROM r WHERE down GROUP BY user_id, ups""",
    "tile_pyramid": f"""WITH p AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS v, z, {_TILES.format(lon=_EVENT_AT[0], lat=_EVENT_AT[1], n="(1 << z)")} FROM events, (SELECT CAST(unnest(range({FINEST + 1})) AS INT) AS z))
      SELECT event_type, z, x, y, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, min(v) AS lowest, max(v) AS highest FROM p GROUP BY ALL""",
    "station_estimates": f"""WITH t AS (SELECT event_id, {_TILES.format(lon=_EVENT_AT[0], lat=_EVENT_AT[1], n=_PIXELS)} FROM events),
      s AS (SELECT x AS sx, y AS sy, CAST(round(c_acctbal * 100) AS HUGEINT) AS v FROM (SELECT *, {_TILES.format(lon=_CUSTOMER_AT[0], lat=_CUSTOMER_AT[1], n=_PIXELS)} FROM customer)),
      w AS (SELECT event_id, v, {WEIGHT} // (pow(least(abs(sx - x), {_PIXELS} - abs(sx - x)), 2)::BIGINT + pow(sy - y, 2)::BIGINT + 1) AS w FROM t, s
        WHERE abs((sy >> 8) - (y >> 8)) <= 1 AND least(abs((sx >> 8) - (x >> 8)), {2**STATIONS_AT} - abs((sx >> 8) - (x >> 8))) <= 1),
      e AS (SELECT event_id, count(*) AS stations, CAST(sum(w * v) // sum(w) AS BIGINT) AS estimate FROM w GROUP BY event_id)
      SELECT event_id, x, y, coalesce(stations, 0) AS stations, estimate FROM t LEFT JOIN e USING (event_id)""",
    "daily_sketches": f"""WITH h AS (SELECT event_type, ('0x' || substr(md5(event_id::VARCHAR), 1, 15))::BIGINT AS h FROM events),
      r AS (SELECT event_type, h & 1023 AS register, max(51 - CASE WHEN h >> 10 > 0 THEN length(bin(h >> 10)) ELSE 0 END) AS rank FROM h GROUP BY ALL),
      d AS (SELECT event_type, 1024 - count(*) AS empty, 0.7213 / (1 + 1.079 / 1024) * 1024 * 1024 / (sum(pow(2.0::DOUBLE, -rank)) + 1024 - count(*)) AS raw FROM r GROUP BY event_type),
      i AS (SELECT event_type, CAST(round(CASE WHEN raw <= 2560 AND empty > 0 THEN 1024 * ln(1024.0::DOUBLE / empty) ELSE raw END) AS BIGINT) AS n_ids FROM d),
      v AS (SELECT event_type, share::DOUBLE AS share, row_number() OVER (PARTITION BY event_type, share ORDER BY value) AS rank, count(*) OVER (PARTITION BY event_type, share) AS n, value FROM events, (VALUES (0.5), (0.95)) s(share))
      SELECT event_type, share, round(2 * pow({_FACTOR!r}::DOUBLE, ceil(ln(value) / ln({_FACTOR!r}::DOUBLE))) / ({_FACTOR!r}::DOUBLE + 1), 6) AS estimate, n_ids
      FROM v JOIN i USING (event_type) WHERE rank = greatest(1, ceil(share * n))""",
    "events_in_regions": f"""WITH t AS (SELECT event_id, {_TILES.format(lon=_EVENT_AT[0], lat=_EVENT_AT[1], n=2 ** (REGIONS_AT + PIXEL_BITS))} FROM events),
      s AS (SELECT s_suppkey, {_REACH} AS r, {_TILES.format(lon=_SUPPLIER_AT[0], lat=_SUPPLIER_AT[1], n=2 ** (REGIONS_AT + PIXEL_BITS))} FROM supplier),
      e AS ({" UNION ALL ".join(f"SELECT s_suppkey, {a} AS x1, {b} AS y1, {c} AS x2, {d} AS y2 FROM s" for (a, b), (c, d) in zip(_DART, _DART[1:] + _DART[:1], strict=True)).replace("shiftright(r, 2)", "(r >> 2)")})
      SELECT event_id, s_suppkey FROM t, e WHERE (y1 > y) <> (y2 > y) AND CASE WHEN y2 > y1 THEN (x - x1) * (y2 - y1) < (y - y1) * (x2 - x1) ELSE (x - x1) * (y2 - y1) > (y - y1) * (x2 - x1) END
      GROUP BY event_id, s_suppkey HAVING count(*) % 2 = 1""",
}
