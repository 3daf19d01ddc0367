"""Outages, tile pyramids, interpolation, sketches and regions against plain Python."""

from datetime import datetime, timedelta
from fractions import Fraction
from math import asinh, ceil, floor, nan, pi, radians, tan
import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions.tiles import tile_x, tile_y
from tidemill.operators import sketches
from tidemill.operators.interpolate import WEIGHT, interpolate
from tidemill.operators.outages import outages
from tidemill.operators.pyramid import in_box, tile_sums, write_pyramid
from tidemill.operators.regions import within_join

ZERO = datetime(2024, 1, 1)


def at(seconds: float) -> datetime:
    return ZERO + timedelta(seconds=seconds)


def ordered(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=str)


def naive_outages(rows) -> list[tuple]:
    out = []
    for key in {k for k, t, _ in rows if t is not None}:
        moments = {}
        for k, t, down in rows:
            if k == key and t is not None:
                moments.setdefault(t, []).append(down is not False)
        begun, n = None, 0
        for t in sorted(moments):
            if all(moments[t]):
                begun, n = t if begun is None else begun, n + len(moments[t])
            elif begun is not None:
                out.append((key, at(begun), at(t), n))
                begun, n = None, 0
        if begun is not None:
            out.append((key, at(begun), None, n))
    return out


@pytest.mark.parametrize(("seed", "share"), [(1, 0.5), (2, 0.9), (3, 0.1)])
def test_outages(spark, seed, share):
    rng = random.Random(seed)
    state = lambda: None if rng.random() < 0.05 else rng.random() < share
    rows = [(rng.choice(("hot", "hot", "a", "b", None)), rng.choice((None, *[rng.randint(-3000, 3000)] * 19)), state()) for _ in range(500)]
    df = spark.createDataFrame([(k, None if t is None else at(t), d, 1) for k, t, d in rows], "id string, ts timestamp_ntz, failed boolean, key int")
    want = ordered(naive_outages(rows))
    for seconds in (7, 400, 86_400):  # how keys are cut changes nothing
        out = outages(df, "id", "ts", F.col("failed"), seconds)
        assert ordered(out.collect()) == want
    assert len(want) > 20 and (share < 0.5 or any(e is None for _, _, e, _ in want))
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert outages(df.limit(0), "id", "ts", F.col("failed")).count() == 0


def test_an_outage_that_spans_quiet_bins(spark):
    rows = [("a", at(0), False), ("a", at(5), True), ("a", at(95), True), ("a", at(95), False), ("a", at(96), True), ("b", at(50), True)]
    out = outages(spark.createDataFrame(rows, "k string, t timestamp, d boolean"), "k", "t", F.col("d"), 10)
    assert ordered(out.collect()) == [("a", at(5), at(95), 1), ("a", at(96), None, 1), ("b", at(50), None, 1)]


PLACES = [(0.0, 0.0), (-180.0, 85.06), (180.0, -85.06), (16.37, 48.21), (-74.0, 40.7), (151.2, -33.87), (179.999, 0.0001), (-0.0001, -0.0001), (0.0, 90.0)]


@pytest.mark.parametrize("zoom", [0, 1, 7, 13, 24])
def test_tiles(spark, zoom):
    got = spark.createDataFrame(PLACES, "lon double, lat double").select("lon", "lat", tile_x(F.col("lon"), zoom).alias("x"), tile_y(F.col("lat"), zoom).alias("y")).collect()
    n = 2**zoom
    for r in got:
        lat = max(-85.0511287798066, min(85.0511287798066, r["lat"]))
        x, y = floor((r["lon"] + 180) / 360 * n), floor((1 - asinh(tan(radians(lat))) / pi) / 2 * n)
        assert (r["x"], r["y"]) == (min(n - 1, x), min(n - 1, max(0, y)))


def test_what_has_no_tile(spark):
    rows = [(None, None), (nan, nan), (180.1, 90.1), (float("inf"), float("-inf"))]
    got = spark.createDataFrame(rows, "lon double, lat double").select(tile_x(F.col("lon"), 3), tile_y(F.col("lat"), 3)).collect()
    assert all(tuple(r) == (None, None) for r in got)


def test_every_zoom_equals_its_rows(spark, tmp_path):
    rng, zoom = random.Random(4), 6
    rows = [(rng.choice("pq"), rng.choice((5, rng.randrange(64), None)), rng.choice((5, rng.randrange(64))), rng.choice((None, rng.randint(-(10**12), 10**12)))) for _ in range(900)]
    df = spark.createDataFrame(rows, "kind string, x long, y long, v long")
    for by in (["kind"], []):
        found = write_pyramid(tile_sums(df, F.col("x"), F.col("y"), F.col("v"), by), zoom, str(tmp_path / f"p{len(by)}"), by)
        want = {}
        for kind, x, y, v in rows:
            for z in range(zoom + 1) if x is not None else ():
                want.setdefault((z, kind if by else "", x >> zoom - z, y >> zoom - z), []).append(v)
        sums = {k: (len(vs), *((sum(s), min(s), max(s)) if (s := [v for v in vs if v is not None]) else (None,) * 3)) for k, vs in want.items()}
        got = {(r["z"], r["kind"] if by else "", r["x"], r["y"]): (r["n"], r["total"], r["lowest"], r["highest"]) for r in found.collect()}
        assert got == sums and found.count() == len(got) > 200
    box = in_box(found, 4, 0, 0, 3, 9)
    assert {(r["x"], r["y"]) for r in box.collect()} == {(x, y) for z, _, x, y in sums if z == 4 and x <= 3 and y <= 9}
    assert "PartitionFilters: [isnotnull(z" in box._jdf.queryExecution().toString()
    empty = write_pyramid(tile_sums(df.limit(0), F.col("x"), F.col("y"), F.col("v")), 2, str(tmp_path / "none"))
    assert empty.count() == 0


@pytest.mark.parametrize("zoom", [0, 1, 3])
def test_interpolation(spark, zoom):
    rng, tiles = random.Random(5), 2**zoom
    wide = tiles * 256
    place = lambda: rng.choice((3, wide - 2, rng.randrange(wide)))
    stations = [(place(), place(), rng.choice((None, rng.randint(-(10**10), 10**10)))) for _ in range(60)] + [(None, 1, 1), (3, 3, 7), (3, 3, 8)]
    targets = [(i, rng.choice((place(), None)), place(), "note") for i in range(80)] + [(99, 3, 3, None)]
    out = interpolate(spark.createDataFrame(targets, "stn int, px long, py long, sx string"), spark.createDataFrame(stations, "px long, py long, value long"), zoom)
    assert out.columns == ["stn", "px", "py", "sx", "stations", "estimate"]
    got = {r["stn"]: (r["stations"], r["estimate"]) for r in out.collect()}
    for i, x, y, _ in targets:
        n = wv = wn = 0
        for sx, sy, v in stations if x is not None else ():
            if sx is None or v is None:
                continue
            apart = abs(sx // 256 - x // 256)
            if min(apart, tiles - apart) <= 1 and abs(sy // 256 - y // 256) <= 1:
                d = min(abs(sx - x), wide - abs(sx - x)) ** 2 + (sy - y) ** 2
                w = WEIGHT // (d + 1)
                n, wv, wn = n + 1, wv + w * v, wn + w
        mean = None if not n else abs(wv) // wn * (1 if wv >= 0 else -1)
        assert got[i] == (n, mean)
    assert zoom < 3 or len({v for v in got.values()}) > 20
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("zoom", [0, 1, 3])
def test_pairs_and_transforms_agree(spark, zoom):
    rng, wide = random.Random(9), 256 * 2**zoom
    place = lambda: rng.choice((0, 255, wide - 1, rng.randrange(wide)))
    stations = spark.createDataFrame([(place(), place(), rng.choice((1, 10**5, 10**18)) * rng.randint(-9, 9)) for _ in range(700)], "px long, py long, value long")
    targets = spark.createDataFrame([(place(), place()) for _ in range(300)], "px long, py long")
    one, other = (ordered(interpolate(targets, stations, zoom, pairs=pairs).collect()) for pairs in (10**12, 0))
    assert one == other and len(one) == 300


def test_interpolation_in_a_crowded_tile(spark):
    # 40,000 places meet 30,000 stations: 1.2 billion pairs, none of which may become a row.
    value = F.expr("(id * 7919 % 2000003 - 1000000) * if(id % 7 = 0, 100000000000, 1)")
    stations = spark.range(30_000).select(F.expr("256 + id % 150").alias("px"), F.expr("256 + id div 150").alias("py"), value.alias("value"))
    targets = spark.range(40_000).select("id", F.expr("256 + id % 200").alias("px"), F.expr("256 + id div 200").alias("py"))
    out = interpolate(targets, stations, 3)
    assert "CoGroup" in out._jdf.queryExecution().toString()
    got = {r["id"]: (r["stations"], r["estimate"]) for r in out.collect()}
    assert len(got) == 40_000
    known = [tuple(r) for r in stations.collect()]
    for i in (0, 77, 12_345, 39_999):
        weights = [(WEIGHT // ((x - 256 - i % 200) ** 2 + (y - 256 - i // 200) ** 2 + 1), v) for x, y, v in known]
        wv, wn = sum(w * v for w, v in weights), sum(w for w, _ in weights)
        assert got[i] == (30_000, abs(wv) // wn * (1 if wv >= 0 else -1))


def test_distinct_sketches(spark, tmp_path):
    sizes = {"few": 40, "some": 3000, "many": 60_000}
    rows = spark.createDataFrame([(k, n) for k, n in sizes.items()], "k string, n int").withColumn("v", F.explode(F.sequence(F.lit(1), "n"))).withColumn("again", F.explode(F.array(F.lit(1), F.lit(2))))
    whole = sketches.distinct_sketch(rows, ["k"], F.col("v"))
    folder = str(tmp_path / "ids")
    for day in (0, 1, 2, 1):  # a batch is replayed
        sketches.write_batch(sketches.distinct_sketch(rows.filter((F.col("v") + F.col("again")) % 3 == day), ["k"], F.col("v")), folder, f"d{day}")
    merged = sketches.merge_distinct(sketches.batches(whole, folder), ["k"])
    assert ordered(merged.collect()) == ordered(whole.collect())
    for r in sketches.distinct_estimate(merged, ["k"]).collect():
        assert abs(r["estimate"] - sizes[r["k"]]) <= 4 * 1.04 / 32 * sizes[r["k"]]
    none = spark.createDataFrame([("a", None)], "k string, v string")
    assert sketches.distinct_estimate(sketches.distinct_sketch(none, ["k"], F.col("v")), ["k"]).count() == 0


@pytest.mark.parametrize("error", [0.01, 0.1])
def test_quantile_sketches(spark, tmp_path, error):
    rng = random.Random(6)
    values = [*(rng.lognormvariate(0, 4) for _ in range(400)), *(-rng.lognormvariate(0, 2) for _ in range(300)), *[0.0] * 40, 1e300, -1e300, 1e-300, *[5.5] * 200]
    odd = [None, nan, float("inf"), -float("inf")]
    df = spark.createDataFrame([(i % 4, v) for i, v in enumerate(values + odd)], "part int, v double")
    whole = sketches.quantile_sketch(df, [], F.col("v"), error)
    folder = str(tmp_path / "values")
    for part in (0, 1, 2, 3, 2):
        sketches.write_batch(sketches.quantile_sketch(df.filter(F.col("part") == part), [], F.col("v"), error), folder, f"p{part}")
    merged = sketches.merge_quantiles(sketches.batches(whole, folder), [])
    assert ordered(merged.collect()) == ordered(whole.collect()) and sum(r["n"] for r in whole.collect()) == len(values)
    shares = [0.0, 0.001, 0.25, 0.3, 0.36, 0.5, 0.9, 0.999, 1.0]
    got = {r["share"]: r["estimate"] for r in sketches.quantile_estimate(merged, [], shares, error).collect()}
    exact = sorted(values)
    for share in shares:
        value = exact[max(1, ceil(share * len(values))) - 1]
        assert abs(got[share] - value) <= error * abs(value) * (1 + 1e-9)


def lies_in(x, y, ring) -> bool:
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > y) != (y2 > y) and Fraction(x) < x1 + Fraction((y - y1) * (x2 - x1), y2 - y1):
            odd = not odd
    return odd


def test_points_in_regions(spark):
    rng = random.Random(8)
    rings = [[(rng.randint(-r, r) + cx, rng.randint(-r, r) + cy) for _ in range(rng.randint(3, 7))] for r in (3, 10, 40, 200, 3000, 10**8) for cx in (0, 90) for cy in (0, -70)]
    rings += [[(0, 0), (10, 0), (10, 10), (0, 10)], [(10, 0), (20, 0), (20, 10), (10, 10), (10, 0)], [], [(1, 1)], [(0, 0), (5, 5)]]
    regions = spark.createDataFrame([*((i, [{"x": x, "y": y} for x, y in r]) for i, r in enumerate(rings)), (90, None), (91, [None, {"x": 0, "y": 0}, {"x": 5, "y": 9}]), (92, [{"x": None, "y": 0}, {"x": 0, "y": 0}, {"x": 5, "y": 9}])], "a int, ring array<struct<x:long,y:long>>")
    spots = [(rng.randint(-60, 120), rng.randint(-120, 60)) for _ in range(150)] + [(x, y) for x in (0, 10, 20) for y in (0, 5, 10)] + [(5, 5)] * 40 + [(10**7, -(10**7)), (None, 1), (1, None)]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(spots)], "id int, x long, y long")
    out = within_join(points, regions)
    got = sorted((r["a"]["id"], r["b"]["a"]) for r in out.collect())
    want = [(i, j) for i, (x, y) in enumerate(spots) for j, r in enumerate(rings) if None not in (x, y) and lies_in(x, y, r)]
    assert got == want and len({j for _, j in want}) > 12
    squares = {(i, j) for i, j in want if j in (24, 25) and spots[i] == (10, 5)}
    assert {j for _, j in squares} == {25}
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert within_join(points.limit(0), regions).count() == within_join(points, regions.limit(0)).count() == 0


def test_pairs_of_points_and_regions_are_not_shuffled(spark):
    # Every point is in every region, so pairs are a hundred times the points; 7 corners go by arrays, 4 by columns.
    points = spark.range(4000).select("id", F.expr("id % 50").alias("x"), F.expr("id div 50 % 50").alias("y"))
    square = [(-900, -900), (900, -900), (900, 900), (-900, 900)]
    for corners in (square, [*square, (-900, 300), (-900, 0), (-900, -300)]):
        ring = "array(" + ", ".join(f"named_struct('x', {x}L, 'y', {y}L)" for x, y in corners) + ")"
        regions = spark.range(100).select(F.col("id").alias("k"), F.expr(ring).alias("ring"))
        out = within_join(points, regions).select("a.id", "b.k")
        assert out.count() == 400_000 == out.distinct().count()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Join") == 1 + plan.count("Union")  # no join takes another's pairs


def test_wide_and_thin_regions(spark):
    rng = random.Random(12)
    at = lambda: (rng.randint(-500, 500), rng.randint(-500, 500))
    rings = [[at() for _ in range(n)] for n in (3, 4, 5, 6, 7, 12, 40) for _ in range(3)] + [[(-500, 0), (500, 1), (500, 2)], [(0, -500), (1, 500), (0, 500), (-1, 0)]]
    regions = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in r]) for i, r in enumerate(rings)], "k int, ring array<struct<x:int,y:int>>")
    spots = [at() for _ in range(200)] + [p for r in rings for p in r]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(spots)], "id int, x long, y long")
    got = sorted(tuple(r) for r in within_join(points, regions).select("a.id", "b.k").collect())
    assert got == [(i, j) for i, (x, y) in enumerate(spots) for j, r in enumerate(rings) if lies_in(x, y, r)]
