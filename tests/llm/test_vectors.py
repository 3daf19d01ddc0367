"""Exact search and hard negatives against every pair, in plain Python."""

from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import negatives, pivots, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, vec int, ids string, asked string, batch int, part int, block string, width int, best int, pivot int, bar int, score int, rank int"


def table(seed: int, n: int, width: int, copies: int = 0) -> list[tuple]:
    """Clusters, copies of one vector (as many as asked for), repeated rows, ids that repeat with other vectors, and rows that take no part."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(5, width))
    vecs = [(middle[i % 5] + rng.normal(size=width) * 0.3).astype(np.float32).tolist() for i in range(n)]
    rows = [(i, v, i % 5) for i, v in enumerate(vecs)]
    rows += [(1000 + i, vecs[3], i % 2) for i in range(copies)]
    rows += [rows[0], rows[0], rows[50 % n], (0, vecs[1], 0), (50, vecs[2], None), (-50, vecs[4], 4), (7, vecs[4], 9)]
    rows += [(None, vecs[0], 1), (100, None, 1), (150, [], 2), (200, [1.0, None], 1), (250, [float("nan")] * width, 1), (300, [float("inf")] * width, 1), (350, [0.5], 3), (400, [0.0] * width, 3), (450, [-0.0] * width, 3), (21, [2.0] * (width + 3), 1)]
    return [(*r, *[5, "i", "a", 1, 2, "b", 3, 4, 5, 6, 7, 8]) for r in rows]


def usable(rows):
    return [(i, [floor(256 * float(np.float32(x))) for x in v], label) for i, v, label, *_ in rows if i is not None and v is not None and all(x is not None and isfinite(x) for x in v)]


def product(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def brute_search(rows, step, k):
    kept, out = usable(rows), []
    for n, (q, x, _) in enumerate(kept):
        if q % step == 0:
            best = sorted((-product(x, y), i) for m, (i, y, _) in enumerate(kept) if m != n)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def brute_negatives(rows, step, positives=5, most=3):
    kept, out = [(i, x, label) for i, x, label in usable(rows) if label is not None], []
    for n, (a, x, label) in enumerate(kept):
        if a % step == 0:
            scored = sorted((-product(x, y), i, other) for m, (i, y, other) in enumerate(kept) if m != n)
            for s, p, _ in [z for z in scored if z[2] == label][:positives]:
                inside = [z for z in scored if z[2] != label and 50 * -s <= 100 * -z[0] <= 95 * -s][:most]
                out += [(a, p, r, i, -s, -z) for r, (z, i, _) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "n", "width", "copies"), [(1, 60, 4, 0), (2, 120, 8, 40), (3, 30, 2, 200)])
def test_search_and_negatives(spark, seed, n, width, copies):
    rows = table(seed, n, width, copies)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    step = F.col("vec_id") % 10 == 0
    got = [tuple(r) for r in pivots.search(df, step, block=16).collect()]
    assert sorted(got) == brute_search(rows, 10, 5)
    found = [tuple(r) for r in negatives.mine(df, F.col("label"), step, block=16).collect()]
    assert sorted(found) == brute_negatives(rows, 10) and found


def test_fewer_rows_than_asked_for(spark):
    df = spark.createDataFrame([(0, [1.0], 1), (50, [2.0], 1), (1, [0.5], 2)], "vec_id long, embedding array<double>, label int")
    step = F.col("vec_id") % 50 == 0
    assert sorted(map(tuple, pivots.search(df, step).collect())) == [(0, 1, 50, 131072), (0, 2, 1, 32768), (50, 1, 0, 131072), (50, 2, 1, 65536)]
    assert sorted(map(tuple, negatives.mine(df, F.col("label"), step).collect())) == [(50, 0, 1, 1, 131072, 65536)]
    assert pivots.search(df.limit(0), step).count() == negatives.mine(df.limit(0), F.col("label"), step).count() == 0
    assert pivots.search(df.limit(1), step).count() == 0


def test_products_beyond_doubles_and_64_bits(spark):
    a = np.array([[1 << 40, 3], [1 << 62, 1 << 62], [-(1 << 62), 0]])
    top = np.iinfo(np.int64).max
    assert vectors.products(a, a).tolist() == [[top, top, -top - 1], [top, top, -top - 1], [-top - 1, -top - 1, top]]
    assert vectors.products(np.array([[1 << 29, 1]]), np.array([[1 << 29, 1]])).tolist() == [[(1 << 58) + 1]]
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in pivots.search(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, top), (0, 2, 2, -top - 1)]


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 1, size=(200, 16)) for c in (-60, 0, 60)]).astype(np.int64)
    space = pivots.Space(x[::3], float((x.astype(float) ** 2).sum(axis=1).max()))
    away = space.rows(x)
    near = away.argmin(axis=1)
    order = np.lexsort((away[np.arange(len(x)), near], near))
    queries, cut = x[::50], 0
    bounds = pivots.Bounds(space, queries)
    for pivot in np.unique(near):
        own = order[near[order] == pivot]
        for at in range(0, len(own), 8):
            part = own[at : at + 8]
            d = away[part, pivot]
            got = bounds.of(np.array([pivot]), d[:1], d[-1:], np.sqrt((x[part] ** 2).sum(axis=1).max(keepdims=True)))[:, 0]
            best = (queries @ x[part].T).max(axis=1)
            assert (got >= best).all()
            cut += int((got < np.sort(queries @ x.T, axis=1)[:, -5]).sum())
    assert cut > 0.3 * len(queries) * len(x) / 8


def test_keys_sort_as_records_stream():
    rng = np.random.default_rng(3)
    rows = [(int(a), int(s), bool(p), int(i)) for a, s, p, i in zip(rng.integers(0, 3, 400), rng.integers(-5, 5, 400), rng.integers(0, 2, 400), rng.integers(-9, 9, 400), strict=True)]
    rows += [(0, vectors.LEAST, True, vectors.LEAST), (2, -vectors.LEAST - 1, False, -vectors.LEAST - 1)]
    keys = sorted(negatives.key(*r) for r in rows)
    assert [negatives.unkeyed(k) for k in keys] == sorted(rows, key=lambda r: (r[0], -r[1], not r[2], r[3]))
    sent = [(negatives.key(1, 100, True, 4), 0), (negatives.key(1, 95, False, 5), 0), (negatives.key(1, 90, False, 6), 0), (negatives.key(1, 80, False, 7), 0), (negatives.key(2, 80, False, 7), 0)]
    assert list(negatives.emitted(iter(sent), 2)) == [(1, 4, 1, 5, 100, 95), (1, 4, 2, 6, 100, 90)]
