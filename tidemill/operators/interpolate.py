"""Interpolation between stations by inverse squared distances, within a tile and its neighbours."""

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.tiles import PIXEL_BITS

#: Weight of a station in the pixel itself.
WEIGHT = 10**9
#: Pixels of a tile's side, and of the square in which sums over a whole tile are found: more than two tiles' sides.
SIDE, SQUARE = 1 << PIXEL_BITS, 4 << PIXEL_BITS
#: Pairs of a target and a station up to which a tile's pairs are gone through one by one, and how many of them at a time.
PAIRS, CHUNK = 40_000_000, 1 << 18


def _words(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower and upper 64 bits of whole numbers' magnitudes, and their signs."""
    array = column.combine_chunks()
    if pa.types.is_decimal(array.type):
        lo, hi = np.frombuffer(array.buffers()[1], np.uint64).reshape(-1, 2)[array.offset : array.offset + len(array)].T.copy()
    else:
        lo = array.to_numpy().astype(np.int64).view(np.uint64)
        hi = (lo.view(np.int64) >> 63).view(np.uint64)
    minus = hi.view(np.int64) < 0
    low = np.where(minus, ~lo + np.uint64(1), lo)
    high = np.where(minus, ~hi + (low == 0).astype(np.uint64), hi)
    return low, high, np.where(minus, -1.0, 1.0)


def _digits(words: tuple[np.ndarray, np.ndarray, np.ndarray], bits: int) -> Iterator[np.ndarray]:
    """Digits to the base of 2^bits, lowest first, each with its number's sign, as floats."""
    lo, hi, sign = words
    mask, down, up = (np.uint64(n) for n in ((1 << bits) - 1, bits, 64 - bits))
    while True:
        yield (lo & mask).astype(float) * sign
        lo, hi = lo >> down | hi << up, hi >> down
        if not (lo.any() or hi.any()):
            return


def _weight(across: np.ndarray, down: np.ndarray, wide: int) -> np.ndarray:
    """Weights at the distances. A quotient of whole numbers below 2^31 that isn't whole is never rounded up to one that is."""
    if wide < SQUARE:
        across = across % wide
        across = np.minimum(across, wide - across)
    apart = across * across
    apart += down * down
    apart += 1
    return np.floor(np.divide(WEIGHT, apart, out=apart), out=apart)


def _by_pairs(px: np.ndarray, py: np.ndarray, sx: np.ndarray, sy: np.ndarray, wide: int, numbers: list) -> list[list[tuple[int, np.ndarray]]]:
    """Weighted sums of each of the numbers' digits: shift and sum. All weights of a tile are less than 2^36 together, so sums of 16 bits are exact."""
    digits = [[*_digits(n, 16)] for n in numbers]
    matrix, step = np.stack([d for ds in digits for d in ds], 1), max(1, CHUNK // len(sx))
    sums = np.concatenate([_weight(px[i : i + step, None] - sx, py[i : i + step, None] - sy, wide) @ matrix for i in range(0, len(px), step)])
    columns = iter(sums.T)
    return [[(16 * k, next(columns)) for k in range(len(ds))] for ds in digits]


@cache
def _kernel(wide: int) -> list[tuple[int, np.ndarray, float]]:
    """The weights by distance, in two parts of 15 bits: shift, transform, norm."""
    apart = np.arange(SQUARE, dtype=float)
    apart = np.where(apart < SQUARE // 2, apart, apart - SQUARE)
    weight = _weight(*np.meshgrid(apart, apart), wide)
    high = np.rint(weight / 2**15)
    return [(shift, np.fft.rfft2(part), float(np.linalg.norm(part))) for shift, part in ((0, weight - high * 2**15), (15, high))]


def _by_transform(px: np.ndarray, py: np.ndarray, sx: np.ndarray, sy: np.ndarray, wide: int, numbers: list) -> list[list[tuple[int, np.ndarray]]]:
    """The same sums for all pixels of the tile at once, as a convolution. Digits are so short that what floats lose stays below a quarter: rounding gives whole numbers back."""
    out, norm = [], max(n for *_, n in _kernel(wide))
    at = (py.astype(int), px.astype(int))
    lost = 2.0**-53 * 6 * np.log2(SQUARE * SQUARE) * norm
    for n in numbers:
        bits = next(b for b in (15, 12, 10, 8, 6, 4, 2, 1) if b == 1 or all(lost * np.linalg.norm(d) < 0.25 for d in _digits(n, b)))
        sums = []
        for k, digit in enumerate(_digits(n, bits)):
            grid = np.zeros((SQUARE, SQUARE))
            grid[sy.astype(int), sx.astype(int)] = digit
            spectrum = np.fft.rfft2(grid)
            sums += [(bits * k + shift, np.rint(np.fft.irfft2(spectrum * part, grid.shape)[at])) for shift, part, _ in _kernel(wide)]
        out.append(sums)
    return out


def _total(sums: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Whole numbers from their parts: as Python's where 64 bits may not hold them."""
    kind = np.int64 if sum(float(np.abs(x).max()) * 2.0**shift for shift, x in sums) < 2**62 else object
    return sum(x.astype(np.int64).astype(kind) * (1 << shift) for shift, x in sums)


def _estimated(tiles: int, pairs: int) -> Callable:
    """Estimates for a tile's places from the stations of its neighbourhood."""
    wide = tiles * SIDE

    def go(key: tuple, places: pa.Table, halo: pa.Table) -> pa.Table:
        names = ("_x", "_y", "stations", "estimate")
        if not places.num_rows or not halo.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        left, top = ((k.as_py() - 1) * SIDE for k in key)
        px, sx = places["_x"].to_numpy() - left, (halo["sx"].to_numpy() - left) % wide
        py, sy = places["_y"].to_numpy() - top, halo["sy"].to_numpy() - top
        way = _by_pairs if len(px) * len(sx) <= pairs else _by_transform
        wv, wn = map(_total, way(*(a.astype(float) for a in (px, py, sx, sy)), wide, [_words(halo["v"]), _words(halo["many"])]))
        mean = np.abs(wv) // wn * np.where(wv < 0, -1, 1)
        total = np.full(len(px), halo["many"].to_numpy().sum())
        return pa.table([places["_x"], places["_y"], pa.array(total), pa.array(mean.tolist(), pa.int64())], names=names)

    return go


def interpolate(targets: DataFrame, stations: DataFrame, zoom: int, x: str = "px", y: str = "py", value: str = "value", pairs: int = PAIRS) -> DataFrame:
    """All rows and columns of targets, with ``stations`` (how many were used) and ``estimate``, null where there are none.

    x and y are pixels of the zoom on both sides, value a whole number. The stations used are those in the target's tile and
    the eight around it; the map closes from east to west. A station d pixels away weighs WEIGHT / (1 + d^2), rounded down, and the estimate is
    the weighted mean, rounded towards 0: whole numbers throughout, so the order of rows changes nothing. Nulls take no part.

    Stations of one pixel are one, and so are targets. A station is dealt to nine tiles, and a tile's places meet them in one task: 65,536 places and
    nine times as many stations at most, however many rows crowd together. Up to ``pairs`` pairs are summed one by one; in a tile of more, sums for
    all its pixels are one convolution, whose time doesn't go by the number of rows. Both are exact.
    """
    tiles = 2**zoom
    tile = lambda c: F.shiftright(c, PIXEL_BITS)
    known = stations.select(F.col(x).cast("long").alias("sx"), F.col(y).cast("long").alias("sy"), F.col(value).cast("decimal(38,0)").alias("v")).dropna()
    known = known.groupBy("sx", "sy").agg(F.sum("v").alias("v"), F.count("*").alias("many"))
    around = F.array(*(F.lit(d) for d in (-1, 0, 1)))
    columns = F.array_distinct(F.transform(around, lambda d: F.pmod(tile("sx") + d, F.lit(tiles))))
    rows = F.filter(F.transform(around, lambda d: tile("sy") + d), lambda r: r.between(0, tiles - 1))
    halo = known.withColumn("tx", F.explode(columns)).withColumn("ty", F.explode(rows))

    kept = targets.select(F.struct("*").alias("_row"), F.col(x).cast("long").alias("_x"), F.col(y).cast("long").alias("_y"))
    places = kept.select("_x", "_y").dropna().distinct().withColumns({"tx": tile("_x"), "ty": tile("_y")})
    met = places.groupBy("tx", "ty").cogroup(halo.groupBy("tx", "ty"))
    found = met.applyInArrow(_estimated(tiles, pairs), "_x long, _y long, stations long, estimate long")
    return kept.join(found, ["_x", "_y"], "left").select("_row.*", F.coalesce("stations", F.lit(0)).cast("long").alias("stations"), "estimate")
