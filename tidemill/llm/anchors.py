"""Anchors of windows: rolling hashes of runs of units (bytes or words), and the smallest in each window.

Equal windows hold equal runs, so they have the same smallest run at the same place. Windows are therefore
told apart in two steps: windows in a row that share their anchor, the place of the smallest run, are one
range; and only anchors whose hash occurs again anywhere can belong to repeated windows.
"""

import functools

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INDEX = 26
_MASK = _U((1 << _INDEX) - 1)
#: Words of one array at most; a place must fit beside the hash by which the smallest run is found.
MOST = 1 << _INDEX


@functools.cache
def _powers(bits: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(1 << bits, b & (1 << 64) - 1, _U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=_U))
    return tuple(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


@functools.cache
def byte_values(seed: int) -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=_U) * _U(0x2545F4914F6CDD1D + 2 * seed))


class Rolling:
    """Hashes of all runs of an array of 64-bit values, by a polynomial modulo 2^64.

    Different runs may be made to collide, so these hashes choose anchors and buckets and never tell that two
    runs are equal.
    """

    def __init__(self, values: np.ndarray, seed: int = 0):
        bits = max(16, len(values).bit_length())
        base = (_BASE + 0x5851F42D4C957F2E * seed | 1) & (1 << 64) - 1
        power, self.back = _powers(bits, base)
        self.sums = np.zeros(len(values) + 1, _U)
        np.cumsum(values * power[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])

    def all(self, length: int) -> np.ndarray:
        n = max(0, len(self.sums) - length)
        return mixed((self.sums[length : length + n] - self.sums[:n]) * self.back[:n])


_PRIME = (1 << 31) - 1


@functools.cache
def _prime_powers(bits: int, base: int) -> np.ndarray:
    """Powers of a base modulo the prime."""
    out, step = np.ones(1, _U), base
    while len(out) < 1 << bits:
        out = np.concatenate((out, out * _U(step) % _U(_PRIME)))
        step = step * step % _PRIME
    return out


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of runs of bytes that also hold for runs made to collide modulo 2^64: a polynomial modulo a prime is mixed in."""
    bits, base = max(16, len(data).bit_length()), 0x3A5F1C7D
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((byte_values(1) % _U(_PRIME))[data] * _prime_powers(bits, base)[: len(data)] % _U(_PRIME), out=sums[1:])
    other = (sums[end] - sums[start]) % _U(_PRIME) * _prime_powers(bits, pow(base, -1, _PRIME))[start] % _U(_PRIME)
    return mixed(Rolling(byte_values(0)[data]).of(start, end) ^ mixed(other))


def smallest(runs: np.ndarray, width: int) -> np.ndarray:
    """By place: the place of the smallest of ``width`` runs from there on; the first of equal ones."""
    m, have = (runs & ~_MASK) | np.arange(len(runs), dtype=_U), 1
    while have < width:
        step = min(have, width - have)
        m = np.minimum(m[:-step], m[step:]) if len(m) > step else m[:0]
        have += step
    return (m & _MASK).astype(np.int64)


def ranges(at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each range. starts: the windows' places, in order."""
    if not len(starts):
        return starts, starts, starts
    anchor = at[starts]
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1))))
    return anchor[new], starts[new], np.diff(np.concatenate((new, [len(starts)])))


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range, one after the other."""
    total = int(n.sum())
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(total)


def groups(*keys: np.ndarray) -> list[tuple[int, int]]:
    """First and last + 1 of each run of rows with equal keys."""
    if not len(keys[0]):
        return []
    new = np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0)))
    at = [*np.flatnonzero(new).tolist(), len(keys[0])]
    return list(zip(at[:-1], at[1:], strict=True))


def collapse(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, first place and length of the runs of consecutive places, for places sorted by document."""
    if not len(at):
        return doc, at, at
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1))))
    return doc[new], at[new], np.diff(np.concatenate((new, [len(at)])))
