"""Word shingles and MinHash values of many texts at once, in numpy.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. A unit (a text, or a line of one) has as its set the
distinct hashes of its windows of five words; with fewer words the whole sequence is one shingle, without
words the set is empty.
"""

from __future__ import annotations

import hashlib

import numpy as np

WIDTH = 5
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD1B54A32D192ED03)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base, or of its inverse, modulo 2**64."""
    if len(_powers[kind]) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 2**64)
        step = np.full(max(n, 1 << 20), base, np.uint64)
        step[0] = 1
        _powers[kind] = np.multiply.accumulate(step)
    return _powers[kind][:n]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte of every word, and first byte of every text (one more at the end), and the bytes themselves."""
    joined = b"\n".join(texts).lower() + b"\n"
    data = np.frombuffer(joined, np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~_BLANK[data]
    edges = np.flatnonzero(np.diff(solid))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * _power("up", len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("down", len(data) + 1)[starts] + (ends - starts).astype(np.uint64)), starts, offsets, data


def shingles(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all units in order, and the first shingle of each; `first` holds each unit's first word (and the end)."""
    n = np.diff(first)
    count = np.where(n >= WIDTH, n - WIDTH + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(at[-1], np.uint64)
    long_ = np.flatnonzero(n >= WIDTH)
    if len(long_):
        total = np.zeros(len(hashes) - WIDTH + 1, np.uint64)
        for i in range(WIDTH):
            total = total * _STEP + hashes[i : len(total) + i]
        # Windows inside a unit, and their places in the output.
        take = np.repeat(first[long_] - at[long_], count[long_])
        place = np.arange(at[-1])[np.repeat(n >= WIDTH, count)]
        out[place] = mix(total[place + take])
    for size in range(1, WIDTH):
        short = np.flatnonzero(n == size)
        total = np.full(len(short), size, np.uint64)
        for i in range(size):
            total = total * _STEP + hashes[first[short] + i]
        out[at[short]] = mix(total + np.uint64(1))
    return out, at


def coordinates(values: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """MinHash signatures (units x k) of units that all have a shingle."""
    rng = np.random.default_rng(1)
    odd = rng.integers(0, 2**64, k, np.uint64, False) | np.uint64(1)
    add = rng.integers(0, 2**64, k, np.uint64, False)
    out = np.empty((len(at) - 1, k), np.uint64)
    for i in range(k):
        out[:, i] = np.minimum.reduceat(values * odd[i] + add[i], at[:-1])
    return out


def sets(values: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingles of each unit."""
    return [np.unique(values[a:b]) for a, b in zip(at[:-1], at[1:])]


def digest(values: np.ndarray) -> int:
    """Signed 64-bit digest of a set."""
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)
