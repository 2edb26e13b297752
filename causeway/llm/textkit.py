"""Vectorised hashing of bytes, words and shingles; windows of smallest values."""

from __future__ import annotations

import numpy as np

#: A word is a run of ASCII letters and digits (lower case) and of bytes outside ASCII.
_WORD = np.array([chr(b).isalnum() and b < 128 or b >= 128 for b in range(256)], bool)
_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_INVERSE, _INVERSE2 = (pow(b, -1, 1 << 64) for b in (_BASE, _BASE2))
SHINGLE = 5


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bytes_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))


_TABLES = {False: _bytes_table(1), True: _bytes_table(2)}
_LOW = 1 << 12


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` modulo 2^64 below n, as factors: the power i is high[i >> 12] * low[i & 4095]. A few KB at any n."""
    made = []
    for step, count in ((base, _LOW), (pow(base, _LOW, 1 << 64), n // _LOW + 1)):
        p = np.full(count, step, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    return made[1], made[0]


def _first_powers(power: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    high, low = power
    return (high[: n // _LOW + 1, None] * low[None, :]).ravel()[:n]


class RangeHash:
    """Hashes of any stretches [a, b) of some bytes or 64-bit values, equal for equal stretches wherever they stand."""

    def __init__(self, data: np.ndarray, second: bool = False):
        base, inverse = (_BASE2, _INVERSE2) if second else (_BASE, _INVERSE)
        self.inverse = _power(inverse, len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        values = _first_powers(_power(base, len(data)), len(data))
        values *= _TABLES[second][data] if data.dtype == np.uint8 else data
        np.cumsum(values, out=self.sums[1:])

    def every(self, width: int) -> np.ndarray:
        """The hashes of all stretches of one width, by start: as calling it, without the gathers."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * _first_powers(self.inverse, n) + np.uint64(width))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        high, low = self.inverse
        return mix((self.sums[b] - self.sums[a]) * high[a >> 12] * low[a & (_LOW - 1)] + (b - a).astype(np.uint64))


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts, where each text's words begin: one more entry than texts)."""
    low = [t.lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join(low) + b" ", np.uint8)
    is_word = _WORD[data]
    edge = np.diff(is_word.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lengths = np.fromiter(map(len, low), np.int64, len(low))
    begin = np.cumsum(np.r_[0, lengths + 1])
    return RangeHash(data)(starts, ends), np.searchsorted(starts, begin)


def shingles(hashes: np.ndarray, begin: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all runs of ``size`` words within a text, where each text's begin). A shorter text that has words is one run."""
    n = np.diff(begin)
    total = len(hashes)
    full = np.zeros(max(total - size + 1, 0), np.uint64)
    for k in range(size):
        full = full * np.uint64(0x9DDFEA08EB382D69) + hashes[k : k + len(full)]
    full = mix(full)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    out_begin = np.cumsum(np.r_[0, count])
    out = np.empty(out_begin[-1], np.uint64)
    text = np.repeat(np.arange(len(n)), count)
    at = begin[:-1][text] + np.arange(len(out)) - out_begin[:-1][text]
    long = n[text] >= size
    out[long] = full[at[long]]
    for k in np.flatnonzero((n > 0) & (n < size)):
        short = np.uint64(n[k])
        for h in hashes[begin[k] : begin[k + 1]]:
            short = np.uint64((int(short) * 0x9DDFEA08EB382D69 + int(h)) & 0xFFFFFFFFFFFFFFFF)
        out[out_begin[k]] = mix(np.array([short]))[0]
    return out, out_begin


def window_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, by its start, the place of the leftmost smallest one."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.arange(len(values), dtype=np.int32 if len(values) < 1 << 31 else np.int64)
    span = 1
    while span * 2 <= width:
        a, b = at[: len(at) - span], at[span:]
        at = np.where(values[a] <= values[b], a, b)
        span *= 2
    a, b = at[:n], at[width - span : width - span + n]
    return np.where(values[a] <= values[b], a, b)


