"""Rolling hashes of code points, vectorised over many texts at once."""

from __future__ import annotations

import numpy as np

_B = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POW: dict[str, np.ndarray] = {}


def _powers(base: int, n: int, key: str) -> np.ndarray:
    have = _POW.get(key)
    if have is None or len(have) < n:
        n = max(n, 1 << 16)
        out = np.full(n, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
        out[0] = 1
        _POW[key] = have = np.multiply.accumulate(out)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Rolling:
    """Hashes of any stretch of ``codes`` in constant time: sums of mixed codes times powers, mod 2**64."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.up = _powers(_B, n + 1, "up")
        self.down = _powers(pow(_B, -1, 1 << 64), n + 1, "down")
        self.sum = np.zeros(n + 1, np.uint64)
        v = mix(codes.astype(np.uint64) + np.uint64(0x51ED270B7A2F))
        v *= self.up[:n]
        np.cumsum(v, out=self.sum[1:])

    def grams(self, k: int) -> np.ndarray:
        """Mixed hash of every stretch of ``k`` codes, by its start."""
        n = len(self.sum) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = self.sum[k:] - self.sum[:-k]
        h *= self.down[:n]
        return mix(h)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hash of each stretch [start, end), its length included."""
        h = (self.sum[end] - self.sum[start]) * self.down[start]
        return mix(h ^ ((end - start).astype(np.uint64) * _M1))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours, by the first, from prefix and suffix minima of blocks of ``w``."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = (-len(x)) % w
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]) if pad else x
    y = y.reshape(-1, w)
    first = np.minimum.accumulate(y, axis=1).ravel()
    last = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(last[:n], first[w - 1 : w - 1 + n])
