"""Hashes of substrings in numpy: prefix sums of a polynomial modulo 2**64, so that any span costs one subtraction and one multiplication."""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240611))
_VALUE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _power, _inverse
    if len(_power) >= n:
        return
    size = 1 << max(16, (n - 1).bit_length())

    def powers(b: int) -> np.ndarray:
        x = np.full(size, b, np.uint64)
        x[0] = 1
        return np.cumprod(x)

    _power, _inverse = powers(_BASE), powers(pow(_BASE, -1, 2**64))


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer: all bits of the result depend on all bits of h."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def spans(raw: bytes | np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The hash of raw[starts[i]:stops[i]] for each i. Equal bytes have equal hashes at any place."""
    a = np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw
    _grow(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_VALUE[a] * _power[: len(a)], out=sums[1:])
    return mixed((sums[stops] - sums[starts]) * _inverse[starts])
