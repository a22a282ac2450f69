"""Word hashes of many texts at once with numpy.

A batch of texts is one byte array.  With random 64-bit values for the bytes and an odd base, prefix sums of value times
power of the base give the hash of every word by one subtraction and one product (all modulo 2^64).
"""

from __future__ import annotations

import sys
import types

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, salt: int) -> np.ndarray:
    """`n` odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE), salt) | np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse up to n; kept by the worker process."""
    store = sys.modules.setdefault("_webloom_powers", types.ModuleType("_webloom_powers"))
    if len(getattr(store, "up", ())) < n:
        inverse = np.uint64(pow(_BASE, -1, 2**64))
        store.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(_BASE))]), dtype=np.uint64)
        store.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]), dtype=np.uint64)
    return store.up, store.down


_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(77))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words are runs of bytes other than ASCII white space.

    Returns the hash of each word, the number of words of each text, and the first and last byte (exclusive) of each word
    within its text.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * up[:len(data)], dtype=np.uint64)])
    hashes = mix((sums[end] - sums[start]) * down[start])
    first = np.cumsum(sizes + 1) - sizes - 1
    counts = np.diff(np.searchsorted(start, np.concatenate([first, [len(data)]])))
    base = np.repeat(first, counts)
    return hashes, counts, start - base, end - base
