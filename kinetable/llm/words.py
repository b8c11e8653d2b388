"""Words and word shingles as 64-bit hashes, in numpy inside a task.

A text is lower-cased for A-Z only and cut at runs of space, tab, newline, vertical tab, form
feed and carriage return. Null counts as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(values: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: spreads every input bit over the result."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd_multipliers(count: int, seed: int) -> np.ndarray:
    """``count`` fixed odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        steps = np.arange(1, count + 1, dtype=np.uint64) * GOLDEN + np.uint64(seed)
    return mix(steps) | np.uint64(1)


_PLACES = odd_multipliers(64, 5)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def shingle_hashes(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """A hash for each run of ``size`` words; a shorter text is one shingle, no words give none."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(size, n)
    total = np.full(n - size + 1, np.uint64(size), np.uint64)
    for i in range(size):
        total += hashes[i : n - size + 1 + i] * _PLACES[i % len(_PLACES)]
    return mix(total)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(word_hashes(words(text)), size))


def texts(column: pa.Array) -> Iterator[str]:
    """The strings of an Arrow column one at a time, null as empty."""
    for value in column:
        yield value.as_py() or ""
