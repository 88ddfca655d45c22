"""Hashes of words and word windows, vectorised, for the operators that run Python on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Odd multipliers of the rolling hashes; both have a large multiplicative order modulo 2**64.
LANES = (0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F | 5)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """bytes.split() breaks at the space and the controls 9 to 13, and lower() changes A to Z only."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def sliced(batches: Iterator[pa.RecordBatch], text: str, chars: int) -> Iterator[pa.RecordBatch]:
    """Slices of about `chars` characters of text, of one row at least: memory follows them, not the batches."""
    for batch in batches:
        sizes = np.array([len(t) if t else 0 for t in batch[text].to_pylist()], np.int64)
        part = (np.cumsum(sizes) - sizes) // chars
        for p in np.unique(part):
            rows = np.flatnonzero(part == p)
            yield batch.slice(int(rows[0]), len(rows))


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser; with salts, independent orders of the same values."""
    h = h + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX[0])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX[1])
    return h ^ (h >> np.uint64(31))


_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n at least."""
    size = 1 << max(12, (n + 1).bit_length())
    if (base, size) not in _powers:
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _powers[base, size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[base, size]


def rolling(values: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """The Rabin-Karp hash modulo 2**64 of every run of `width` values: sum of values[i + j] * base**j.

    Prefix sums of values[i] * base**i give a run's sum, and base**-i shifts it to start at power 0.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(LANES[lane], len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[width:] - total[:n]) * down[:n]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every run of `width` values, by runs of doubling length."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    extra = width - have
    return np.minimum(values[: len(values) - extra], values[extra:]) if extra else values


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
