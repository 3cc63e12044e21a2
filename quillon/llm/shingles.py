"""Word and shingle hashes of many texts at once, on the UTF-8 bytes.

A word is a longest run without ASCII white space (0x20, 0x09 to 0x0D), with A to Z
in lower case. Hashes have 64 bits; equal words have equal hashes in any batch.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACES = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U(1)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)
_powers = {"step": np.ones(1, np.uint64), "back": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _power(kind: str, base: int, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        size = max(n, 1 << 16)
        one = np.full(size, base, np.uint64)
        one[0] = 1
        kept = np.cumprod(one)
        if size > 2_500_000:  # of one very long text
            return kept[:n]
        _powers[kind] = kept
    return _powers[kind][:n]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word in order: its hash, its row, and its first and last-plus-one byte."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_SPACE[data]
    new = np.zeros(n + 1, bool)
    new[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    start = np.flatnonzero(word & (~before | new[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    end = np.flatnonzero(word & (~after | new[1:])) + 1
    with np.errstate(over="ignore"):
        total = np.cumsum(_BYTES[data] * _power("step", _STEP, n))
        low = np.where(start > 0, total[start - 1], U(0))
        hashed = mix((total[end - 1] - low) * _power("back", _BACK, n)[start])
    return hashed, np.searchsorted(offsets, start, side="right") - 1, start, end


def shingles(hashed: np.ndarray, row: np.ndarray, rows: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in a row, and the row of each, in order. A text of 1 to k-1
    words has one shingle of all of them; one without words has none."""
    n = len(hashed)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.bincount(row, minlength=rows)
    first = np.cumsum(counts) - counts
    with np.errstate(over="ignore"):
        if n >= k:
            out = hashed[: n - k + 1] * _PLACES[0]
            for j in range(1, k):
                out = out + hashed[j : n - k + 1 + j] * _PLACES[j]
            whole = row[: n - k + 1] == row[k - 1 :]
            out, at = mix(out[whole]), row[: n - k + 1][whole]
        else:
            out, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            more = np.zeros(len(short), np.uint64)
            for j in range(k - 1):
                has = counts[short] > j
                more[has] += hashed[first[short[has]] + j] * _PLACES[j]
            more = mix(more + counts[short].astype(np.uint64) * _PLACES[63])
            out, at = np.concatenate([out, more]), np.concatenate([at, short])
            order = np.argsort(at, kind="stable")
            out, at = out[order], at[order]
    return out, at
