"""Sets of word sequences as 64-bit hashes, computed batch-wise on numpy arrays."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import xxhash

#: Runs of letters and digits.
WORD = re.compile(r"[^\W_]+")

_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def finish(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and where each text begins (one more than texts)."""
    flat: list[str] = []
    starts = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        flat += WORD.findall(t.lower())
        starts[i + 1] = len(flat)
    own = {w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in dict.fromkeys(flat)}
    return np.fromiter(map(own.__getitem__, flat), dtype=np.uint64, count=len(flat)), starts


#: Bits of a sequence's hash; the row's place in its block fills the rest of a 64-bit key.
HASH_BITS = 50
#: Rows of a block.
BLOCK = 1 << (64 - HASH_BITS)
_MASK = np.uint64((1 << HASH_BITS) - 1)


def shingle_sets(texts: Sequence[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word sequences of each text: (row of each, 50-bit hash of each), sorted by row, then hash.

    Takes up to BLOCK texts. A text of fewer than ``n`` words has one sequence, all
    its words; so a text without words has one that only other such texts share.
    """
    if len(texts) > BLOCK:
        raise ValueError(f"at most {BLOCK} texts")
    h, starts = word_hashes(texts)
    lengths = np.diff(starts)
    rows = np.repeat(np.arange(len(texts), dtype=np.uint64), lengths)
    keys = []
    if len(h) >= n:
        size = len(h) - n + 1
        acc = np.zeros(size, np.uint64)
        for k in range(n):
            acc = (acc ^ (acc >> np.uint64(31))) * _MUL[k % 4] + h[k : k + size]
        inside = rows[:size] == rows[n - 1 :]
        keys.append((rows[:size][inside] << np.uint64(HASH_BITS)) | (finish(acc[inside]) & _MASK))
    short = np.flatnonzero(lengths < n)
    if len(short):
        own = np.array([xxhash.xxh64_intdigest(h[starts[i] : starts[i + 1]].tobytes()) for i in short], dtype=np.uint64)
        keys.append((short.astype(np.uint64) << np.uint64(HASH_BITS)) | (own & _MASK))
    key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    key = key[first]
    return (key >> np.uint64(HASH_BITS)).astype(np.int64), key & _MASK


def sums_by_row(rows: np.ndarray, values: np.ndarray, n_rows: int) -> np.ndarray:
    """Wrapping sums of 64-bit values per row; rows ascending."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    ends = np.searchsorted(rows, np.arange(n_rows + 1))
    return total[ends[1:]] - total[ends[:-1]]
