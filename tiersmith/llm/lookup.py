"""A hash table from unsigned 64-bit keys to row numbers that answers for whole arrays at once."""

from __future__ import annotations

import numpy as np
import xxhash

SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a span beyond which its hash is that of its bytes alone, as long patterned spans can share a running sum.
LONG_SPAN = 256


class KeyIndex:
    """Row numbers 0, 1, ... of distinct keys in the order they were added."""

    def __init__(self, keys: np.ndarray | None = None) -> None:
        self.size = 0
        self._clear(1 << 12)
        if keys is not None:
            self.add(keys)

    def _clear(self, room: int) -> None:
        self.shift = np.uint64(64 - (room.bit_length() - 1))
        self.keys = np.zeros(room, np.uint64)
        self.rows = np.full(room, -1, np.int32)

    def add(self, keys: np.ndarray) -> None:
        """Add keys that are distinct and not yet in the table."""
        rows = np.arange(self.size, self.size + len(keys), dtype=np.int32)
        self.size += len(keys)
        room = len(self.rows)
        if self.size * 3 > room:
            old = self.rows >= 0
            keys, rows = np.concatenate([self.keys[old], keys]), np.concatenate([self.rows[old], rows])
            while self.size * 3 > room:
                room *= 2
            self._clear(room)
        at = ((keys * SPREAD) >> self.shift).astype(np.int64)
        while len(keys):
            free = self.rows[at] < 0
            self.rows[at[free]] = rows[free]
            won = self.rows[at] == rows
            self.keys[at[won]] = keys[won]
            keys, rows, at = keys[~won], rows[~won], (at[~won] + 1) & (room - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key, -1 for those that are not in the table."""
        at = ((keys * SPREAD) >> self.shift).astype(np.int64)
        found = self.rows[at]
        open_ = np.flatnonzero((self.keys[at] != keys) & (found >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & (len(self.rows) - 1)
            row = self.rows[at]
            found[open_] = row
            more = (row >= 0) & (self.keys[at] != keys[open_])
            open_, at = open_[more], at[more]
        return found


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, ...`` for ``lengths[0]`` numbers, then the same of the next."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span of ``data``, by differences of one running sum."""
    ones = np.full(len(data) + 1, SPREAD)
    ones[0] = 1
    powers = np.cumprod(ones, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * powers[:-1], dtype=np.uint64)])
    ones[1:] = np.uint64(pow(int(SPREAD), -1, 1 << 64))
    undo = np.cumprod(ones, dtype=np.uint64)
    found = mix((sums[ends] - sums[starts]) * undo[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG_SPAN):
        found[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    return found


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))
