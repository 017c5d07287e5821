"""The words of many texts as arrays: hashes, places and counts, without a Python object for each word.

A word's hash is a polynomial over random numbers that stand for its bytes, taken
modulo 2^64 from running sums over the buffer, and mixed at the end.  Two families
(``family`` 0 and 1) are independent.  A word longer than `BLOCK` is hashed whole.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes whose running sum is taken at once.
BLOCK = 1 << 20
#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _table(family: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a number for each byte, powers of the base, powers of its inverse)."""
    if family not in _tables:
        rng = np.random.default_rng(0x5EED + family)
        numbers = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        base = int(rng.integers(0, 1 << 64, dtype=np.uint64)) | 1
        powers = []
        for b in (base, pow(base, -1, 1 << 64)):
            table = np.ones(BLOCK, np.uint64)
            done = 1
            while done < BLOCK:
                step = min(done, BLOCK - done)
                table[done : done + step] = table[:step] * np.uint64(pow(b, done, 1 << 64))
                done += step
            powers.append(table)
        _tables[family] = numbers, *powers
    return _tables[family]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def places(buf: np.ndarray, spaces: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of a buffer of bytes."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~spaces[buf]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """The 64-bit hash of every word."""
    numbers, powers, inverse = _table(family)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        end = int(np.searchsorted(ends, low + BLOCK, "right"))
        if end == at:  # a word longer than a block
            out[at] = xxhash.xxh3_64_intdigest(buf[low : ends[at]].tobytes(), family)
            at += 1
            continue
        x = numbers[buf[low : ends[end - 1]]]
        x *= powers[: len(x)]
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x, out=sums[1:])
        s, e = starts[at:end] - low, ends[at:end] - low
        out[at:end] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
        at = end
    return mixed(out)


class Words:
    """The words of a list of texts: ``starts`` and ``ends`` in ``buf``, and ``counts`` of each text."""

    def __init__(self, texts: list[bytes], spaces: np.ndarray = SPACES):
        self.data = b"\n".join(texts)  # a line feed parts words in every table
        self.buf = np.frombuffer(self.data, np.uint8)
        self.starts, self.ends = places(self.buf, spaces)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.first = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(sizes)]))
        self.counts = np.diff(self.first)

    def hashes(self, family: int = 0) -> np.ndarray:
        return hashes(self.buf, self.starts, self.ends, family)
