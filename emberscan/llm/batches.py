"""Vectorised text work inside a task: many documents as one byte array.

Everything here is exact up to 64-bit fingerprints; offsets are byte offsets into the joined array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; a longer document is taken alone.
CHUNK = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with at most `limit` bytes of text each, and the texts (NULL becomes empty)."""
    if not batch.num_rows:
        return
    data = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    lengths = pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    start = 0
    while start < len(ends):
        before = ends[start] - lengths[start]
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start), [x or b"" for x in data.slice(start, stop - start).to_pylist()]
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all their bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK + 4096), base, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(steps)
        _powers[base] = have
    return have[:n]


class Joined:
    """Documents in one array, each followed by a newline, so that no word or line spans two of them."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.raw = b"\n".join([*texts, b""])
        self.bytes = np.frombuffer(self.raw, np.uint8)
        if lower:
            self.bytes = LOWER[self.bytes]
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.count = len(texts)
        self._sums: np.ndarray | None = None

    def fingerprints(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit fingerprint of each byte range."""
        if self._sums is None:
            n = len(self.bytes)
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_TABLE[self.bytes] * powers(_BASE, n), out=self._sums[1:])
        shift = powers(_BASE_INVERSE, len(self.bytes) + 1)
        return mix((self._sums[ends] - self._sums[starts]) * shift[starts] + (ends - starts).astype(np.uint64))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of every maximal run of bytes that are no ASCII white space."""
        space = IS_SPACE[self.bytes]
        inside = ~space
        starts = np.flatnonzero(inside & np.concatenate(([True], space[:-1])))
        ends = np.flatnonzero(inside & np.concatenate((space[1:], [True]))) + 1
        return starts, ends, self.owner(starts)

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The document that each position lies in."""
        return np.searchsorted(self.ends, at, "left")

    def per_document(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each document have the flag."""
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[self.ends] - sums[self.starts]


def shingles(words: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and first-word index of every window of `size` consecutive words of one document."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(owner[:n] == owner[size - 1:])
    out = words[at]
    for k in range(1, size):
        out = out * _U(_BASE) + words[at + k]
    return mix(out), at
