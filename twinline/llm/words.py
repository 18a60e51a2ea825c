"""Word and shingle hashes of Arrow text batches, whole batches at a time in numpy.

A word's hash is a polynomial over its bytes modulo 2**64, finished with a bit mixer; equal words have
equal hashes, and different ones differ but for about one pair in 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Texts are handled in slices of about so many bytes, which bounds the arrays below; one longer text is a slice alone.
SLICE_BYTES = 1 << 18

_RNG = np.random.default_rng(20240229)
_BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_PLACES = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers or more; kept for slices, made anew for a longer text."""
    kept = _POWERS.get(base)
    if kept is not None and n <= len(kept):
        return kept
    size = max(n, SLICE_BYTES + 1)
    steps = np.full(size, base, dtype=np.uint64)
    steps[0] = 1
    np.cumprod(steps, dtype=np.uint64, out=steps)
    if size == SLICE_BYTES + 1:
        _POWERS[base] = steps
    return steps


def alphabet(is_word) -> np.ndarray:
    """Lower-cased byte for word bytes, zero for all others."""
    table = np.zeros(256, dtype=np.uint8)
    for byte in range(256):
        if is_word(byte):
            table[byte] = byte + 32 if 65 <= byte <= 90 else byte
    return table


# [^\x20\x09-\x0D]+
NOT_SPACE = alphabet(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z
LETTERS = alphabet(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)


@dataclass
class Words:
    """Words of several texts: ``hashes`` in order, text ``i`` owns ``bounds[i]:bounds[i + 1]``."""

    hashes: np.ndarray
    bounds: np.ndarray
    first: int
    starts: np.ndarray
    ends: np.ndarray
    sums: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The words of more than ``size`` bytes, and the hashes of their first ``size`` bytes."""
        longer = np.flatnonzero(self.ends - self.starts > size)
        starts = self.starts[longer]
        return longer, _finish(self.sums, starts, starts + size)


def word_slices(column: pa.Array, table: np.ndarray) -> Iterator[Words]:
    """The words of a string column, null as empty; ``first`` is the row number of a slice's first text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield _words(data, offsets[row : stop + 1], table, row)
        row = stop


def _words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, first: int) -> Words:
    text = table[data[offsets[0] : offsets[-1]]]
    at = offsets - offsets[0]
    n = len(text)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(none.astype(np.uint64), np.zeros(len(at), dtype=np.int64), first, none, none, none.astype(np.uint64))
    inside = text != 0
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = at[:-1][at[:-1] < n]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.take(_BYTE_CODES, text, out=sums[1:], mode="clip")
    sums[1:] *= _powers(_BASE, n)[:n]
    np.cumsum(sums[1:], out=sums[1:])
    hashes = _finish(sums, starts, ends)
    return Words(hashes, np.searchsorted(starts, at).astype(np.int64), first, starts, ends, sums)


def _finish(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs ``starts:ends`` from the polynomial's prefix sums."""
    down = _powers(_INVERSE, len(sums))
    lengths = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * down[starts] + lengths * np.uint64(0xD6E8FEB86659FD93))


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` neighbours; one shorter when the array is shorter."""
    size = min(size, len(hashes))
    if size == 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(len(hashes) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out += hashes[k : len(hashes) - size + 1 + k] * _PLACES[k]
    return mix(out)


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text; a text of fewer words has its whole sequence as one."""
    for i in range(len(words)):
        part = words.hashes[words.bounds[i] : words.bounds[i + 1]]
        found = runs(part, size)
        if len(found) > 1:
            found.sort()
            found = found[np.concatenate(([True], found[1:] != found[:-1]))]
        yield found
