"""Word shingles of whole Arrow batches of texts.

Words are runs of characters other than ASCII white space, A-Z in lower case. A row is the set of its
distinct shingles of ``size`` words, or of one shingle of all its words if there are fewer; null
texts and texts without words have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # of text that is worked on at once; a longer text is hashed in pieces of this size

_RNG = np.random.Generator(np.random.PCG64(20240607))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_VALUE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_VALUE[_SPACE] = 0
_BASE = 0xD1B54A32D192ED03
_powers = {x: np.ones(1, dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 2**64))}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash: every bit depends on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_of(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        factors = np.full(max(n, SLICE_BYTES), base, dtype=np.uint64)
        factors[0] = 1
        _powers[base] = np.multiply.accumulate(factors)
    return _powers[base][:n]


def word_hashes(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``data`` in order, and the number of words of each row.

    Row i is ``data[bounds[i]:bounds[i + 1]]`` (UTF-8 bytes); ``space`` says of each byte whether it
    separates words. A word's hash is the sum of its bytes'
    values times powers of a base, so all words are hashed by a few passes over the bytes.
    """
    value = np.where(space, np.uint64(0), _VALUE)
    space = space[data]
    after = np.empty_like(space)
    after[:1], after[1:] = True, space[:-1]
    after[bounds[:-1][bounds[:-1] < len(data)]] = True
    at = np.flatnonzero(after & ~space)
    out = np.empty(len(at), dtype=np.uint64)
    lo = 0
    while lo < len(at):
        begin = at[lo]
        hi = max(int(np.searchsorted(at, begin + SLICE_BYTES)), lo + 1)
        end = at[hi] if hi < len(at) else len(data)
        values = value[data[begin:end]]
        values *= _powers_of(_BASE, end - begin)
        places = at[lo:hi] - begin
        out[lo:hi] = np.add.reduceat(values, places) * _powers_of(pow(_BASE, -1, 2**64), end - begin)[places]
        lo = hi
    return mix(out), np.diff(np.searchsorted(at, bounds))


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): row i has the sorted distinct ``hashes[offsets[i]:offsets[i + 1]]``."""
    h, words = word_hashes(data, bounds)
    first = np.cumsum(words) - words
    n = np.where(words < size, np.minimum(words, 1), words - size + 1)
    ends = np.cumsum(n)
    total = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    for width in range(1, size + 1):
        rows = words >= size if width == size else words == width
        count = n[rows]
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        source, target = np.repeat(first[rows], count) + inside, np.repeat((ends - n)[rows], count) + inside
        some = np.full(len(source), width, dtype=np.uint64)
        for i in range(width):
            some = some * _STEP + h[source + i]
        total[target] = some
    total = mix(total)
    begins = ends - n
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        total[a:b].sort()
    fresh = np.ones(len(total), dtype=bool)
    fresh[1:] = total[1:] != total[:-1]
    fresh[begins[n > 0]] = True
    before = np.concatenate([[0], np.cumsum(fresh)])
    return total[fresh], np.concatenate([[0], before[ends]]).astype(np.int64)


def slices(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, bounds) of slices of about ``SLICE_BYTES``; null is empty."""
    text = text.fill_null("")
    wide = np.int64 if pa.types.is_large_string(text.type) else np.int32
    _, offsets, data = text.buffers()
    if not len(text):
        return
    at = np.frombuffer(offsets, dtype=wide)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    lo = 0
    while lo < len(text):
        hi = max(int(np.searchsorted(at, at[lo] + SLICE_BYTES, "right")) - 1, lo + 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def as_binary(hashes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Each row's hashes as one binary value."""
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets * 8), pa.py_buffer(hashes)]
    )
