"""Vectorised UTF-8 kernels shared by the text operators.

Words are maximal runs of bytes other than space and \\x09-\\x0D, which is the
same on UTF-8 bytes as on code points. Every kernel works on one bounded slice
of an Arrow batch at a time: ``slices`` cuts a batch by bytes, so that a worker
holds a few megabytes whatever the number of rows (one text is never cut).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES, SLICE_ROWS = 2 << 20, 1 << 16
U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_B, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_BINV = pow(_B, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x + U(seed * 0x9E3779B97F4A7C15 & _MASK)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(have)
        if len(have) > 2 * SLICE_BYTES:  # one very long text: don't hold on to it
            del _POWERS[base]
    return have[:n]


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type)
    offs = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[offs[0] : offs[-1]] if buf is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of at most ``limit`` text bytes and ``SLICE_ROWS`` rows, one row at least."""
    n = batch.num_rows
    if not n:
        return
    offs, lo = utf8(batch.column(batch.schema.get_field_index(text)))[1], 0
    while lo < n:
        hi = max(lo + 1, min(lo + SLICE_ROWS, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1))
        yield batch.slice(lo, hi - lo)
        lo = hi


def texts(arr: pa.Array) -> list[bytes]:
    data, offs = utf8(arr)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of True inside one text."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(mask))]
    before = np.empty(len(mask), bool)
    before[0], before[1:] = False, mask[:-1]
    before[inner] = False
    after = np.empty(len(mask), bool)
    after[-1], after[:-1] = False, mask[1:]
    after[inner - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each text's first word (one more entry than texts)."""
    s, e = runs(~_SPACE[data], offs)
    return s, e, np.searchsorted(s, offs)


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, by differences of one polynomial prefix sum."""
    if not len(s):
        return np.zeros(0, np.uint64)
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _powers(_B, len(data)), out=p[1:])
    return mix((p[e] - p[s]) * _powers(_BINV, len(data) + 1)[s] + (e - s).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive items, in order; shorter by k-1."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, m = np.zeros(n, np.uint64), 1
    for j in range(k):
        out += h[j : j + n] * U(m)
        m = m * 0xC2B2AE3D27D4EB4F & _MASK
    return mix(out)


def inside(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """Which of the total-k+1 windows of k items lie within one text."""
    n = total - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ends = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + k <= ends


def owner(first: np.ndarray) -> np.ndarray:
    """Text number of each item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def uniques(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, hash) pairs in order of doc, with their counts; doc must not fall."""
    if not len(h):
        return doc, h, np.zeros(0, np.int64)
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.empty(len(x), bool)
    new[0] = True
    new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return d[at], x[at], np.diff(np.append(at, len(x)))
