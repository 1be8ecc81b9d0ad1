"""Numpy views of Arrow text and the hashing shared by the text operators.

Everything here runs inside ``mapInArrow`` workers.  Texts are read straight
from the Arrow buffers, so no Python string is made for a document.  Work is
cut into slices of ``SLICE_BYTES`` of text; a longer document is a slice of
its own and is hashed block by block, so scratch memory follows the block.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
BLOCK_BYTES = 1 << 20

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim.argtypes = [ctypes.c_size_t]
except (OSError, AttributeError):  # another C library: it keeps what it has
    _LIBC = None

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, dtype=np.uint64)
_LOWER_BYTE = _BYTE[_LOWER]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); spreads every input bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int, base: int, name: str) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        out = np.empty(size, dtype=np.uint64)
        out[0] = 1
        filled = 1
        while filled < size:
            step = min(filled, size - filled)
            out[filled : filled + step] = out[:step] * _U(pow(base, filled, 1 << 64))
            filled += step
        if size > BLOCK_BYTES + 1:
            return out
        _POWERS[name] = have = out
    return have


def give_back() -> None:
    """Return memory that a worker no longer uses to the system: workers live on, and executors count all of it."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def text_slices(column: pa.ChunkedArray | pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield ``(first_row, bytes, offsets)`` for runs of rows of at most ``limit`` bytes.

    ``offsets`` has one entry more than the run has rows; null rows are empty.
    """
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    base = 0
    for chunk in chunks:
        if not len(chunk):
            continue
        if pa.types.is_large_string(chunk.type):
            kind = np.int64
        else:
            chunk, kind = chunk.cast(pa.string()), np.int32
        if chunk.null_count:
            chunk = chunk.fill_null("")
        _, offsets, data = chunk.buffers()
        ends = np.frombuffer(offsets, dtype=kind)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64)
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
        row = 0
        while row < len(chunk):
            stop = int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1
            stop = min(max(stop, row + 1), len(chunk))
            yield base + row, raw[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
            row = stop
        base += len(chunk)
    give_back()


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word ``[^\\x20\\x09-\\x0D]+``; words end with their row."""
    if not len(data):
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    solid = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = True) -> np.ndarray:
    """64-bit hashes of the byte ranges, A-Z folded to a-z if asked."""
    table = _LOWER_BYTE if fold_case else _BYTE
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = int(np.searchsorted(ends, low + BLOCK_BYTES, side="right"))
        j = max(j, i + 1)
        high = int(ends[j - 1])
        n = high - low
        run = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(table[data[low:high]] * _powers(n, _BASE, "up")[:n], out=run[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (run[e] - run[s]) * _powers(n, _BASE_INV, "down")[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


_SHINGLE_MUL = [_U(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(64)]


def shingle_hashes(word_hash: np.ndarray, rows: np.ndarray, n_rows: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``width``-word shingle in order, and per-row offsets.

    A row of fewer words gives its whole sequence as one shingle; none gives none.
    """
    counts = np.bincount(rows, minlength=n_rows)
    first = np.zeros(n_rows + 1, dtype=np.int64)
    np.cumsum(counts, out=first[1:])
    per_row = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    offsets = np.zeros(n_rows + 1, dtype=np.int64)
    np.cumsum(per_row, out=offsets[1:])
    out = np.zeros(int(offsets[-1]), dtype=np.uint64)
    total = len(word_hash)
    if total >= width:
        rolled = np.zeros(total - width + 1, dtype=np.uint64)
        for k in range(width):
            rolled += word_hash[k : total - width + 1 + k] * _SHINGLE_MUL[k]
        whole = rows[: total - width + 1] == rows[width - 1 :]
        full = np.repeat(counts >= width, per_row)
        out[full] = mix(rolled[whole])
    for r in np.flatnonzero((counts > 0) & (counts < width)):
        ws = word_hash[first[r] : first[r + 1]]
        h = len(ws) + sum(int(w) * int(m) for w, m in zip(ws, _SHINGLE_MUL, strict=False))
        out[offsets[r]] = mix(np.array([(h & (1 << 64) - 1) ^ 0xA5A5A5A5A5A5A5A5], dtype=np.uint64))[0]
    return out, offsets


def distinct_sorted(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and the new offsets."""
    values = values.copy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), dtype=bool)
    if len(values):
        keep[1:] = values[1:] != values[:-1]
        starts = offsets[:-1][offsets[:-1] < len(values)]
        keep[starts] = True
    run = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(keep, out=run[1:])
    return values[keep], run[offsets]
