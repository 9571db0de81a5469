"""Vectorised text primitives over Arrow string buffers.

All functions work on the raw UTF-8 bytes of a whole batch of texts: a ``uint8`` array and the offsets at which each text
begins. Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D, which is the same as the character class
``[^\\x20\\x09-\\x0D]+`` because UTF-8 never uses those bytes inside a longer character. Only A-Z are lower-cased.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once, and bytes that are hashed at once.
BLOCK = 1 << 19
HASHED = 1 << 16

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_MIX = tuple(np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 30, 27, 31))
_STEP = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3], dtype=np.uint64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & _MASK), dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES["up"] = _powers(_BASE, 2 * HASHED)
        _TABLES["down"] = _powers(pow(_BASE, -1, 1 << 64), 2 * HASHED)
    return _TABLES["up"], _TABLES["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit words."""
    a, b, r1, r2, r3 = _MIX
    x = (x ^ (x >> r1)) * a
    x = (x ^ (x >> r2)) * b
    return x ^ (x >> r3)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=column.offset + len(column) + 1)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    index = batch.schema.get_field_index(column)
    size = pc.fill_null(pc.binary_length(batch.column(index)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte positions where words start and end, and where each text's words begin among them (one more than texts)."""
    n = len(data)
    solid = ~SPACE[data]
    head, tail = solid.copy(), solid.copy()
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    if n > 1:
        head[1:] &= ~solid[:-1] | edge[1:n]
        tail[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that don't overlap and ascend; equal bytes give equal hashes in every process."""
    up, down = _tables()
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        first = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, first + HASHED, side="right")))
        last = int(ends[j - 1])
        if last - first > len(up):  # one very long word
            total, scale = 0, 1
            for a in range(first, last, HASHED):
                part = data[a : min(last, a + HASHED)].astype(np.uint64) + np.uint64(1)
                total = (total + scale * int((part * up[: len(part)]).sum(dtype=np.uint64))) & _MASK
                scale = scale * pow(_BASE, len(part), 1 << 64) & _MASK
            out[i] = total
        else:
            part = data[first:last].astype(np.uint64)
            part += np.uint64(1)
            part *= up[: last - first]
            total = np.empty(last - first + 1, dtype=np.uint64)
            total[0] = 0
            np.cumsum(part, out=total[1:])
            s = starts[i:j] - first
            out[i:j] = (total[ends[i:j] - first] - total[s]) * down[s]
        i = j
    return mix(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words and where each text's words begin."""
    starts, ends, at = spans(data, offsets)
    return hash_spans(LOWER[data], starts, ends), at


def shingles(words: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words in each text, and where each text's begin. A text of fewer words gives its
    whole sequence as one; a text without words gives none."""
    n = np.diff(at)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    to = np.concatenate(([0], np.cumsum(count)))
    if not len(words):
        return np.zeros(0, dtype=np.uint64), to
    rolled = np.zeros(len(words), dtype=np.uint64)
    for k in range(width):
        rolled[: len(words) - k] += words[k:] * _STEP[k]
    take = np.repeat(at[:-1] - to[:-1], count) + np.arange(to[-1])
    out = rolled[take]
    for d in np.flatnonzero((n > 0) & (n < width)):
        part = words[at[d] : at[d + 1]]
        out[to[d]] = (part * _STEP[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))
    return mix(out), to


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def give_back() -> None:
    """Return to the system what numpy and Arrow freed but their allocators kept."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def tidy(rows: Callable) -> Callable:
    """A function over batches that gives memory back when its task ends: workers live on from task to task beside an
    executor's JVM."""

    def run(batches):
        yield from rows(batches)
        give_back()

    return run
