"""Vectorised word splitting and hashing over Arrow string columns.

Every function works on the UTF-8 bytes of a whole Arrow batch at once: words are found with byte
tables and hashed with one reduction, so no Python object is made per word. A batch is cut into
slices of bounded bytes first, which keeps memory flat whatever the length of single texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once (a single longer text is handled alone).
SLICE_BYTES = 4 << 20

_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[list(_SPACES)] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: For bytes.translate: ASCII letters lower-cased, everything else as it is.
LOWER_TABLE = LOWER.tobytes()

_rng = np.random.default_rng(0x5EED)
_BYTE_KEYS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = int(_rng.integers(1, 1 << 62)) * 2 + 1
_powers = np.ones(1, dtype=np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(64, 1 << (n - 1).bit_length())
        steps = np.full(size, _STEP, dtype=np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and odd multiplications)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def strings(column: pa.Array) -> pa.Array:
    """The column as large strings, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of the batch, each with at most ``limit`` bytes of text or one row."""
    if not batch.num_rows:
        return
    column = strings(batch.column(batch.schema.get_field_index(text)))
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    first = 0
    while first < len(column):
        last = int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield batch.slice(first, last - first)
        first = last


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and the offsets that bound each text (one more than texts)."""
    column = strings(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts in order.

    Returns the hashes, and for each text the index of its first word (with a final total, so text
    ``i`` owns ``hashes[bounds[i]:bounds[i + 1]]``). Null and empty texts own none.
    """
    data, offsets = text_bytes(column)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = SPACE_WORDS[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] = word[edges]
    ends[edges - 1] = word[edges - 1]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    kept = data[word]
    if lower:
        kept = LOWER[kept]
    at = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=at[1:])
    place = np.arange(len(kept), dtype=np.int64) - np.repeat(at, lengths)
    sums = np.add.reduceat(_BYTE_KEYS[kept] * _power_table(int(lengths.max()))[place], at)
    return mix64(sums + lengths.astype(np.uint64)), bounds
