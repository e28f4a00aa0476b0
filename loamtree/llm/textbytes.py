"""Whole-column text work on the UTF-8 bytes of an Arrow string column.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. All arrays are
per chunk: some whole documents of together about CHUNK bytes, so memory is
bounded by that or by one document.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 512 << 10
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD = ~SPACE

_LEFT = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start : start + size] of every pair, one behind the other."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


def distinct_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of each slice of bytes among the distinct ones, and these. Arrow's dictionary compares the bytes themselves."""
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.ascontiguousarray(gather(data, starts, sizes))
    slices = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)])
    coded = slices.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of the BLAKE2b digest of each slice: each distinct slice of a chunk is digested once."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    number, distinct = distinct_slices(data, starts, ends)
    digest = hashlib.blake2b
    return np.frombuffer(b"".join([digest(x, digest_size=8).digest() for x in distinct]), np.uint64)[number]


def joined_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(mix(left) * _LEFT + right)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive values from each position with k values left, joined pair by pair from both halves; not linear in the values."""
    n = len(words) - k + 1
    if n <= 0:
        return words[:0]
    out, at, size, level = None, 0, 1, words
    while size <= k:
        if k & size:
            part = level[at : at + n]
            out = mix(part + np.uint64(k)) if out is None else joined_hashes(out, part)
            at += size
        level = joined_hashes(level[:-size], level[size:]) if 2 * size <= k else level
        size *= 2
    return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, limit: int = CHUNK):
    """(first row, row behind the last, bytes, offsets from 0) of runs of whole documents."""
    data, offsets = text_buffers(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True within each document, and the runs before each document (n+1)."""
    first = np.zeros(len(member) + 1, bool)
    first[offsets] = True
    before = np.zeros(len(member) + 1, bool)
    before[1:] = member
    start = member & (~before[:-1] | first[:-1])
    after = np.zeros(len(member) + 1, bool)
    after[:-1] = member
    end = member & (~after[1:] | first[1:])
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_table(data: np.ndarray, offsets: np.ndarray, hashed: bool = True):
    """(starts, ends, words before each document, hashes if asked for) of the chunk's words."""
    starts, ends, before = runs(WORD[data], offsets)
    return starts, ends, before, byte_hashes(data, starts, ends) if hashed else None


def owners(before: np.ndarray) -> np.ndarray:
    """The document of each item, from the items before each document."""
    return np.repeat(np.arange(len(before) - 1), np.diff(before))


def inside(before: np.ndarray, k: int) -> np.ndarray:
    """Whether the k items from each position with k left lie in one document."""
    n = max(0, int(before[-1]) - k + 1)
    own = owners(before)
    return own[:n] == own[k - 1 : k - 1 + n]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
