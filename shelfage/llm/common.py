"""Shared helpers of the training-data operators: Arrow text buffers, vectorised hashing, chunk store.

Text is handled as the UTF-8 bytes of an Arrow column, in slices of a few MB, so a
Python worker holds a bounded piece of its partition whatever the partition's size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs

#: A slice of a partition handed to numpy: documents up to this many bytes, or one longer document.
SLICE_BYTES = (2 << 20) - 16

#: Words are hashed in blocks of about this many bytes, so that a slice or a long document needs no 8 bytes a byte.
HASH_BYTES = 1 << 18

U64 = np.uint64
_MULT = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift-multiply): spreads every input bit over the output."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=8)
def _byte_values(lower: bool, which: int) -> np.ndarray:
    """A pseudo-random odd 64-bit value for each byte; with ``lower``, A-Z share the values of a-z."""
    t = mix(np.arange(1, 257, dtype=U64) * U64(_MULT[which] ^ 0x5555))
    if lower:
        t[65:91] = t[97:123]
    return t


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the multiplier modulo 2**64, and of its inverse (grown by doubling, kept per worker)."""
    have = _powers.get(which)
    if have is None or len(have[0]) <= n:
        size = 1 << max(16, int(n).bit_length())
        m = U64(_MULT[which])
        inv = U64(pow(_MULT[which], -1, 1 << 64))
        out = []
        for base in (m, inv):
            p = np.ones(size, dtype=U64)
            p[1:] = base
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size <= 1 << 23:
            _powers[which] = have
    return have


def prefix_hash(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums of value[j] * M**j modulo 2**64 (length n + 1); see range_hash."""
    n = len(values)
    out = np.zeros(n + 1, dtype=U64)
    np.cumsum(values * _pow(n, which)[0][:n], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Polynomial hash of the ranges [start, end), equal for equal contents at any place."""
    inv = _pow(len(prefix), which)[1]
    return (prefix[end] - prefix[start]) * inv[start]


def byte_prefix(data: np.ndarray, lower: bool = False, which: int = 0) -> np.ndarray:
    return prefix_hash(_byte_values(lower, which)[data], which)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of the words [start, end), equal for equal words at any place; in blocks of words, or one longer word."""
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + HASH_BYTES, side="right")))
        prefix = byte_prefix(data[base: ends[to - 1]], lower)
        out[at:to] = mix(range_hash(prefix, starts[at:to] - base, ends[at:to] - base))
        at = to
    return out


# ---------------------------------------------------------------- Arrow text
def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one uint8 array, and the n + 1 document offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[off[0]: off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have at most ``limit`` bytes together (one row, if its text alone has more)."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def token_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the maximal runs of word bytes, and how many words stand before each document.

    ``is_word`` is a 256-entry table; runs never cross a document boundary.
    """
    n = len(data)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = is_word[data]
    first = inside[:n].copy()
    first[1:] &= ~inside[: n - 1]
    last = inside[:n] & ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def space_words() -> np.ndarray:
    """Word bytes of ``[^\\x20\\x09-\\x0D]+``."""
    t = np.ones(256, dtype=bool)
    t[0x20] = False
    t[0x09:0x0E] = False
    return t


def alnum_words() -> np.ndarray:
    """Word bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z were lower-cased."""
    t = np.zeros(256, dtype=bool)
    t[0x30:0x3A] = True
    t[0x41:0x5B] = True
    t[0x61:0x7B] = True
    t[0x80:] = True
    return t


# ---------------------------------------------------------------- memory of a worker
def giving_back(run: Callable) -> Callable:
    """A mapInArrow function, or one of the iterator form of applyInArrow, that at its end hands the memory it no longer needs
    back to the system: Spark keeps a Python worker for later stages, and the C library keeps what numpy and Arrow have freed."""
    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)
    return whole


# ---------------------------------------------------------------- files in the shared folder
def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file://{path.removeprefix('file:')}")


def commit_file(fs: pafs.FileSystem, temporary: str, final: str) -> None:
    """Gives a completely written file its final name; a repeated task replaces it by equal bytes."""
    fs.move(temporary, final)


def discard(paths: list[str]) -> None:
    """Removes intermediate tables of an operator that nothing reads any more."""
    for path in paths:
        fs, p = filesystem(path)
        fs.delete_dir(p)
