"""Words of Arrow string columns, found with numpy over the bytes of many texts at once.

Texts are taken in blocks of whole documents of about `BLOCK_BYTES`, so working memory is bounded by the
block or by one document, whichever is larger. A word is known by a 64-bit hash of its bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
U64 = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE = np.arange(256)
#: Words as runs of anything but white space; as runs of digits, a-z and bytes of other scripts; of a-z and other scripts.
NOT_SPACE = ~((_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13)))
ALNUM = ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)

_PRIME = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_PRIME), -1, 1 << 64))
_CODE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch function that hands the memory it no longer uses back to the system when a task ends; workers are reused."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return task


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; long tables are not kept."""
    held = _powers.get(int(base))
    if held is not None and len(held) >= n:
        return held[:n]
    table = np.full(max(n, 2 * BLOCK_BYTES), base, dtype=np.uint64)
    table[0] = 1
    np.multiply.accumulate(table, out=table)
    if n <= 2 * BLOCK_BYTES:
        _powers[int(base)] = table
    return table[:n]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; null reads as empty."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    held = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def document_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most `limit` bytes together, or one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


@dataclass
class Block:
    """Words of documents `lo` to `hi` (exclusive) of a batch.

    `first[k]:first[k + 1]` are the words of document lo + k; `start` and `end` are byte positions in `data`,
    where `begin[k]` is the first byte of document lo + k. `data` is lower-cased in A-Z, `raw` is not.
    """

    lo: int
    hi: int
    raw: np.ndarray
    data: np.ndarray
    begin: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Document of each word, from 0 in this block."""
        return np.repeat(np.arange(self.hi - self.lo), self.counts)

    def hashes(self, upto: int | None = None, code: np.ndarray = _CODE) -> np.ndarray:
        """Hash of each word, or of its first `upto` bytes; equal codes make bytes equal."""
        return span_hashes(self.data, self.start, self.end if upto is None else np.minimum(self.end, self.start + upto), code)

    def word(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray = _CODE) -> np.ndarray:
    """64-bit hash of each byte span."""
    running = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(code[data] * powers(_PRIME, len(data)), out=running[1:])
    return mix((running[end] - running[start]) * powers(_INVERSE, len(data) + 1)[start])


def hash_of(word: str | bytes, code: np.ndarray = _CODE) -> np.uint64:
    """The hash that `Block.hashes` gives this word."""
    data = np.frombuffer(word.encode() if isinstance(word, str) else word, dtype=np.uint8)
    return span_hashes(data, np.array([0]), np.array([len(data)]), code)[0]


def word_blocks(texts: pa.Array, word_bytes: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Words (runs of bytes that `word_bytes` marks, after lower-casing A-Z) of all texts, block by block."""
    data, offsets = utf8(texts)
    for lo, hi in document_blocks(offsets, limit):
        begin = offsets[lo : hi + 1] - offsets[lo]
        raw = data[offsets[lo] : offsets[hi]]
        low = LOWER[raw]
        inside = np.zeros(len(low) + 1, dtype=bool)
        inside[1:] = word_bytes[low]
        fresh = inside[1:] & ~inside[:-1]
        cut = begin[:-1][begin[:-1] < len(low)]
        fresh[cut] = inside[1:][cut]
        start = np.flatnonzero(fresh)
        over = np.empty(len(low), dtype=bool)
        over[:-1] = inside[1:-1] & ~inside[2:]
        over[-1:] = inside[-1:] if len(low) else over[-1:]
        last = begin[1:][begin[1:] > 0] - 1
        over[last] = inside[1:][last]
        end = np.flatnonzero(over) + 1
        yield Block(lo, hi, raw, low, begin, start, end, np.searchsorted(start, begin))


def code_points(raw: np.ndarray) -> np.ndarray:
    """Code points before each byte position, 0 to len(raw)."""
    out = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out


class HashSet:
    """Membership of 64-bit hashes: a table of one bit a slot, then a search in the sorted values."""

    def __init__(self, values, bits: int = 18):
        self.values = np.unique(np.asarray(values, dtype=np.uint64))
        self.shift = U64(64 - bits)
        self.table = np.zeros(1 << bits, dtype=bool)
        self.table[self.values >> self.shift] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `hashes` of members, and their ranks among the sorted values."""
        at = np.flatnonzero(self.table[hashes >> self.shift])
        if not len(self.values) or not len(at):
            return at[:0], at[:0]
        rank = np.minimum(np.searchsorted(self.values, hashes[at]), len(self.values) - 1)
        true = self.values[rank] == hashes[at]
        return at[true], rank[true]
