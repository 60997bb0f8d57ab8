"""Packing of token ids into windows by non-negative least squares.

Whole windows are cut off each document's front. The rests form a histogram of lengths in steps of `step` tokens; all
combinations of at most `parts` lengths that fill a window are enumerated, non-negative least squares finds how often
each should occur, the counts are rounded to what is there, and what remains is packed greedily: rests are laid end to end and cut at window ends.
The last window of a block, if it is not full, becomes sequences whose lengths are powers of two, which need no padding.

A block is a run of documents of one task of about `block_tokens`, so nothing is shuffled and memory is bounded
by the block or by one document, whichever is larger; each block fits its own histogram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.text import document_blocks, lean, span_hashes, utf8


@dataclass(frozen=True)
class Settings:
    window: int = 2048
    step: int = 8
    parts: int = 3
    block_tokens: int = 4 << 20
    end_id: int = 1
    #: Bytes of text whose distinct words are encoded together, and words that a worker remembers.
    encode_bytes: int = 1 << 20
    remembered: int = 1_000_000


# Words: a text may be cut before a space that a visible character follows, without changing its ids, because the
# tokenizer's own pattern always breaks there. Lead bytes of other scripts' white space are left uncut.
_VISIBLE = np.ones(256, dtype=bool)
_VISIBLE[:33] = False
_VISIBLE[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = False


class Encoder:
    """Ids of whole texts by a byte-level tokenizer file; each distinct word is encoded once and remembered."""

    def __init__(self, path: str, s: Settings):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.settings = s
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.length = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.length[i] = len(token)  # one character a byte
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)  # sorted hashes of words
        self.place = np.zeros((0, 2), dtype=np.uint32)  # where their ids begin, and how many there are
        self.ids = np.zeros(1 << 20, dtype=np.uint16 if len(self.length) <= 1 << 16 else np.uint32)
        self.used = 0

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        """Encode words laid end to end; the bytes of the ids tell where each word ends."""
        spaced = data[start] == 32
        order = np.r_[np.flatnonzero(spaced), np.flatnonzero(~spaced)]  # a text's first word is encoded alone
        sizes = (end - start)[order]
        ends = np.cumsum(sizes)
        words = data[np.arange(ends[-1]) + np.repeat(start[order] - ends + sizes, sizes)].tobytes()
        n = int(spaced.sum())
        cuts = [0]
        while cuts[-1] < n:
            held = ends[cuts[-1] - 1] if cuts[-1] else 0
            cuts.append(min(n, max(cuts[-1] + 1, int(np.searchsorted(ends, held + (1 << 16))))))
        cuts += list(range(n + 1, len(order) + 1))
        at = np.r_[0, ends][cuts].tolist()
        codes = self.tokenizer.encode_batch_fast([words[x:y].decode() for x, y in zip(at, at[1:], strict=False)], add_special_tokens=False)
        ids = np.concatenate([np.asarray(c.ids, dtype=np.uint32) for c in codes])
        upto = np.searchsorted(np.cumsum(self.length[ids]), ends, side="left") + 1
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        first = np.r_[0, upto[:-1]]
        place = np.stack([self.used + first, upto - first], axis=1).astype(np.uint32)
        self.used += len(ids)
        new = hashes[order]
        sort = np.argsort(new)
        where = np.searchsorted(self.known, new[sort])
        self.known = np.insert(self.known, where, new[sort])
        self.place = np.insert(self.place, where, place[sort], axis=0)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, ids of texts laid end to end, number of ids of each text), by blocks of texts."""
        data, offsets = utf8(texts)
        for lo, hi in document_blocks(offsets, self.settings.encode_bytes):
            block = data[offsets[lo] : offsets[hi]]
            begin = offsets[lo : hi + 1] - offsets[lo]
            cut = np.zeros(len(block) + 1, dtype=bool)
            if len(block):
                cut[:-2] = (block[:-1] == 32) & _VISIBLE[block[1:]]
                cut[begin[1:][begin[1:] > 0] - 1] = False  # what follows a text's last byte is another text
                cut[begin] = True
                cut[-1] = False
            start = np.flatnonzero(cut)
            end = np.r_[start[1:], len(block)][: len(start)]
            distinct, one, which = np.unique(span_hashes(block, start, end), return_index=True, return_inverse=True)
            if len(self.known) > self.settings.remembered or self.used > 1 << 30:
                self._forget()
            where = np.searchsorted(self.known, distinct)
            held = np.zeros(len(distinct), dtype=bool)
            inside = where < len(self.known)
            held[inside] = self.known[where[inside]] == distinct[inside]
            if not held.all():
                new = one[~held]
                self._learn(block, start[new], end[new], distinct[~held])
                where = np.searchsorted(self.known, distinct)
            place = self.place[where].astype(np.int64)
            size = place[:, 1][which]
            total = np.cumsum(size)
            ids = self.ids[np.arange(int(total[-1]) if len(total) else 0) + np.repeat(place[which, 0] - total + size, size)]
            yield lo, ids, np.diff(np.r_[0, total][np.searchsorted(start, begin)])


@lru_cache(maxsize=1)
def encoder(path: str, s: Settings) -> Encoder:
    """One encoder a worker process, so that later tasks know the words of earlier ones."""
    return Encoder(path, s)


def combinations(bins: int, parts: int) -> list[tuple[int, ...]]:
    """Lengths (in steps, not increasing) of 1 to `parts` pieces that add up to `bins`."""
    out = [(bins,)]
    if parts >= 2:
        out += [(a, bins - a) for a in range(bins - 1, (bins - 1) // 2, -1)]
    if parts >= 3:
        out += [(a, b, bins - a - b) for a in range(bins - 2, 0, -1) for b in range(min(a, bins - a - 1), 0, -1) if bins - a - b <= b]
    return out


@lru_cache(maxsize=4)
def _matrix(bins: int, parts: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    listed = combinations(bins, parts)
    a = np.zeros((bins, len(listed)))
    for j, combination in enumerate(listed):
        for length in combination:
            a[length - 1, j] += 1
    return listed, a


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by an active set; ends early after `rounds` with a feasible x."""
    m, n = a.shape
    x, passive = np.zeros(n), np.zeros(n, dtype=bool)
    slack = 1e-9 * max(1.0, float(np.abs(b).max(initial=0.0)))
    for _ in range(rounds or 3 * m):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        j = int(np.argmax(gradient))
        if gradient[j] <= slack:
            break
        passive[j] = True
        while True:
            z = np.zeros(n)
            held = a[:, passive]
            z[passive] = np.linalg.solve(held.T @ held + 1e-9 * np.eye(held.shape[1]), held.T @ b)
            if z[passive].min() > 0:
                x = z
                break
            low = passive & (z <= 0)
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = x + step * (z - x)
            passive &= x > 1e-12
            x[~passive] = 0
            if not passive.any():
                break
    return x


def pack(lengths: np.ndarray, s: Settings) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of pieces of documents of these lengths, in document order."""
    w = s.window
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    for d in np.flatnonzero(lengths >= w).tolist():
        for k in range(int(lengths[d]) // w):
            pieces.append((d, k * w, w, sequence, 0))
            sequence += 1
    rest = lengths % w
    bins = w // s.step
    slot = -(-rest // s.step)
    waiting: list[list[int]] = [[] for _ in range(bins + 1)]
    for d in np.flatnonzero(rest)[::-1].tolist():
        waiting[slot[d]].append(d)
    listed, a = _matrix(bins, s.parts)
    counts = nnls(a, np.array([len(x) for x in waiting[1:]], dtype=float))
    for j in np.argsort(-counts, kind="stable").tolist():
        wanted = int(round(counts[j]))
        if wanted <= 0:
            break
        lengths_of = listed[j]
        for _ in range(min([wanted, *(len(waiting[b]) // lengths_of.count(b) for b in set(lengths_of))])):
            offset = 0
            for b in lengths_of:
                d = waiting[b].pop()
                n = int(rest[d])
                pieces.append((d, int(lengths[d]) - n, n, sequence, offset))
                offset += n
            sequence += 1
    offset = 0
    tail = [(d, int(lengths[d]) - int(rest[d]), int(rest[d])) for x in reversed(waiting) for d in x]
    total = sum(n for _, _, n in tail)
    whole = total // w * w
    ends = list(range(w, whole + 1, w))
    left, at = total - whole, whole
    while left:
        size = 1 << (left.bit_length() - 1)
        at += size
        left -= size
        ends.append(at)
    place, k = 0, 0
    for d, start, n in tail:
        while n:
            room = ends[k] - place
            take = min(room, n)
            pieces.append((d, start, take, sequence + k, offset))
            start, n, place = start + take, n - take, place + take
            offset = offset + take if take < room else 0
            k += take == room
    pieces.sort()
    return pieces


SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack_documents(docs: DataFrame, tokenizer_path: str, settings: Settings | None = None) -> DataFrame:
    """Pieces of the token ids of all rows of `docs` (doc_id, text), with their places in sequences.

    A row's ids are those of its whole text (null: empty) and `end_id`. `ids` holds a piece's ids as little-endian
    unsigned 32-bit numbers. Repeated rows are packed each; an empty table gives no piece. A long text is cut where
    sequences end, and other columns are not read. The tokenizer file is read on the executors. A sequence is full, or has a
    power of two of tokens, or is padded by less than `parts` times `step`.
    """
    s = settings or Settings()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = encoder(tokenizer_path, s)
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple[object, np.ndarray, np.ndarray]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            names = pa.concat_arrays([x[0] for x in held])
            sizes = np.concatenate([x[2] for x in held]) + 1
            ids = np.concatenate([x[1] for x in held])
            ends = np.cumsum(sizes) - 1
            full = np.full(len(ids) + len(sizes), s.end_id, dtype="<u4")
            inside = np.ones(len(full), dtype=bool)
            inside[ends] = False
            full[inside] = ids
            rows = np.array(pack(sizes, s), dtype=np.int64).reshape(-1, 5)
            offsets = np.r_[0, np.cumsum(rows[:, 2])] * 4
            data = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(full)]
            )
            out = pa.RecordBatch.from_arrays(
                [
                    names.take(pa.array(rows[:, 0])),
                    *(pa.array(c) for c in (rows[:, 1], rows[:, 2], sizes[rows[:, 0]], sequence + rows[:, 3], rows[:, 4])),
                    data.cast(pa.binary()),
                ],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )
            sequence += int(rows[:, 3].max()) + 1
            held.clear()
            return out

        for batch in batches:
            for lo, ids, sizes in words.encode(batch.column(1)):
                held.append((batch.column(0).slice(lo, len(sizes)), ids, sizes))
                tokens += len(ids)
                if tokens >= s.block_tokens:
                    yield flush()
                    tokens = 0
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), SCHEMA)
