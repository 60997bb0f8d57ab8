"""Benchmark decontamination: passages within a small edit distance of benchmark items, found by CGK embedding and LSH.

The CGK embedding reads a word sequence by a random walk: at step j it writes the word at its position and moves on if a
shared random bit of (j, word) says so. Two sequences at a small edit distance come to agree in most steps, so edit distance
becomes Hamming distance. A repetition has its own walk and samples a few steps; windows of documents that agree with an item
in all of them are candidates, and an exact edit distance over words decides. Windows start at each word of each document and are item-sized:
items are taken in classes by length, and each repetition starts the walk at another place of the item. Repetitions are added until a simulation with
edits at the allowed rate reaches the target recall at every length, or to a limit. What the walks miss is found without chance: an item is also cut into
one more piece than it may have edits, so in every match one piece at least stands word for word, and the pieces are looked up too. That is done for all items
(`exact`), or only for those of lengths at which the walks stayed below the target.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.stream import record_batch
from pulsegrid.llm.text import ALNUM, U64, HashSet, lean, mix, span_hashes, word_blocks


@dataclass(frozen=True)
class Settings:
    """A passage is a match within floor(`rate` * words of the item) word edits.

    `block_items` bounds the items that are broadcast at once; a larger benchmark takes several passes. `target_recall` and `max_repetitions` are
    those of the walks, with `trials` simulated passages a length. With `exact` no match is missed; without, walks alone find the
    target's share of passages at the allowed rate of edits, and more of less edited ones.
    """

    rate: float = 0.25
    samples: int = 3
    target_recall: float = 0.997
    max_repetitions: int = 96
    trials: int = 400
    exact: bool = True
    block_items: int = 50_000
    seed: int = 3


def folded_words(block) -> np.ndarray:
    """Word hashes with the capitals of Latin-1 read as small letters too."""
    data = block.data
    after = np.zeros(len(data), dtype=bool)
    after[1:] = data[:-1] == 0xC3
    data = np.where(after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97), data + 0x20, data)
    return span_hashes(data, block.start, block.end)


@dataclass(frozen=True)
class Walk:
    """One repetition for one class of lengths: multipliers give the bit of each step, `steps` are sampled."""

    size: int
    fraction: float
    by_place: bool
    multipliers: np.ndarray
    steps: tuple[int, ...]

    @classmethod
    def draw(cls, size: int, number: int, s: Settings) -> Walk:
        rng = np.random.default_rng([s.seed, size, number])
        reach = max(size, 1)
        steps = np.sort(rng.choice(np.arange(1, reach), min(s.samples - 1, reach - 1), replace=False)) if reach > 1 else []
        multipliers = rng.integers(1, 1 << 62, reach + 1, dtype=np.uint64) * U64(2) + U64(1)
        return cls(size, (number * 0.618034) % 1.0, number % 2 == 1, multipliers, (0, *map(int, steps)))

    def signatures(self, words: np.ndarray, at: np.ndarray, among: list[HashSet] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Starting positions and signatures of the walks from `at`; those outside `among`, level by level from the second on, are dropped."""
        place, last = at, len(words) - 1
        sign = np.full(len(at), self.size, dtype=np.uint64)
        for level, step in enumerate(self.steps):
            for j in range(self.steps[level - 1] if level else 0, step):
                place = np.minimum(place + ((words[place] * self.multipliers[j]) >> U64(63)).astype(np.int64), last)
            sign = mix(sign * U64(0x9E3779B97F4A7C15) + words[place])
            if among is not None and level:  # the first word is known to be one of the table's
                keep, _ = among[level].find(sign)
                at, place, sign = at[keep], place[keep], sign[keep]
        return at, sign

    def places(self, words: np.ndarray, at: int) -> list[int]:
        """Where a walk from `at` stands at each sampled step; none from the first step on that lies behind the last word.

        In a document other words follow an item, so a walk over its end reads other words there.
        """
        out, place = [], at
        for level, step in enumerate(self.steps):
            for j in range(self.steps[level - 1] if level else 0, step):
                place += int(words[place]) * int(self.multipliers[j]) >> 63 & 1
                if place == len(words):
                    return out
            out.append(place)
        return out

    def levels(self, words: np.ndarray, at: int) -> list[int]:
        """Signature of a walk from `at` after each sampled step that stands inside the words."""
        out, sign = [], U64(self.size)
        with np.errstate(over="ignore"):
            for place in self.places(words, at):
                sign = mix(np.array([sign * U64(0x9E3779B97F4A7C15) + words[place]]))[0]
                out.append(sign)
        return out


@dataclass(frozen=True)
class Piece:
    """Words that stand one after another, read as a walk that moves on at each step."""

    size: int

    def signatures(self, words: np.ndarray, at: np.ndarray, among: list[HashSet] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Starting positions and signatures of the pieces from `at`; those outside `among`, word by word, are dropped."""
        at = at[at + self.size <= len(words)]
        sign = np.full(len(at), self.size, dtype=np.uint64)
        for level in range(self.size):
            sign = mix(sign * U64(0x9E3779B97F4A7C15) + words[at + level])
            if among is not None and level:
                keep, _ = among[level].find(sign)
                at, sign = at[keep], sign[keep]
        return at, sign

    def levels(self, words: np.ndarray, at: int) -> list[int]:
        """Signature of the piece from `at` after each word."""
        out, sign = [], np.array([self.size], dtype=np.uint64)
        for word in words[at : at + self.size]:
            sign = mix(sign * U64(0x9E3779B97F4A7C15) + word)
            out.append(sign[0])
        return out


def distance(item: list[int], words: list[int], most: int) -> tuple[int, int]:
    """Smallest edit distance of `item` to any run of `words`, and the end of the first such run (bit-parallel)."""
    n = len(item)
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | (1 << i)
    mask, top = (1 << n) - 1, 1 << (n - 1)
    up, down, now, best, end = mask, 0, n, n, 0
    for j, w in enumerate(words):
        same = where.get(w, 0)
        x = same | down
        across = (((same & up) + up) ^ up) | same
        plus = down | (~(across | up) & mask)
        minus = up & across
        if plus & top:
            now += 1
        elif minus & top:
            now -= 1
        plus, minus = (plus << 1) & mask, (minus << 1) & mask
        up, down = minus | (~(x | plus) & mask), plus & x
        if now < best:
            best, end = now, j + 1
    return (best, end) if best <= most else (most + 1, 0)


class Index:
    """Signatures of benchmark items for all repetitions of all classes of lengths."""

    def __init__(self, ids: list, texts: list[str | None], s: Settings):
        self.settings = s
        self.ids, self.words = [], []
        for block in word_blocks(pa.array(texts, pa.string()), ALNUM):
            h = folded_words(block)
            for k in np.flatnonzero(block.counts):
                self.ids.append(ids[block.lo + int(k)])
                self.words.append(h[block.first[k] : block.first[k + 1]])
        self.common = Counter(w for words in self.words for w in set(words.tolist()))
        self.tables: list[tuple[Walk | Piece, list[HashSet], tuple[np.ndarray, np.ndarray], np.ndarray]] = []
        self.short: list[int] = []
        classes: dict[int, list[int]] = {}
        for i, words in enumerate(self.words):
            classes.setdefault(1 << (len(words).bit_length() - 1), []).append(i)
        for size, members in sorted(classes.items()):
            self._add_class(size, members)
        self.first_words = HashSet([self.words[i][o] for _, _, held, _ in self.tables for i, o in zip(*held, strict=True)])
        walks = len(self.tables)
        self._add_pieces(range(len(self.words)) if s.exact else self.short)
        self.pieces = self.tables[walks:]
        del self.tables[walks:]
        self.piece_words = HashSet([self.words[i][o] for _, _, held, _ in self.pieces for i, o in zip(*held, strict=True)])
        self.begins = [self._first(self.first_words, t) for t in self.tables], [self._first(self.piece_words, t) for t in self.pieces]
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.most = np.floor(s.rate * self.sizes).astype(np.int64)
        self.members = HashSet(np.concatenate([self.keyed(w, np.full(len(w), i)) for i, w in enumerate(self.words)]) if self.words else [])

    def _first(self, among: HashSet, table) -> np.ndarray:
        """Which of the first words of all tables are first words of this one."""
        out = np.zeros(len(among.values), dtype=bool)
        _, rank = among.find(np.array([self.words[i][o] for i, o in zip(*table[2], strict=True)], dtype=np.uint64))
        out[rank] = True
        return out

    @staticmethod
    def keyed(words: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Hash of each word as a word of an item."""
        return mix(words + (items.astype(np.uint64) + U64(1)) * U64(0xD6E8FEB86659FD93))

    def start(self, walk: Walk, words: np.ndarray) -> int:
        """Where the walk starts in an item: by place alone, or at the rarest word of the benchmark near the repetition's place.

        If its sampled steps do not stay inside the item, or stand on one word, which says little, the next best place where they
        do better is taken; from the first word they stay inside.
        """
        if walk.by_place:
            span = list(range(int(walk.fraction * len(words)), -1, -1))
        else:
            room = len(words) - walk.size
            near = max(1, walk.size // 4)
            at = int(walk.fraction * (room + near))
            span = list(range(max(0, at - near), min(len(words) - 1, at + near) + 1))
            span.sort(key=lambda k: (self.common[int(words[k])], abs(k - at)))
        first = None
        for k in span:
            at = walk.places(words, k)
            if len(at) == len(walk.steps):
                if len(set(words[at].tolist())) == len(at):
                    return k
                first = k if first is None else first
        return first or 0

    #: Words of simulated passages that are held at once, and lengths that are simulated of a class.
    SIMULATED, LENGTHS = 1 << 21, 32

    def _add_class(self, size: int, members: list[int]) -> None:
        s = self.settings
        rng = np.random.default_rng([s.seed, size])
        by_length: dict[int, list[int]] = {}
        for i in members:
            by_length.setdefault(len(self.words[i]), []).append(i)
        lengths = sorted(by_length)
        lengths = [lengths[k] for k in np.unique(np.linspace(0, len(lengths) - 1, min(self.LENGTHS, len(lengths))).astype(int))]
        trials = max(20, min(s.trials, self.SIMULATED // (3 * size * len(lengths))))
        item, length, passages = [], [], []
        for n in lengths:
            for i in rng.choice(by_length[n], trials).tolist():
                after = rng.integers(1, 1 << 62, size + 1, dtype=np.uint64)  # other words follow in a document
                item.append(i)
                length.append(n)
                passages.append(np.concatenate([edited(self.words[i], int(s.rate * n), rng), after]))
        item, length = np.array(item), np.array(length)
        trial = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
        words, missed = np.concatenate(passages), np.ones(len(passages), dtype=bool)
        allowed = (1 - s.target_recall) * trials
        for number in range(s.max_repetitions):
            walk = Walk.draw(size, number, s)
            starts = [self.start(walk, self.words[i]) for i in members]
            final = dict(zip(members, self._add_table(walk, members, starts), strict=True))
            begin = {i: self.words[i][at] for i, at in zip(members, starts, strict=True)}
            at = np.flatnonzero(words == np.array([begin[i] for i in item.tolist()], dtype=np.uint64)[trial])
            met = walk.signatures(words, at)[1] == np.array([final[i] for i in item.tolist()], dtype=np.uint64)[trial[at]]
            missed[trial[at[met]]] = False
            if all(missed[length == n].sum() <= allowed for n in lengths):
                return
        below = {n for n in lengths if missed[length == n].sum() > allowed}
        # A length that was not simulated goes with its neighbours.
        self.short += [i for i in members if below & {max(n for n in lengths if n <= len(self.words[i])), min(n for n in lengths if n >= len(self.words[i]))}]

    def _add_table(self, walk: Walk | Piece, members: list[int], starts: list[int]) -> list[int]:
        signs = [walk.levels(self.words[i], at) for i, at in zip(members, starts, strict=True)]
        sets = [HashSet([x[level] for x in signs]) for level in range(len(signs[0]))]
        final = np.array([x[-1] for x in signs], dtype=np.uint64)
        order = np.argsort(final, kind="stable")
        bounds = np.searchsorted(final[order], np.r_[sets[-1].values, U64((1 << 64) - 1)])
        bounds[-1] = len(final)
        self.tables.append((walk, sets, (np.asarray(members)[order], np.asarray(starts)[order]), bounds))
        return final.tolist()

    def _add_pieces(self, members) -> None:
        """Tables of the pieces of some items, by length: an item has one more than the edits it may have."""
        sizes: dict[int, list[tuple[int, int]]] = {}
        for i in members:
            n = len(self.words[i])
            parts = int(math.floor(self.settings.rate * n)) + 1
            cuts = [k * n // parts for k in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                sizes.setdefault(b - a, []).append((i, a))
        for size, held in sorted(sizes.items()):
            self._add_table(Piece(size), *map(list, zip(*held, strict=True)))

    def candidates(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(position, item, start in the item, by a walk) of windows that agree with an item's sampled steps or with a piece, in bounded lots."""
        waiting: list[tuple[np.ndarray, ...]] = []
        for tables, first_words, begins, walked in (
            (self.tables, self.first_words, self.begins[0], True),
            (self.pieces, self.piece_words, self.begins[1], False),
        ):
            at_starts, rank_of = first_words.find(words)
            for (walk, sets, (items, starts), bounds), begin in zip(tables, begins, strict=True):
                at, sign = walk.signatures(words, at_starts[begin[rank_of]], sets)
                if not len(at):
                    continue
                found, rank = sets[-1].find(sign)
                size = bounds[rank + 1] - bounds[rank]
                total = np.cumsum(size)
                for lo in range(0, int(total[-1]) if len(total) else 0, LOT):
                    each = np.arange(lo, min(lo + LOT, int(total[-1])))
                    hit = np.searchsorted(total, each, side="right")
                    which = each - (total - size)[hit] + bounds[rank[hit]]
                    waiting.append((at[found[hit]], items[which], starts[which], np.full(len(each), walked)))
                    if sum(len(w[0]) for w in waiting) >= LOT:
                        yield tuple(map(np.concatenate, zip(*waiting, strict=True)))
                        waiting = []
        if waiting:
            yield tuple(map(np.concatenate, zip(*waiting, strict=True)))

    def likely(self, words: np.ndarray, items: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Which of the windows `lo` to `hi` hold as many words of their items as a match has at least."""
        out = np.zeros(len(items), dtype=bool)
        ends = np.cumsum(hi - lo)
        a = 0
        while a < len(items):
            done = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, done + 4 * LOT, side="right")))
            size = (hi - lo)[a:b]
            window = np.repeat(np.arange(a, b), size)
            at = np.arange(len(window)) - np.repeat(ends[a:b] - size - done, size) + lo[window]
            held, _ = self.members.find(self.keyed(words[at], items[window]))
            out[a:b] = np.bincount(window[held] - a, minlength=b - a) >= (self.sizes - self.most)[items[a:b]]
            a = b
        return out


def edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """A copy with so many random word replacements, insertions and deletions."""
    out = words.tolist()
    for _ in range(edits):
        k, kind, new = int(rng.integers(0, max(len(out), 1))), int(rng.integers(0, 3)), int(rng.integers(1, 1 << 62))
        out[k : k + (kind != 1)] = [new] if kind < 2 else []
    return np.array(out, dtype=np.uint64)


#: Candidates that are held at once before they are gathered by document and item.
LOT = 1 << 18

SCHEMA = "doc_id long, item_id long, distance long, item_words long, start_word long, end_word long, by_walk boolean"
_SCHEMA = pa.schema([*[(name, pa.int64()) for name in ("doc_id", "item_id", "distance", "item_words", "start_word", "end_word")], ("by_walk", pa.bool_())])


def _matches(block, words: np.ndarray, index: Index, s: Settings) -> Iterator[tuple[int, int, int, int, int, bool]]:
    """(document, item, distance, first word about, end word, by a walk) of the best match of each item in each document of a block."""
    kept: list[tuple[np.ndarray, ...]] = []
    for at, items, starts, walked in index.candidates(words):
        docs, begins = np.searchsorted(block.first, at, side="right") - 1, at - starts
        order = np.lexsort((~walked, begins, items, docs))
        docs, items, begins, walked = docs[order], items[order], begins[order], walked[order]
        fresh = np.ones(len(docs), dtype=bool)
        fresh[1:] = (np.diff(docs) != 0) | (np.diff(items) != 0) | (np.diff(begins) != 0)
        docs, items, begins, walked = docs[fresh], items[fresh], begins[fresh], walked[fresh]
        lo = np.maximum(block.first[docs], begins - index.most[items])
        hi = np.minimum(block.first[docs + 1], begins + index.sizes[items] + index.most[items])
        good = index.likely(words, items, lo, hi)
        kept.append((docs[good], items[good], begins[good], walked[good]))
    if not any(len(k[0]) for k in kept):
        return
    docs, items, begins, walked = map(np.concatenate, zip(*kept, strict=True))
    order = np.lexsort((begins, items, docs))
    docs, items, begins, walked = docs[order], items[order], begins[order], walked[order]
    # Windows that overlap are read as one, so no word is compared twice with an item.
    apart = np.ones(len(docs), dtype=bool)
    apart[1:] = (np.diff(docs) != 0) | (np.diff(items) != 0) | (np.diff(begins) > (index.sizes + 2 * index.most)[items[1:]])
    cuts = np.flatnonzero(apart).tolist()
    best: dict[tuple[int, int], tuple[int, int, int, bool]] = {}
    for a, b in zip(cuts, [*cuts[1:], len(docs)], strict=True):
        d, i = int(docs[a]), int(items[a])
        item, n, most = index.words[i], int(index.sizes[i]), int(index.most[i])
        first, last = int(block.first[d]), int(block.first[d + 1])
        lo, hi = max(first, int(begins[a]) - most), min(last, int(begins[b - 1]) + n + most)
        found, end = distance(item.tolist(), words[lo:hi].tolist(), most)
        if found <= most:
            end = lo + end - first
            now = (found, max(0, end - n), end, bool(walked[a:b].any()))
            best[d, i] = min(best.get((d, i), (most + 1, 0, 0, False)), now)
    for (d, i), match in sorted(best.items()):
        yield d, i, *match


def _indexes(spark: SparkSession, benchmark: DataFrame, s: Settings) -> Iterator[Broadcast]:
    """Broadcast indexes of the benchmark, one for each pass of at most about `block_items` items."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null")
    passes = max(1, -(-items.count() // s.block_items))
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).orderBy("item_id", "text").collect()
        yield spark.sparkContext.broadcast(Index([r["item_id"] for r in part], [r["text"] for r in part], s))


def _found(texts: pa.Array, index: Index, s: Settings) -> Iterator[tuple[int, int, int, int, int, bool]]:
    """(row, item, distance, start word, end word, by a walk) of all matches in a batch of texts."""
    for block in word_blocks(texts, ALNUM):
        if len(block.start):
            for d, *rest in _matches(block, folded_words(block), index, s):
                yield block.lo + d, *rest


def contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row for each document and benchmark item (doc_id, text; item_id, text) that match.

    Words are runs of letters and digits, case-folded. `distance` is the smallest edit distance in words of the item to a
    run of the document's words around its candidate windows; `end_word` is where the first such run ends, `start_word` as
    many words before as the item has; `by_walk` says whether a walk met the run, or only a piece did. Null and empty texts on either
    side match nothing, empty tables give no rows; repeated rows and items are matched each, and of places at one distance the first counts.
    An item of fewer than 1 / rate words matches only itself. Long texts are one block each and are read whole; other columns are
    not read. No row is shuffled.
    """
    s = settings or Settings()
    out = None
    for index in _indexes(docs.sparkSession, benchmark, s):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            held = index.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [
                    (ids[row], held.ids[i], edits, len(held.words[i]), begin, end, walked)
                    for row, i, edits, begin, end, walked in _found(batch.column(1), held, s)
                ]
                if rows:
                    yield record_batch(_SCHEMA, list(zip(*rows, strict=True)))

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), SCHEMA)
        out = found if out is None else out.union(found)
    return out


def uncontaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text matches no benchmark item; no row is shuffled.

    Rows without a text or an id stay, repeated rows stay or go together, and an empty table stays empty.
    """
    s = settings or Settings()
    text = docs.columns.index("text")
    for index in _indexes(docs.sparkSession, benchmark, s):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[row for row, *_ in _found(batch.column(text), index.value, s)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
