"""Spelling variants by a variable-length gram index.

1. Words are counted over all documents.
2. The gram dictionary holds the grams whose every proper prefix of two or more letters is frequent in the vocabulary; so a
   gram is extended only while it is common. It is kept as the set of frequent grams, whose size is bounded.
3. A word is decomposed into one gram a position: the shortest one there that is not frequent, of `cap` letters at most. One
   edit changes only grams that cover its place, so a word of G grams, of which at most A cover one place, shares at least
   G - A >= 1 of them with any word one edit away: at the same distance from the start if they stand before the edit,
   from the end if behind it. The rarest of the shared grams is among the A + 1 rarest of either word.
4. So each word is posted under its A + 1 rarest grams with their distances from start and from end; lists are merged,
   in pairs of blocks where they are long, and every pair found is verified letter by letter.

Words that differ by one letter more or less are met in the class of the shorter length, words of equal length in their
own; the class of length m caps grams at m - 2 letters, so that even the shortest words keep a gram that no edit touches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.stream import record_batch
from pulsegrid.llm.text import LOWER, U64, document_blocks, lean, mix, utf8
from pulsegrid.session import stage_table


@dataclass(frozen=True)
class Settings:
    """Words of at least `least` code points found at least `rare` times; a form is at least `ratio` times as frequent.

    In every `slip`-th pair of document and word one code point is deleted. Grams have 2 to `longest` letters; at most
    2 ** `frequent_bits` grams are frequent and 2 ** `sketch_bits` counters tell rare grams from common ones.
    """

    least: int = 5
    rare: int = 3
    ratio: int = 2
    slip: int = 97
    longest: int = 5
    frequent_bits: int = 16
    sketch_bits: int = 18
    block: int = 512

    def __post_init__(self):
        if self.least < 4 or not 3 <= self.longest <= 7:
            raise ValueError("words of at least 4 letters, grams of at most 3 to 7")


# Words


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> 1), c >> 1).astype(np.uint32)
    return c


_CRC = _crc_table()


def span_crc32(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: np.ndarray, long: int = 64) -> np.ndarray:
    """zlib.crc32 of each byte span, begun at `seed`; spans of more than `long` bytes are taken one by one."""
    out = np.empty(len(start), dtype=np.uint32)
    order = np.argsort(-size, kind="stable")
    many = int(np.searchsorted(-size[order], -long, side="left"))
    for i in order[:many]:
        out[i] = zlib.crc32(data[start[i] : start[i] + size[i]].tobytes(), int(seed[i]))
    order = order[many:]
    state, at, left = ~seed[order], start[order], size[order]
    for k in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -k, side="left"))
        now = state[:live]
        state[:live] = _CRC[(now ^ data[at[:live] + k]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    out[order] = ~state
    return out


def words_of(texts: pa.Array, ids: list[str], s: Settings) -> Iterator[pa.Array]:
    """The words of each block of texts as large_binary: runs of letters, with their deletions, of enough code points."""
    data, offsets = utf8(texts)
    for lo, hi in document_blocks(offsets, 1 << 20):
        begin = offsets[lo : hi + 1] - offsets[lo]
        low = LOWER[data[offsets[lo] : offsets[hi]]]
        if not len(low):
            continue
        # U+00C0 to U+00FF are the two-byte sequences that start with C3.
        lead = low == 0xC3
        tail = np.zeros(len(low), dtype=bool)
        tail[1:] = lead[:-1]
        inside = ((low >= 97) & (low <= 122)) | lead | tail
        edge = np.zeros(len(low) + 1, dtype=bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[0], edge[-1] = inside[0], inside[-1]
        cut = begin[1:-1][(begin[1:-1] > 0) & (begin[1:-1] < len(low))]
        cut = np.unique(cut[inside[cut] & inside[cut - 1]])  # runs end with their document
        bounds = np.sort(np.concatenate([np.flatnonzero(edge), cut, cut]))
        start, end = bounds[::2], bounds[1::2]
        points = np.zeros(len(low) + 1, dtype=np.int32)
        np.cumsum(~tail, out=points[1:])
        length = points[end] - points[start]
        enough = length >= s.least
        start, end, length = start[enough], end[enough], length[enough]
        owner = np.searchsorted(begin, start, side="right") - 1
        seeds = np.array([zlib.crc32(f"{i}:".encode()) for i in ids[lo:hi]], dtype=np.uint32)
        h = span_crc32(low, start, end - start, seeds[owner])
        slip = h % s.slip == 0
        # The other words as they stand: their bytes after one another.
        whole = np.flatnonzero(~slip)
        size = (end - start)[whole]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = low[np.repeat(start[whole] - ends[:-1], size) + np.arange(ends[-1])]
        yield pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(whole), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
        changed = []
        for i in np.flatnonzero(slip & (length > s.least)):
            word = low[start[i] : end[i]].tobytes().decode()
            k = int(h[i]) % len(word)
            changed.append((word[:k] + word[k + 1 :]).encode())
        if changed:
            yield pa.array(changed, pa.large_binary())


_COUNTS = pa.schema([("word", pa.binary()), ("n", pa.int64())])


def vocabulary(docs: DataFrame, s: Settings, held_words: int = 1 << 18) -> DataFrame:
    """(word, n) of the words found at least `rare` times; about `held_words` words are added up in a task before they go on."""

    def added(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for words in words_of(batch.column(1), batch.column(0).to_pylist(), s):
                counted = pc.value_counts(words)
                held.append(pa.table({"word": counted.field(0), "n": counted.field(1)}))
                if sum(t.num_rows for t in held) > held_words:
                    held = [added(held)]
                    if held[0].num_rows > held_words // 2:
                        yield from held[0].cast(_COUNTS).to_batches(max_chunksize=1 << 16)
                        held = []
        if held:
            yield from added(held).cast(_COUNTS).to_batches(max_chunksize=1 << 16)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").where("text is not null")
    rows = rows.mapInArrow(lean(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= s.rare)
    return rows.select(F.col("word").cast("string"), "n")


# Grams


def gram_codes(flat: np.ndarray, size: int) -> np.ndarray:
    """Number of the `size` letters from each position (one byte a letter, the size on top); short at the end of `flat`."""
    n = max(len(flat) - size + 1, 0)
    out = np.full(n, size << 56, dtype=np.uint64)
    for k in range(size):
        out |= flat[k : k + n].astype(np.uint64) << U64(8 * k)
    return out


@dataclass
class Words:
    """Words of one byte a letter, laid end to end."""

    flat: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Words:
        return cls(*utf8(column))

    def __post_init__(self):
        self.length = np.diff(self.offsets)
        self.owner = np.repeat(np.arange(len(self.length)), self.length)
        self.place = np.arange(len(self.flat)) - self.offsets[:-1][self.owner]
        self.behind = self.length[self.owner] - self.place  # letters from here to the end of the word


def _member(values: np.ndarray, codes: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(codes), dtype=bool)
    return values[np.minimum(np.searchsorted(values, codes), len(values) - 1)] == codes


def decompose(words: Words, cap: np.ndarray, frequent: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and number of the gram at each position of each word with two letters left.

    A gram grows while it is frequent, the word goes on, and it has fewer than `cap` letters of its word.
    """
    size = np.full(len(words.flat), 2, dtype=np.int64)
    most = np.minimum(cap[words.owner], words.behind)
    growing = np.flatnonzero(most > 2)
    codes = gram_codes(words.flat, 2)
    number = np.zeros(len(words.flat), dtype=np.uint64)
    number[: len(codes)] = codes
    for n in range(2, longest):
        growing = growing[most[growing] > n]
        growing = growing[_member(frequent, number[growing])]
        number[growing] = gram_codes(words.flat, n + 1)[growing]
        size[growing] = n + 1
    at = np.flatnonzero(words.behind >= 2)
    return at, size[at], number[at]


def gram_counts(vocab: DataFrame, s: Settings) -> DataFrame:
    """(gram, n): how often each gram of 2 to `longest` letters stands in the words of `vocab` (latin)."""
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words.of(batch.column(0))
            for size in range(2, s.longest + 1):
                codes = gram_codes(words.flat, size)
                codes, n = np.unique(codes[words.behind[: len(codes)] >= size], return_counts=True)
                yield record_batch(schema, [codes.view(np.int64), n])

    return vocab.select("latin").mapInArrow(lean(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _slot(codes: np.ndarray, bits: int) -> np.ndarray:
    return (mix(codes) >> U64(64 - bits)).astype(np.int64)


@dataclass
class Dictionary:
    """Numbers of the frequent grams, in order, and counters of all grams."""

    frequent: np.ndarray
    sketch: np.ndarray


def dictionary(vocab: DataFrame, s: Settings) -> Dictionary:
    """A gram is frequent above total / 2 ** `frequent_bits` occurrences (64 at least), so there are no more than that many."""
    grams = stage_table(gram_counts(vocab, s), "grams")
    total = grams.agg(F.sum("n")).first()[0] or 0
    frequent = grams.where((F.col("n") > max(64, total >> s.frequent_bits)) & (F.shiftrightunsigned("gram", 56) < s.longest))
    numbers = np.sort(frequent.select("gram").toArrow()["gram"].to_numpy().view(np.uint64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << s.sketch_bits, dtype=np.int64)
        for batch in batches:
            np.add.at(held, _slot(np.asarray(batch.column(0)).view(np.uint64), s.sketch_bits), np.asarray(batch.column(1)))
        slot = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(held[slot])], names=["slot", "n"])

    rows = grams.mapInArrow(lean(count), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    sketch = np.zeros(1 << s.sketch_bits, dtype=np.int64)
    sketch[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return Dictionary(numbers, np.minimum(sketch, (1 << 31) - 1).astype(np.uint64))


def rarest_grams(words: Words, cap: np.ndarray, d: Dictionary, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Start and number of the grams that a word is posted under: its A + 1 rarest, and all as rare as the last of them."""
    at, size, number = decompose(words, cap, d.frequent, s.longest)
    if not len(at):
        return at, number
    # A: the most grams over one place, the affected-gram bound of the word.
    step = np.bincount(at, minlength=len(words.flat) + 1) - np.bincount(at + size, minlength=len(words.flat) + 1)
    affected = np.maximum.reduceat(np.cumsum(step)[:-1], words.offsets[:-1])
    rank = (d.sketch[_slot(number, s.sketch_bits)] << U64(32)) | (mix(number) >> U64(32))
    owner = words.owner[at]
    order = np.lexsort((rank, owner))
    first = np.searchsorted(owner, np.arange(len(words.length)))
    limit = rank[order][first + affected]
    keep = rank <= limit[owner]
    return at[keep], number[keep]


#: kind: 0 and 1 are lists by distance from the start, 2 and 3 from the end; even ones hold the shorter words of a class.
_POSTED = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("latin", pa.binary()), ("n", pa.int64())])


def postings(vocab: DataFrame, held, s: Settings) -> DataFrame:
    """(key, kind, latin, n): each word in the lists of its own length's class and of the next shorter one's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for longer in (0, 1):
                part = batch if not longer else batch.filter(pc.greater(pc.binary_length(batch.column(0)), s.least))
                if not part.num_rows:
                    continue
                words = Words.of(part.column(0))
                cap = np.minimum(words.length - longer - 2, s.longest)
                at, number = rarest_grams(words, cap, held.value, s)
                owner, place = words.owner[at], words.place[at]
                family = (words.length[owner] - longer).astype(np.uint64) * U64(0xD6E8FEB86659FD93)
                for end in (0, 1):
                    distance = (words.length[owner] - place if end else place).astype(np.uint64)
                    key = mix(number * U64(0x9E3779B97F4A7C15) + family + distance * U64(2) + U64(end))
                    rows = part.take(pa.array(owner))
                    kind = pa.array(np.full(len(at), 2 * end + longer, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), kind, rows.column(0), rows.column(1)], schema=_POSTED)

    return vocab.select("latin", "n").mapInArrow(lean(run), "key long, kind int, latin binary, n long")


# Pairs


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether `b` is `a` with one letter replaced, or with one more letter."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return len(b) == len(a) + 1 and a[k:] == b[k + 1 :]


class Matcher:
    """Verifies pairs of words, given by row; the first of a pair is not the longer one."""

    width = 32

    def __init__(self, words: Words):
        self.words, self.length = words, words.length
        self.rows = np.zeros((len(self.length), self.width), dtype=np.uint8)
        short = words.place < self.width
        self.rows[words.owner[short], words.place[short]] = words.flat[short]
        self.letters = np.zeros(len(self.length), dtype=np.uint64)
        if len(words.flat):
            bits = U64(1) << (words.flat.astype(np.uint64) * U64(0x9E37) >> U64(5) & U64(63))
            self.letters = np.bitwise_or.reduceat(bits, words.offsets[:-1])

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs at one edit."""
        close = np.bitwise_count(self.letters[i] ^ self.letters[j]) <= 2
        i, j = i[close], j[close]
        extra = self.length[j] - self.length[i]
        wide = self.length[j] > self.width
        good = np.zeros(len(i), dtype=bool)
        for k in np.flatnonzero(wide):
            good[k] = one_edit(self._word(i[k]), self._word(j[k]))
        same = np.flatnonzero((extra == 0) & ~wide)
        good[same] = (self.rows[i[same]] != self.rows[j[same]]).sum(axis=1, dtype=np.uint8) == 1
        more = np.flatnonzero((extra == 1) & ~wide)
        a, b = self.rows[i[more]], self.rows[j[more]]
        # Letters alike from the start, and shifted by one from there on up to the end of the shorter word.
        alike = np.concatenate([a == b, np.zeros((len(more), 1), bool)], axis=1).argmin(axis=1)
        shifted = np.concatenate([a[:, :-1] == b[:, 1:], np.ones((len(more), 1), bool)], axis=1)
        column = np.arange(self.width)
        good[more] = (shifted | (column < alike[:, None]) | (column >= self.length[i[more]][:, None])).all(axis=1)
        return i[good], j[good]

    def _word(self, k: int) -> bytes:
        return self.words.flat[self.words.offsets[k] : self.words.offsets[k + 1]].tobytes()


def listed_pairs(group: np.ndarray, kind: np.ndarray, at: np.ndarray, across: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of one list, about `most` at a time: i one of the shorter words, j behind it in the list.

    Rows are in order of group and kind. Lists by distance from the end join words of unequal length only; a pair of
    blocks (`across`) joins rows of different blocks (`at`) only.
    """
    n = len(group)
    stop = np.searchsorted(group, group, side="right")
    longs = np.searchsorted(group * 2 + (kind & 1), group * 2 + 1, side="left")
    low = np.where(kind >= 2, longs, np.arange(n) + 1)
    count = np.where(kind & 1, 0, np.maximum(stop - low, 0))
    ends = np.cumsum(count)
    a = 0
    while a < n:
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + most, side="right")))
        i = np.repeat(np.arange(a, b), count[a:b])
        j = np.arange(len(i)) - np.repeat(ends[a:b] - count[a:b] - done, count[a:b]) + low[i]
        valid = ~across[i] | (at[i] != at[j])
        yield i[valid], j[valid]
        a = b


_PAIRS = pa.schema([("latin", pa.binary()), ("other", pa.binary()), ("n_other", pa.int64())])


def near_pairs(posted: DataFrame, s: Settings) -> DataFrame:
    """(latin, other, n_other): both directions of each pair of words at one edit, several times if several lists hold it."""
    # Written first: few lists are long, and a small table joins without a shuffle of the postings.
    hot = stage_table(posted.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > s.block), "long_lists")
    rows = posted.join(hot, "key", "left")
    blocks = F.coalesce(F.ceil(F.col("size") / s.block), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("latin", "key"), F.col("blocks")).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("at", own)
    rows = rows.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("lo", F.least("at", "mate")).withColumn("hi", F.greatest("at", "mate"))
    rows = rows.select("key", "lo", "hi", "kind", "at", "latin", "n")
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "kind")

    def match(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, lo, hi, kind, at = (np.asarray(batch.column(k)).astype(np.int64) for k in range(5))
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        group = np.cumsum(fresh)
        crowd = np.bincount(group)[group] > 1
        if not crowd.any():
            return
        batch = batch.filter(pa.array(crowd))
        group, kind, at, across = group[crowd], kind[crowd], at[crowd], (lo != hi)[crowd]
        latin, n = batch.column(5), batch.column(6)
        matcher = Matcher(Words.of(latin))
        for i, j in listed_pairs(group, kind, at, across):
            i, j = matcher.near(i, j)
            if len(i):
                i, j = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
                yield pa.RecordBatch.from_arrays([latin.take(i), latin.take(j), n.take(j)], schema=_PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # the last list so far, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.concat_batches([*rest, batch]) if rest else batch
            last = np.ones(whole.num_rows, dtype=bool)
            for k in range(3):
                column = np.asarray(whole.column(k))
                last &= column == column[-1]
            cut = whole.num_rows - int(last.sum())
            yield from match(whole.slice(0, cut))
            rest = [whole.slice(cut)]
        for part in rest:
            yield from match(part)

    return rows.mapInArrow(lean(run), "latin binary, other binary, n_other long")


# Forms


def follow(forms: DataFrame, rounds: int = 40) -> DataFrame:
    """(word, root): where the forms (word, form) end. Each round doubles the steps; counts at least double with each step, so
    paths are short."""
    current = stage_table(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stage_table(current.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        if not joined.where("next is not null").take(1):
            return joined.select("word", "root")
        current = joined.drop("next")
    raise RuntimeError("forms did not settle")


def spelling_variants(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of `docs` (doc_id, text).

    `n_near` counts the words that differ by one inserted, deleted or replaced code point; `form` is the most frequent of
    them (ties: the smallest in code-point order) if it is at least `ratio` times as frequent, else null; `root` is the last
    word that forms lead to, the word itself if it has none. Null texts have no words, a null doc_id hashes as empty text,
    repeated rows count as often as they stand there, an empty table gives no rows; other columns are not read. Texts and
    words may have any length.
    """
    s = settings or Settings()
    vocab = stage_table(vocabulary(docs, s), "vocabulary")
    latin = vocab.select(F.encode("word", "ISO-8859-1").alias("latin"), "n")
    held = docs.sparkSession.sparkContext.broadcast(dictionary(latin, s))
    pairs = near_pairs(postings(latin, held, s), s)
    # One shuffle by word serves the two groupings.
    pairs = pairs.repartition("latin").groupBy("latin", "other").agg(F.first("n_other").alias("n_other"))
    pairs = pairs.select("latin", F.decode("other", "ISO-8859-1").alias("other"), "n_other")
    near = pairs.groupBy("latin").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best"))
    near = near.select(F.decode("latin", "ISO-8859-1").alias("word"), "n_near", F.col("best.other").alias("other"), (-F.col("best.less")).alias("n_other"))
    led = F.col("n_other") >= s.ratio * F.col("n")
    found = vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(led, F.col("other")).alias("form"), F.when(led, F.col("n_other")).alias("form_n")
    )
    found = stage_table(found, "forms")
    roots = follow(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
