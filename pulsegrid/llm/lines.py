"""Line deduplication over a sharded minimal perfect hash.

1. Each document's distinct line keys are hashed and counted over all documents (combined before the shuffle).
2. Keys of enough documents are dealt to shards by hash. Each shard is a minimal perfect hash (levels of bit arrays, ranks
   by counting bits) that gives a key its slot in two compact arrays: a fingerprint, which turns away lines that are no
   member, and a number of documents, which saturates.
3. Documents probe the arrays with the hashes of their lines. An index within `broadcast_bytes` goes to every task. A larger
   one stays with its shards: the distinct line hashes of each text travel to the shard they belong to, in salted parts of
   bounded size, and the hits travel back to the texts that have any.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.graph import in_table
from pulsegrid.llm.stream import key_runs, record_batch
from pulsegrid.llm.text import LOWER, NOT_SPACE, U64, code_points, document_blocks, lean, mix, span_hashes, utf8
from pulsegrid.session import stage_table

_OTHER_CODE = np.random.default_rng(23).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
LEVELS = 48


@dataclass(frozen=True)
class Settings:
    """Lines whose key has at least `min_chars` code points and stands in at least `min_docs` documents are dropped.

    `shard_keys` is about the number of keys of a shard, `broadcast_bytes` the largest index that goes to every task,
    `part_rows` about the largest number of line hashes that probe one shard in one task.
    """

    min_docs: int = 10
    min_chars: int = 1
    shard_keys: int = 1 << 16
    broadcast_bytes: int = 64 << 20
    part_rows: int = 1 << 20
    spread: float = 2.0


@dataclass
class Lines:
    """Lines of the documents of a block, in order: bytes `start` to `end` of `raw`, `first[k]:first[k + 1]` those of document k."""

    lo: int
    hi: int
    raw: np.ndarray
    begin: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    one: np.ndarray
    two: np.ndarray
    keyed: np.ndarray


def line_blocks(texts: pa.Array, s: Settings) -> Iterator[Lines]:
    """Lines of all texts and two hashes of each line's key; `keyed` marks keys of enough code points."""
    data, offsets = utf8(texts)
    for lo, hi in document_blocks(offsets):
        begin = offsets[lo : hi + 1] - offsets[lo]
        raw = data[offsets[lo] : offsets[hi]]
        feed = np.flatnonzero(raw == 10)
        owner = np.concatenate([np.arange(hi - lo), np.searchsorted(begin, feed, side="right") - 1])
        start = np.concatenate([begin[:-1], feed + 1])
        order = np.lexsort((start, owner))
        owner, start = owner[order], start[order]
        first = np.searchsorted(owner, np.arange(hi - lo + 1))
        end = np.empty_like(start)
        end[:-1] = start[1:] - 1
        end[first[1:] - 1] = begin[1:]
        solid = np.flatnonzero(NOT_SPACE[raw])
        a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
        some = a < b
        solid = np.append(solid, 0)
        left, right = np.where(some, solid[a], start), np.where(some, solid[b - 1] + 1, start)
        low, chars = LOWER[raw], code_points(raw)
        yield Lines(
            lo, hi, raw, begin, start, end, first, owner,
            span_hashes(low, left, right), span_hashes(low, left, right, _OTHER_CODE), chars[right] - chars[left] >= s.min_chars,
        )


_COUNTS = pa.schema([("one", pa.int64()), ("two", pa.int64()), ("n", pa.int64())])


def line_counts(docs: DataFrame, s: Settings) -> DataFrame:
    """(one, two, n): the documents (rows of `docs`) that hold each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in line_blocks(batch.column(0), s):
                one, two, owner = block.one[block.keyed], block.two[block.keyed], block.owner[block.keyed]
                if not len(one):
                    continue
                order = np.lexsort((owner, two, one))
                one, two, owner = one[order], two[order], owner[order]
                key = np.ones(len(one), dtype=bool)
                key[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
                document = key.copy()
                document[1:] |= owner[1:] != owner[:-1]
                at = np.flatnonzero(key)
                n = np.add.reduceat(document.astype(np.int64), at)
                yield record_batch(_COUNTS, [one[at].view(np.int64), two[at].view(np.int64), n])

    rows = docs.select("text").mapInArrow(lean(run), "one long, two long, n long")
    return rows.groupBy("one", "two").agg(F.sum("n").alias("n"))


def _level(one: np.ndarray, two: np.ndarray, level: int, width: np.ndarray | int) -> np.ndarray:
    """Bit position of each key at a level of `width` bits."""
    h = mix(one + two * U64(0x9E3779B97F4A7C15) + U64((2 * level + 1) * 0xD1B54A32D192ED03 % (1 << 64)))
    return (h % np.asarray(width, dtype=np.uint64)).astype(np.int64)


def build_shard(one: np.ndarray, two: np.ndarray, n: np.ndarray, s: Settings) -> tuple[bytes, bytes, bytes, bytes]:
    """Widths of the levels, bits, fingerprints and counts of one shard; the keys (one, two) are distinct.

    At each level the keys that fall on a bit alone take it; the others go on to the next.
    """
    widths, words, slots = np.zeros(LEVELS, np.int64), [], np.zeros(len(one), np.int64)
    left, base = np.arange(len(one)), 0
    for level in range(LEVELS):
        if not len(left):
            break
        widths[level] = -(-int(s.spread * len(left) + 1) // 64) * 64
        at = _level(one[left], two[left], level, widths[level])
        alone = np.bincount(at, minlength=widths[level]) == 1
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        taken = alone[at]
        slots[left[taken]] = base + at[taken]
        left, base = left[~taken], base + int(widths[level])
    if len(left):
        raise RuntimeError(f"{len(left)} line hashes cannot be told apart")
    order = np.argsort(slots)
    packed = np.concatenate(words) if words else np.zeros(0, np.uint64)
    counts = np.minimum(n[order], (1 << 16) - 1).astype(np.uint16)
    return widths.tobytes(), packed.tobytes(), two[order].tobytes(), counts.tobytes()


SHARDS = "shard int, widths binary, words binary, fingerprints binary, counts binary"
_SHARDS = pa.schema([("shard", pa.int32()), *[(c, pa.binary()) for c in ("widths", "words", "fingerprints", "counts")]])


def _shard_of(column: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.col(column), 64 - bits).cast("int") if bits else F.lit(0)


def build_index(frequent: DataFrame, bits: int, s: Settings) -> DataFrame:
    """The shards (rows of `SHARDS`) of the keys (one, two, n); 2 ** `bits` of them, empty ones left out."""
    rows = frequent.select(_shard_of("one", bits).alias("shard"), "one", "two", "n").repartition("shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys in key_runs(batches, 1):
            one, two, n = (np.asarray(keys.column(k)) for k in (1, 2, 3))
            built = build_shard(one.view(np.uint64), two.view(np.uint64), n, s)
            yield record_batch(_SHARDS, [[keys.column(0)[0].as_py()], *([part] for part in built)])

    return rows.mapInArrow(lean(run), SHARDS)


class Index:
    """The arrays of some shards laid end to end; keys of all of them are looked up at once."""

    def __init__(self, bits: int, shards: list[tuple]):
        self.bits = bits
        self.place = np.full(1 << bits, -1, dtype=np.int64)
        for k, (shard, *_) in enumerate(shards):
            self.place[shard] = k
        parts = [[np.frombuffer(row[c], dtype=t) for row in shards] for c, t in ((1, np.int64), (2, np.uint64), (3, np.uint64), (4, np.uint16))]
        self.widths = np.array(parts[0], dtype=np.int64).reshape(len(shards), LEVELS)
        whole = [np.concatenate(p) if p else np.zeros(0) for p in parts[1:]]
        self.words, self.fingerprints, self.counts = whole
        starts = np.concatenate([[0], np.cumsum(self.widths.ravel() // 64)])
        self.starts = starts[:-1].reshape(self.widths.shape)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words.astype(np.uint64)).astype(np.int64))])

    def documents(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Documents that hold each key (saturating); 0 for keys that are not in the index."""
        out = np.zeros(len(one), dtype=np.int64)
        shard = self.place[(one >> U64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(one), np.int64)]
        left = np.flatnonzero(shard >= 0)
        for level in range(LEVELS):
            left = left[self.widths[shard[left], level] > 0]
            if not len(left):
                break
            at = _level(one[left], two[left], level, self.widths[shard[left], level])
            word = self.starts[shard[left], level] + (at >> 6)
            bit = (at & 63).astype(np.uint64)
            held = self.words[word]
            found = (held >> bit) & U64(1) == 1
            slot = self.ranks[word] + np.bitwise_count(held & ((U64(1) << bit) - U64(1)))
            hit, slot = left[found], slot[found]
            true = self.fingerprints[slot] == two[hit]
            out[hit[true]] = self.counts[slot[true]]
            left = left[~found]
        return out


def without_lines(block: Lines, drop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts without the marked lines, and how many each lost."""
    kept = np.flatnonzero(~drop)
    last = np.zeros(len(drop), dtype=bool)
    if len(kept):
        last[kept[np.append(block.owner[kept[1:]] != block.owner[kept[:-1]], True)]] = True
    # A kept line takes its line feed along unless it is its document's last one.
    size = len(block.raw) + 2
    step = np.bincount(block.start[kept], minlength=size) - np.bincount(block.end[kept] + ~last[kept], minlength=size)
    mask = np.cumsum(step)[: len(block.raw)] > 0
    before = np.concatenate([[0], np.cumsum(mask)])
    return block.raw[mask], before[block.begin], np.add.reduceat(drop.astype(np.int64), block.first[:-1])


SCHEMA = "n_lines long, n_dropped long, kept binary"


def _dropping(rows: DataFrame, columns: list[str], extra: list[str], frequent: Callable[[Lines, pa.RecordBatch], np.ndarray], s: Settings) -> DataFrame:
    """`columns` of `rows` (which starts with text) and what is left of each text; `frequent` marks the lines that go."""
    kept = rows.select("text", *extra, *columns)
    width = 1 + len(extra)
    types = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes[width:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in line_blocks(batch.column(0), s):
                drop = frequent(block, batch)
                data, offsets, lost = without_lines(block, drop)
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), block.hi - block.lo, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                part = batch.slice(block.lo, block.hi - block.lo)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[width:], pa.array(np.diff(block.first)), pa.array(lost), texts.cast(pa.binary())],
                    names=[*part.schema.names[width:], "n_lines", "n_dropped", "kept"],
                )

    out = kept.mapInArrow(lean(run), f"{types}, {SCHEMA}")
    return out.withColumn("kept", F.col("kept").cast("string"))


def _identity(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each whole text."""
    data, offsets = utf8(texts)
    one, two = np.empty(len(texts), np.uint64), np.empty(len(texts), np.uint64)
    for lo, hi in document_blocks(offsets):
        raw, begin = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        one[lo:hi] = span_hashes(raw, begin[:-1], begin[1:])
        two[lo:hi] = span_hashes(raw, begin[:-1], begin[1:], _OTHER_CODE)
    return one.view(np.int64), two.view(np.int64)


def routed_hits(docs: DataFrame, index: DataFrame, bits: int, s: Settings) -> DataFrame:
    """(t1, t2, hits): the keys of enough documents (struct one, two) of each text that has any, found at the shards."""
    types = [("t1", pa.int64()), ("t2", pa.int64()), ("one", pa.int64()), ("two", pa.int64())]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = _identity(batch.column(0))
            for block in line_blocks(batch.column(0), s):
                at = np.flatnonzero(block.keyed)
                keys = np.unique(np.stack([block.owner[at].astype(np.uint64), block.one[at], block.two[at]], axis=1), axis=0)
                owner = block.lo + keys[:, 0].astype(np.int64)
                columns = [t1[owner], t2[owner], keys[:, 1].copy().view(np.int64), keys[:, 2].copy().view(np.int64)]
                yield record_batch(pa.schema(types), columns)

    probes = docs.select("text").mapInArrow(lean(send), "t1 long, t2 long, one long, two long")
    probes = probes.withColumn("shard", _shard_of("one", bits))
    sizes = probes.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(s.part_rows)).cast("int").alias("parts"))
    sizes = stage_table(sizes, "shard_parts")  # at most one row a shard
    probes = probes.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("t1", "t2", "one"), F.col("parts")).cast("int"))
    arrays = index.join(sizes, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    held = ["widths", "words", "fingerprints", "counts"]
    none = [F.lit(None).cast("long").alias(c) for c in ("t1", "t2", "one", "two")]
    rows = arrays.select("shard", "part", F.lit(0).alias("kind"), *none, *held).unionByName(
        probes.select("shard", "part", F.lit(1).alias("kind"), "t1", "t2", "one", "two", *[F.lit(None).cast("binary").alias(c) for c in held])
    )
    rows = rows.repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = None  # those of the shard that the probes at hand follow
        for batch in batches:
            shard, kind = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            heads = np.flatnonzero(kind == 0)
            for a, b in zip(np.r_[0, heads], np.r_[heads, len(kind)], strict=True):
                if a < b and kind[a] == 0:
                    arrays = int(shard[a]), Index(bits, [(int(shard[a]), *(batch.column(c)[int(a)].as_py() for c in range(7, 11)))])
                    a += 1
                if a == b or arrays is None:
                    continue
                part = batch.slice(a, b - a)
                one, two = (np.asarray(part.column(c)).view(np.uint64) for c in (5, 6))
                # Probes of a shard without keys follow the arrays of another one, which do not hold that shard.
                hit = np.flatnonzero(arrays[1].documents(one, two) >= s.min_docs)
                yield record_batch(pa.schema(types), [part.column(c).take(pa.array(hit)) for c in range(3, 7)])

    hits = rows.mapInArrow(lean(probe), "t1 long, t2 long, one long, two long")
    return hits.groupBy("t1", "t2").agg(F.collect_set(F.struct("one", "two")).alias("hits"))


def _with_identity(docs: DataFrame, columns: list[str]) -> DataFrame:
    rows = docs.select("text", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = _identity(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(t1), pa.array(t2), *batch.columns], names=["t1", "t2", *batch.schema.names])

    types = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(lean(run), f"t1 long, t2 long, {types}")


def drop_repeated_lines(docs: DataFrame, columns: list[str], settings: Settings | None = None) -> DataFrame:
    """`columns` of each row of `docs` (text) with n_lines, n_dropped and `kept`, the text without lines that many documents hold.

    A line's key is the line without white space at its ends, A-Z lower-cased; empty keys never count. Each row is a document,
    whatever its id, and counts once for each of its keys, so copies of a text count as often as they stand in the table. Null
    and empty texts have one empty line and stay empty. If all lines go, `kept` is empty. An empty table gives no rows. The
    result's names may not occur in `columns`; other columns are not read. Long texts are one block each and are never cut.
    """
    s = settings or Settings()
    counted = line_counts(docs, s)
    frequent = stage_table(counted.where(F.col("n") >= s.min_docs), "frequent_lines")
    n = frequent.count()
    bits = max(0, (n // s.shard_keys).bit_length())
    index = build_index(frequent, bits, s)
    # A fingerprint, a count, and bits with their ranks for each key.
    if n * 12 + (LEVELS * 8 << bits) <= s.broadcast_bytes:
        shards = [tuple(row.values()) for row in index.toArrow().to_pylist()]
        held = docs.sparkSession.sparkContext.broadcast((bits, shards))
        cache: list[Index] = []

        def found(block: Lines, batch: pa.RecordBatch) -> np.ndarray:
            if not cache:
                cache.append(Index(*held.value))
            return block.keyed & (cache[0].documents(block.one, block.two) >= s.min_docs)

        return _dropping(docs, columns, [], found, s)
    index = stage_table(index, "line_index")
    hits = stage_table(routed_hits(docs, index, bits, s), "line_hits")
    rows = _with_identity(docs, columns)
    # Texts without a hit are not shuffled.
    touched = hits.select("t1")
    none = F.lit(None).cast(hits.schema["hits"].dataType).alias("hits")
    clean = in_table(rows, "t1", touched, how="left_anti").select("text", *columns, none)
    rest = in_table(rows, "t1", touched).join(hits, ["t1", "t2"], "left").select("text", *columns, "hits")

    def told(block: Lines, batch: pa.RecordBatch) -> np.ndarray:
        drop = np.zeros(len(block.one), dtype=bool)
        lists = batch.column(1).slice(block.lo, block.hi - block.lo)
        for k in np.flatnonzero(np.asarray(lists.is_valid())):
            a, b = block.first[k], block.first[k + 1]
            pairs = lists[int(k)].values
            wanted = {(x, y) for x, y in zip(*(pairs.field(f).to_pylist() for f in (0, 1)), strict=True)}
            mine = zip(block.one[a:b].view(np.int64).tolist(), block.two[a:b].view(np.int64).tolist(), strict=True)
            drop[a:b] = [key in wanted for key in mine]
        return drop & block.keyed

    return _dropping(clean.unionByName(rest), columns, ["hits"], told, s)
