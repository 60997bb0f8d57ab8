"""Near duplicates by an inverted join over MinHash signature coordinates.

1. One pass over the texts: each document's set of word shingles gives a digest and a signature of `coordinates` minima.
2. Documents with equal sets form a class that its smallest doc_id stands for.
3. Classes are posted under their coordinate-value pairs. Two signatures that agree in at least `matches` of H
   coordinates share one of the H - matches + 1 pairs that come first in any common order, so only that prefix is
   posted; the order is from rare to frequent (by a sketch of fixed size), which keeps postings short. Postings of
   one class are skipped.
4. Within postings, agreeing coordinates are counted and pairs above `matches` span candidate clusters. Large postings are cut into
   blocks and each pair of blocks is a group of its own; only a spanning forest of each group is emitted.
5. Within candidate clusters, likewise in pairs of blocks, links are confirmed on the full sets, again as forests.
   Skipping a pair whose ends are already connected loses no component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.graph import components, in_table
from pulsegrid.llm.stream import key_runs, record_batch
from pulsegrid.llm.text import NOT_SPACE, U64, lean, mix, word_blocks
from pulsegrid.session import stage_table


@dataclass(frozen=True)
class Settings:
    """100 * intersection >= `percent` * union links two sets.

    With 32 coordinates and 12 matches a pair at the threshold is missed with probability 5e-6. `block` bounds the
    documents compared in one group; `sketch_bits` bounds the frequency sketch that is broadcast (4 bytes an entry).
    """

    shingle: int = 5
    percent: int = 75
    coordinates: int = 32
    matches: int = 12
    block: int = 256
    sketch_bits: int = 18
    seed: int = 5

    @property
    def prefix(self) -> int:
        return self.coordinates - self.matches + 1

    def multipliers(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        odd = rng.integers(1, 1 << 62, self.shingle + self.coordinates, dtype=np.uint64) * U64(2) + U64(1)
        return odd[: self.shingle], odd[self.shingle :]


def shingle_sets(texts: pa.Array, s: Settings) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row with words; a text with fewer words is one shingle."""
    weights, _ = s.multipliers()
    for block in word_blocks(texts, NOT_SPACE):
        h, counts = block.hashes(), block.counts
        m = max(len(h) - s.shingle + 1, 0)
        rolled = np.zeros(m, dtype=np.uint64)
        for k in range(s.shingle):
            rolled += h[k : k + m] * weights[k]
        rolled = mix(rolled)
        for k in np.flatnonzero(counts):
            a, b = block.first[k], block.first[k + 1]
            if b - a >= s.shingle:
                yield block.lo + int(k), np.unique(rolled[a : b - s.shingle + 1])
            else:
                few = h[a:b] * weights[: b - a]
                yield block.lo + int(k), mix(few.sum(keepdims=True, dtype=np.uint64) + U64(b - a))


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """Two 63-bit sums that do not depend on order."""
    one, two = mix(shingles).sum(dtype=np.uint64), mix(shingles * U64(0x9E3779B97F4A7C15) + U64(7)).sum(dtype=np.uint64)
    return int(one >> U64(1)), int(two >> U64(1))


def signature(shingles: np.ndarray, coordinates: np.ndarray) -> bytes:
    out = np.empty(len(coordinates), dtype=np.uint32)
    for j, a in enumerate(coordinates):
        out[j] = ((shingles * a) >> U64(32)).min()
    return out.tobytes()


FINGERPRINT = "doc_id long, n_shingles long, d1 long, d2 long, signature binary"
_FINGERPRINT = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("signature", pa.binary())]
)


def fingerprints(docs: DataFrame, s: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, coordinates = s.multipliers()
        for batch in batches:
            n = batch.num_rows
            size, d1, d2, sig = [0] * n, [None] * n, [None] * n, [None] * n
            for row, shingles in shingle_sets(batch.column(1), s):
                size[row] = len(shingles)
                d1[row], d2[row] = digest(shingles)
                sig[row] = signature(shingles, coordinates)
            yield record_batch(_FINGERPRINT, [batch.column(0), size, d1, d2, sig])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), FINGERPRINT)


def _tokens(signatures: pa.Array, s: Settings) -> np.ndarray:
    """Coordinate-value pairs, one row a signature."""
    values = np.frombuffer(b"".join(signatures.to_pylist()), dtype=np.uint32).reshape(-1, s.coordinates)
    return values.astype(np.uint64) | (np.arange(s.coordinates, dtype=np.uint64) << U64(32))


def _slots(tokens: np.ndarray, s: Settings) -> np.ndarray:
    return (mix(tokens) >> U64(64 - s.sketch_bits)).astype(np.int64)


def frequency_sketch(classes: DataFrame, s: Settings) -> np.ndarray:
    """Documents' coordinate-value pairs counted in 2 ** sketch_bits slots, over all classes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << s.sketch_bits, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                held += np.bincount(_slots(_tokens(batch.column(0), s).ravel(), s), minlength=len(held))
        slot = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(held[slot])], names=["slot", "n"])

    rows = classes.select("signature").mapInArrow(lean(count), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << s.sketch_bits, dtype=np.uint32)
    out[rows["slot"].to_numpy()] = np.minimum(rows["n"].to_numpy(), (1 << 32) - 1)
    return out


def postings(classes: DataFrame, s: Settings) -> DataFrame:
    """(token, node) of each class under the rarest `prefix` of its coordinate-value pairs."""
    sketch = classes.sparkSession.sparkContext.broadcast(frequency_sketch(classes, s))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = _tokens(batch.column(1), s)
            order = np.lexsort((mix(tokens), sketch.value[_slots(tokens, s)]), axis=1)[:, : s.prefix]
            chosen = np.take_along_axis(tokens, order, 1)
            node = np.repeat(np.asarray(batch.column(0)), s.prefix)
            yield pa.RecordBatch.from_arrays([pa.array(chosen.ravel().astype(np.int64)), pa.array(node)], names=["token", "node"])

    return classes.select("node", "signature").mapInArrow(lean(post), "token long, node long")


def in_block_pairs(rows: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """Replicate each row of a group to its pairs of blocks (`lo`, `hi`); `at` is the row's own block.

    A group of at most `block` rows is one block. Blocks are by hash of the node, so no ranking is needed.
    """
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    at = F.pmod(F.xxhash64("node", group), blocks).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("at", at)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("lo", F.least("at", "other")).withColumn("hi", F.greatest("at", "other"))
    return rows.drop("other", "blocks")


class Forest:
    """Union by smallest root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _pairs(values: np.ndarray, sides: np.ndarray, lo: int, hi: int, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of pairs that agree in at least `matches` coordinates, best first; across two blocks if they differ."""
    left = np.flatnonzero(sides == lo)
    right = left if lo == hi else np.flatnonzero(sides == hi)
    same = np.zeros((len(left), len(right)), dtype=np.uint8)
    for j in range(values.shape[1]):
        same += values[left, j][:, None] == values[right, j][None, :]
    keep = same >= s.matches
    if lo == hi:
        keep &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
    i, j = np.nonzero(keep)
    score = same[i, j]
    order = np.argsort(-score.astype(np.int16), kind="stable")
    return left[i[order]], right[j[order]], score[order]


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def candidate_edges(posted: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """Forests (a, b) of the pairs that agree in enough coordinates, from postings of more than one class."""
    groups = posted.groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
    rows = posted.join(groups, "token").join(classes.select("node", "signature"), "node")
    rows = in_block_pairs(rows, "token", "size", 2 * s.block).select("token", "lo", "hi", "at", "node", "signature")
    rows = rows.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        for run in key_runs(batches, 3):
            if run.num_rows < 2:
                continue
            lo, hi = run.column(1)[0].as_py(), run.column(2)[0].as_py()
            node = np.asarray(run.column(4))
            values = np.frombuffer(b"".join(run.column(5).to_pylist()), dtype=np.uint32).reshape(-1, s.coordinates)
            trees = Forest(len(node))
            for i, j, _ in zip(*_pairs(values, np.asarray(run.column(3)), lo, hi, s), strict=True):
                if trees.join(i, j) and node[i] != node[j]:
                    found.add((int(max(node[i], node[j])), int(min(node[i], node[j]))))
            if len(found) > 100_000:
                yield record_batch(_EDGES, list(zip(*found, strict=True)))
                found.clear()
        if found:
            yield record_batch(_EDGES, list(zip(*found, strict=True)))

    return rows.mapInArrow(lean(link), "a long, b long").distinct()


def confirmed_edges(docs: DataFrame, clusters: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """Forests (a, b) of the links that hold on full sets, within candidate clusters (node, component)."""
    # Clusters of more than a block are few; their sizes are written first, so that members need not be dealt by cluster.
    sizes = stage_table(clusters.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") > s.block), "large_clusters")
    members = clusters.join(sizes, "component", "left").withColumn("size", F.coalesce("size", F.lit(1))).join(classes.select("node", "first", "d1", "d2"), "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("first"), "text").where("first is not null and text is not null")
    rows = in_table(texts, "first", members.select("first")).join(members, "first")
    rows = in_block_pairs(rows, "component", "size", s.block).select("component", "lo", "hi", "at", "node", "d1", "d2", "text")
    rows = rows.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingle sets instead of texts; rows whose text is not that of the class are left out."""
        names = ["component", "lo", "hi", "at", "node", "set"]
        for batch in batches:
            keep, sets = [], []
            d1, d2 = batch.column(5).to_pylist(), batch.column(6).to_pylist()
            for row, shingles in shingle_sets(batch.column(7), s):
                if digest(shingles) == (d1[row], d2[row]):
                    keep.append(row)
                    sets.append(shingles.tobytes())
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:5], pa.array(sets, pa.large_binary())], names=names)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, coordinates = s.multipliers()
        for run in key_runs(compact(batches), 3):
            if run.num_rows < 2:
                continue
            lo, hi = run.column(1)[0].as_py(), run.column(2)[0].as_py()
            node = np.asarray(run.column(4))
            sets = [np.frombuffer(x, dtype=np.uint64) for x in run.column(5).to_pylist()]
            values = np.frombuffer(b"".join(signature(x, coordinates) for x in sets), dtype=np.uint32).reshape(-1, s.coordinates)
            trees, out = Forest(len(node)), ([], [])
            for i, j, _ in zip(*_pairs(values, np.asarray(run.column(3)), lo, hi, s), strict=True):
                if trees.root(i) == trees.root(j) or not linked(sets[i], sets[j], s.percent):
                    continue
                trees.join(i, j)
                if node[i] != node[j]:
                    out[0].append(max(node[i], node[j]))
                    out[1].append(min(node[i], node[j]))
            if out[0]:
                yield record_batch(_EDGES, list(out))

    return rows.mapInArrow(lean(confirm), "a long, b long")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


CLASS = ["d1", "d2", "n_shingles"]


def linked_classes(marked: DataFrame, docs: DataFrame, s: Settings, by_text: bool) -> DataFrame:
    """(d1, d2, n_shingles, first, root) of each class of equal sets that has a doc_id; `root` is the smallest node that links reach.

    A class's node is its smallest doc_id (`first`), so that a repeated id joins the classes of its texts; or, `by_text`, a number of
    its own, fixed by writing the table.
    """
    classes = marked.where("n_shingles > 0").groupBy(*CLASS, "signature").agg(F.min("doc_id").alias("first")).where("first is not null")
    node = F.monotonically_increasing_id() if by_text else F.col("first")
    classes = stage_table(classes.withColumn("node", node), "classes")
    found = candidate_edges(postings(classes, s), classes, s)
    clusters = components(found)
    links = components(confirmed_edges(docs, clusters, classes, s))
    roots = classes.select(*CLASS, "first", "node").join(links, "node", "left")
    return roots.select(*CLASS, "first", F.coalesce("component", "node").alias("root"))


def near_duplicates(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of `docs` (doc_id, text); other columns are not read.

    `component_id` is the smallest doc_id that links reach; null and empty texts and texts of white space link with
    nothing. Rows that share a doc_id are one document, whatever their texts. A row without doc_id belongs to the class of
    its set, or to nothing (null) if no row of the class has an id, and links no others. `kept` is doc_id = component_id, nulls equal.
    Repeated rows are given as often as they stand there, ties do not occur (sets link or do not), long texts are read whole, and
    an empty table gives no rows.
    """
    s = settings or Settings()
    marked = stage_table(fingerprints(docs, s), "fingerprints")
    roots = linked_classes(marked, docs, s, by_text=False).drop("first")
    # A document of several classes (a repeated id) joins them.
    out = marked.select("doc_id", "n_shingles", "d1", "d2").join(roots, CLASS, "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("root"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", kept())


def without_near_duplicates(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row of each group of `docs` (doc_id, text, any others), and every row that belongs to none.

    Groups are of texts, not of ids: rows that share a doc_id but not a text are documents of their own. The row that stays has
    the smallest doc_id of its group; of rows with that id, the one with the smallest text, and one of rows that are alike. Rows without doc_id or
    without words stay, and so does every other row whose text links with none. Only rows that may go are shuffled.
    """
    s = settings or Settings()
    marked = stage_table(fingerprints(docs, s), "fingerprints")
    roots = stage_table(linked_classes(marked, docs, s, by_text=True), "groups")
    own = F.struct("first", "d1", "d2")
    several = roots.groupBy("root").agg(F.min(own).alias("stays"), F.count("*").alias("n")).where("n > 1").drop("n")
    roots = roots.join(stage_table(several, "stays"), "root", "left").select(*CLASS, F.coalesce("stays", own).alias("stays"))
    rows = marked.where("doc_id is not null and n_shingles > 0").groupBy("doc_id", *CLASS).agg(F.count("*").alias("copies"))
    rows = rows.join(roots, CLASS).withColumn("kept", F.struct("doc_id", "d1", "d2") == F.col("stays"))
    # Documents of which a row goes, and what becomes of each of their texts.
    touched = stage_table(rows.where(~F.col("kept") | (F.col("copies") > 1)).select("doc_id", *CLASS, "kept"), "touched")
    ids = touched.select("doc_id").distinct()
    columns = docs.columns
    free = in_table(docs, "doc_id", ids, how="left_anti")
    rest = with_class(in_table(docs, "doc_id", ids), s)
    judged = rest.join(touched.withColumnsRenamed({"doc_id": "__id", **{c: f"__{c}" for c in [*CLASS, "kept"]}}), ["__id", *[f"__{c}" for c in CLASS]], "left")
    single = judged.where("__kept is null").select(*columns)
    kept_rows = judged.where("__kept").select("__id", "__d1", "__d2", F.struct(*columns).alias("__row"))
    one = kept_rows.groupBy("__id", "__d1", "__d2").agg(F.min_by("__row", F.struct(F.xxhash64("__row.text"), "__row.text")).alias("__row"))
    return free.unionByName(single).unionByName(one.select("__row.*"))


def with_class(docs: DataFrame, s: Settings) -> DataFrame:
    """The rows of `docs` with the class of their text as `__id`, `__d1`, `__d2`, `__n_shingles`."""
    names = ["__id", "__d1", "__d2", "__n_shingles"]
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__text"), *docs.columns)
    types = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, one, two = [0] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows
            for row, shingles in shingle_sets(batch.column(1), s):
                size[row] = len(shingles)
                one[row], two[row] = digest(shingles)
            found = [pa.array(x, pa.int64()) for x in (one, two, size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found, *batch.columns[2:]], names=[*names, *batch.schema.names[2:]])

    return rows.mapInArrow(lean(run), f"__id long, __d1 long, __d2 long, __n_shingles long, {types}")


def kept() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("component_id"))
