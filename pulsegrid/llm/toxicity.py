"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features of a whole text are lexicon densities (a fixed list and words and word stems learned from labels),
nearness of second-person words to lexicon words, capitals, punctuation and obfuscation rates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from pulsegrid.llm.stream import record_batch
from pulsegrid.llm.text import ALNUM, U64, hash_of, HashSet, lean, mix, word_blocks
from pulsegrid.session import stage_table

INSULTS = (
    "idiot idiots moron morons stupid dumb fool loser losers trash garbage scum filth worthless pathetic disgusting "
    "clown jerk vermin imbecile coward liar hate shut idiota idiotas estúpido basura imbécil escoria idiote imbécile "
    "stupide ordure dummkopf abschaum trottel versager müll"
).split()
SECOND_PERSON = "you your yours yourself youre u ur tu te ti tus usted ustedes toi vous votre vos ton ta tes du dich dir dein deine ihr euch sie".split()

#: Bytes of a word that are hashed as its stem.
STEMS = (4, 5, 6)
NEAR = 5
FEATURES = [
    "log_words",
    "log_insults",
    "insult_density",
    "log_learned",
    "learned_weight",
    "learned_density",
    "strongest_learned",
    "second_person_near",
    "second_person_density",
    "capital_rate",
    "shouted_words",
    "exclamation_rate",
    "symbol_rate",
    "inner_symbol_rate",
    "log_unmasked_insults",
]

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[128:] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[33:48] = _SYMBOL[58:65] = _SYMBOL[91:97] = _SYMBOL[123:127] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLAIN = np.arange(256, dtype=np.uint8)
for _mask, _letter in zip("013457@$!", "oieastasi", strict=True):
    _PLAIN[ord(_mask)] = ord(_letter)


@dataclass(frozen=True)
class Settings:
    """`max_rows` bounds the labelled rows that are learned from, `max_lexicon` the learned words and stems."""

    max_rows: int = 20_000
    max_lexicon: int = 2_000
    min_support: int = 4
    min_log_odds: float = 2.0
    min_z: float = 4.0
    calibration_share: float = 0.25
    trees: int = 24
    depth: int = 3
    step: float = 0.25
    threshold: float = 0.7


@dataclass(frozen=True)
class Lexicon:
    """Learned words and stems by hash, with their log odds."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))


def word_keys(block) -> list[np.ndarray]:
    """Hashes of each word and of its stems; a stem's hash differs from that of the same word."""
    whole = block.hashes()
    size = block.end - block.start
    out = [whole]
    for n in STEMS:
        stem = mix(block.hashes(upto=n) + U64(n))
        out.append(np.where(size >= n, stem, whole))
    return out


def _hits(found: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    out = np.zeros(n, dtype=bool)
    out[found[0]] = True
    return out


class Measure:
    """Features of Arrow text columns, one row a text."""

    def __init__(self, lexicon: Lexicon):
        self.insults = HashSet([hash_of(w) for w in INSULTS])
        self.persons = HashSet([hash_of(w) for w in SECOND_PERSON])
        self.learned = HashSet(lexicon.hashes)
        order = np.argsort(lexicon.hashes)
        self.weights = lexicon.weights[order]

    def __call__(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), len(FEATURES)))
        for block in word_blocks(texts, ALNUM):
            out[block.lo : block.hi] = self._block(block)
        return out

    def _block(self, block) -> np.ndarray:
        n, owner = block.hi - block.lo, block.owner()
        total = lambda marks: np.bincount(owner, weights=marks, minlength=n)
        keys = word_keys(block)
        insult = _hits(self.insults.find(keys[0]), len(owner))
        weight = np.zeros(len(owner))
        for key in keys:
            at, rank = self.learned.find(key)
            np.maximum.at(weight, at, self.weights[rank])
        hit = insult | (weight > 0)
        person = _hits(self.persons.find(keys[0]), len(owner))
        before = np.r_[0, np.cumsum(person)]
        at = np.flatnonzero(hit)
        doc = owner[at]
        near = before[np.minimum(at + NEAR + 1, block.first[doc + 1])] > before[np.maximum(at - NEAR, block.first[doc])]
        strongest = np.zeros(n)
        np.maximum.at(strongest, owner, weight)

        bytes_of = np.repeat(np.arange(n), np.diff(block.begin))
        count = lambda marks: np.bincount(bytes_of, weights=marks, minlength=n)
        letter = _LETTER[block.data]
        capital = (block.raw >= 65) & (block.raw <= 90)
        symbol = _SYMBOL[block.data]
        inner = np.zeros(len(symbol), dtype=bool)
        inner[1:-1] = ~letter[1:-1] & ~_SPACE[block.data[1:-1]] & letter[:-2] & letter[2:]
        # What stands at either end of a text has no neighbour in it.
        ends = np.concatenate([block.begin[:-1], block.begin[1:] - 1])
        inner[ends[(ends >= 0) & (ends < len(inner))]] = False
        exclamation = (block.data == 33) | (block.data == 63)
        capitals = np.r_[0, np.cumsum(capital)]
        size = block.end - block.start
        shouted = (size > 2) & (capitals[block.end] - capitals[block.start] == size)
        words = np.maximum(block.counts, 1)
        chars = np.maximum(np.diff(block.begin), 1)
        letters = np.maximum(count(letter), 1)
        return np.stack(
            [
                np.log1p(block.counts),
                np.log1p(total(insult)),
                total(insult) / words,
                np.log1p(total(weight > 0)),
                total(weight),
                total(weight) / words,
                strongest,
                np.bincount(doc, weights=near, minlength=n),
                total(person) / words,
                count(capital) / letters,
                total(shouted) / words,
                count(exclamation) / chars,
                count(symbol) / chars,
                count(inner) / chars,
                np.log1p(self._unmasked(block, bytes_of, inner, n)),
            ],
            axis=1,
        )

    def _unmasked(self, block, bytes_of: np.ndarray, inner: np.ndarray, n: int) -> np.ndarray:
        """Insults in texts that hold masked letters, once these are read as letters and other symbols are dropped."""
        docs = np.unique(bytes_of[inner])
        out = np.zeros(n)
        if not len(docs):
            return out
        texts = []
        for d in docs:
            data = _PLAIN[block.data[block.begin[d] : block.begin[d + 1]]]
            texts.append(data[_LETTER[data] | _SPACE[data]].tobytes())
        for part in word_blocks(pa.array(texts, pa.large_binary()), ALNUM):
            at, _ = self.insults.find(part.hashes())
            out[docs[part.lo : part.hi]] = np.bincount(part.owner()[at], minlength=part.hi - part.lo)
        return out


def _count_keys(rows: DataFrame, among: np.ndarray | None) -> DataFrame:
    """(key, positive, negative): texts of rows (text, label) that hold each word or stem, of all or of those in `among`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = HashSet(among) if among is not None else None
        for batch in batches:
            label = np.asarray(batch.column(1))
            for block in word_blocks(batch.column(0), ALNUM):
                found = []
                for key in word_keys(block):
                    at = chosen.find(key)[0] if chosen else np.arange(len(key))
                    found.append(np.stack([key[at].view(np.int64), block.owner()[at]], axis=1))
                pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
                keys, which = np.unique(pairs[:, 0], return_inverse=True)
                positive = np.bincount(which, weights=label[block.lo + pairs[:, 1]], minlength=len(keys)).astype(np.int64)
                both = np.bincount(which, minlength=len(keys))
                names = ["key", "positive", "negative"]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(positive), pa.array(both - positive)], names=names)

    counted = rows.select("text", "label").mapInArrow(lean(count), "key long, positive long, negative long")
    return counted.groupBy("key").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))


def learn_lexicon(rows: DataFrame, s: Settings) -> Lexicon:
    """Words and stems that are much likelier in texts with label 1, from rows (text, label)."""
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    p, q = totals.get(1, 0), totals.get(0, 0)
    if not p or not q:
        return Lexicon()
    often = _count_keys(rows.where("label = 1"), None).where(F.col("positive") >= s.min_support)
    often = often.orderBy(F.desc("positive"), "key").limit(20 * s.max_lexicon).toArrow()
    keys = often["key"].to_numpy().view(np.uint64)
    if not len(keys):
        return Lexicon()
    seen = _count_keys(rows, keys).toArrow()
    key, a, b = (seen[c].to_numpy() for c in ("key", "positive", "negative"))
    odds = np.log((a + 0.5) / (p - a + 0.5)) - np.log((b + 0.5) / (q - b + 0.5))
    error = np.sqrt(1 / (a + 0.5) + 1 / (p - a + 0.5) + 1 / (b + 0.5) + 1 / (q - b + 0.5))
    keep = (a >= s.min_support) & (odds >= s.min_log_odds) & (odds / error >= s.min_z)
    order = np.lexsort((key[keep], -odds[keep]))[: s.max_lexicon]
    return Lexicon(key[keep][order].view(np.uint64).copy(), odds[keep][order])


def measure(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """The `keep` columns of `docs`, which may hold the text too, and `features` of its texts."""
    kept = docs.select(*keep, F.col("text").alias("__measured"))
    schema = StructType([*kept.drop("__measured").schema, StructField("features", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Measure(lexicon)
        for batch in batches:
            values = features(batch.column(batch.num_columns - 1))
            offsets = np.arange(len(values) + 1, dtype=np.int32) * len(FEATURES)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=[*keep, "features"])

    return kept.mapInArrow(lean(run), schema)


@dataclass
class Model:
    """What `fit` learned; without trees each text gets `prior`, without calibration the trees' own probability."""

    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    prior: float


def fit(docs: DataFrame, labels: DataFrame, train: Column, settings: Settings | None = None) -> Model:
    """Learn from documents (doc_id, text) with a label (doc_id, toxic) that `train`, over doc_id, marks.

    At most about `max_rows` labelled rows are used, chosen by hash of their id; rows with null id or label are not.
    An id labelled twice counts as toxic if one label says so. Null and empty texts are texts without a word, long ones are measured
    whole, repeated documents count as often as they stand there. Empty tables give a model that scores all texts 0.
    Other columns of the tables are not read.
    """
    s = settings or Settings()
    known = labels.where(train & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label")).where("label in (0, 1)")
    n = known.count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    known = known.where(part < s.max_rows / max(n, s.max_rows))
    other = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(known), "doc_id")  # at most max_rows small rows
    rows = stage_table(rows.withColumn("later", other < s.calibration_share), "labelled")
    counts = {(r["later"], r["label"]): r["count"] for r in rows.groupBy("later", "label").count().collect()}
    all_rows = sum(counts.values())
    prior = sum(v for (_, label), v in counts.items() if label == 1) / all_rows if all_rows else 0.0
    lexicon = learn_lexicon(rows.where(~F.col("later")), s)
    if min(counts.get((False, 0), 0), counts.get((False, 1), 0)) < 2:
        return Model(lexicon, None, None, prior)
    measured = stage_table(measure(rows, lexicon, ["doc_id", "label", "later"]), "features")
    measured = measured.coalesce(2).withColumn("x", array_to_vector("features")).withColumn("label", F.col("label").cast("double"))
    trees = GBTClassifier(
        featuresCol="x", labelCol="label", maxIter=s.trees, maxDepth=s.depth, stepSize=s.step, minInstancesPerNode=2, seed=1
    ).fit(measured.where(~F.col("later")))
    calibration = None
    if counts.get((True, 1), 0) >= 5 and counts.get((True, 0), 0) >= 5:
        held = trees.transform(measured.where("later")).withColumn("p", vector_to_array("probability")[1])
        calibration = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="score").fit(held.select("p", "label"))
    return Model(lexicon, trees, calibration, prior)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The `keep` columns of `docs` and the `score` (0 to 1) of each whole text; null reads as empty.

    One row for each row, whatever repeats, none for an empty table; nothing is shuffled. Equal texts score alike, so ties
    stay ties. Names of `docs` may clash with any used here but `score`.
    """
    if model.trees is None:
        return docs.select(*keep, F.lit(model.prior).alias("score"))
    rows = measure(docs, model.lexicon, keep).withColumn("x", array_to_vector("features"))
    rows = model.trees.transform(rows).withColumn("p", vector_to_array("probability")[1])
    if model.calibration is None:
        return rows.select(*keep, F.col("p").alias("score"))
    return model.calibration.transform(rows).select(*keep, F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))
