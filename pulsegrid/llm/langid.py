"""Language identification by compression.

Each language has a raw-content zstandard dictionary of text excerpts. A text, reduced to its lower-cased letters with
single spaces between words, is cut into pieces that are compressed with every dictionary; the language whose
dictionary gives the fewest bytes in total wins, unless the runner-up is too near.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.text import lean

UNDETERMINED = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class LanguageModel:
    """Dictionary bytes of each language."""

    dictionaries: dict[str, bytes]
    level: int = 5
    piece_bytes: int = 1024
    #: Texts whose runner-up needs less than this share more bytes are rejected.
    min_margin: float = 0.01
    #: Bytes of margin by which odds grow e-fold.
    scale: float = 4.0

    def compressors(self) -> dict[str, zstandard.ZstdCompressor]:
        out = {}
        for lang, data in sorted(self.dictionaries.items()):
            held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=self.level)
            out[lang] = zstandard.ZstdCompressor(
                level=self.level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False
            )
        return out


def letters_only(text: str) -> str:
    return _NOT_LETTERS.sub(" ", text).strip().lower()


def fit(
    docs: DataFrame,
    train: Column,
    excerpts: int = 48,
    excerpt_chars: int = 1024,
    sample: int = 4800,
    **options,
) -> LanguageModel:
    """Learn dictionaries from the rows of `docs` (doc_id, text, lang) that `train` marks and that have text and lang.

    The sample is bounded: `excerpts` per language, but no more than `sample` in all as long as there is one for each
    language, each of `excerpt_chars` from a place in the text that its hash chooses. Rows are picked as the smallest hash in
    each of as many slots, so a language is sampled evenly whatever its share of rows, and repeated ids count once.
    """
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.where(train & F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", h.alias("h"), "text")
    # One row for each value of lang: the slots follow from their number.
    languages = rows.select("lang").distinct().count()
    if not languages:
        return LanguageModel({}, **options)
    slots = max(1, min(excerpts, sample // languages))
    chosen = rows.groupBy("lang", F.pmod("h", F.lit(slots)).alias("slot")).agg(F.min("h").alias("h")).collect()
    room = F.greatest(F.length("text") - excerpt_chars + 1, F.lit(1))
    excerpt = F.substring("text", (F.pmod("h", room) + 1).cast("int"), F.lit(excerpt_chars))
    texts = (
        rows.where(F.col("h").isin([r["h"] for r in chosen]))
        .groupBy("lang", "h")
        .agg(F.min(excerpt).alias("excerpt"))
        .orderBy("lang", "h")
        .collect()
    )
    parts: dict[str, list[str]] = {}
    for r in texts:
        parts.setdefault(r["lang"], []).append(letters_only(r["excerpt"]))
    return LanguageModel({lang: " ".join(x).encode() for lang, x in parts.items()}, **options)


SCHEMA = "doc_id long, held_out boolean, lang string, lang_best string, score double, margin double, rejected boolean"


def _score(model: LanguageModel, compressors: dict, text: str | None) -> tuple[str, str, float, float, bool]:
    plain = letters_only(text).encode() if text else b""
    if not plain or not compressors:
        return UNDETERMINED, UNDETERMINED, 0.0, 0.0, True
    step = model.piece_bytes
    pieces = [plain[i : i + step] for i in range(0, len(plain), step)]
    sizes = {lang: sum(len(c.compress(p)) for p in pieces) for lang, c in compressors.items()}
    best, *rest = sorted(sizes, key=lambda x: (sizes[x], x))
    score = 1 / (1 + sum(math.exp((sizes[best] - sizes[x]) / model.scale) for x in rest))
    margin = (sizes[rest[0]] - sizes[best]) / sizes[best] if rest else 1.0
    narrow = margin < model.min_margin
    return (UNDETERMINED if narrow else best), best, score, margin, narrow


def identify(docs: DataFrame, model: LanguageModel, held_out: Column | None = None) -> DataFrame:
    """Language of each whole text of `docs` (doc_id, text); one row for each row, none is shuffled.

    `lang` is `und` for rejected texts, `lang_best` only for null texts and texts without a letter, whose score is 0.
    Ties go to the language that sorts first and are rejected. Without a learned language all is `und`. Repeated rows are
    judged each, an empty table gives no rows; a long text is judged whole, piece by piece. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), (F.lit(False) if held_out is None else held_out).alias("held_out"), "text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in batches:
            found = [_score(model, compressors, text.as_py()) for text in batch.column(2)]
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            types = (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                names=["doc_id", "held_out", "lang", "lang_best", "score", "margin", "rejected"],
            )

    return rows.mapInArrow(lean(predict), SCHEMA)
