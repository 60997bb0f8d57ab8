"""Fill-in-the-middle transformation with `pyarrow.compute`.

Texts are cut into units (runs of letters, or any other single code point) as list arrays. The lists are flattened with
their parent indices, each unit gets its ordinal in its text, units are filtered by role (before, between and behind two
cuts), rebuilt to one list a text and role, and joined. The cuts and the form are drawn from a hash of the document's id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.text import document_blocks, lean, utf8

#: A run of letters, or one other code point (as UTF-8 bytes; a stray byte is a unit of its own).
UNIT = r"([A-Za-z]+|[\x00-\x40\x5B-\x60\x7B-\x7F]|[\xC0-\xFF][\x80-\xBF]*|[\x80-\xBF])"
#: No byte of UTF-8.
_CUT = b"\xff"
_NOTHING = pa.scalar(b"", pa.large_binary())


@dataclass(frozen=True)
class Settings:
    """`rate` of 100 texts are transformed, `spm` of 100 of these with the suffix first; `seed` starts the hash."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    rate: int = 90
    spm: int = 20
    seed: int = 1
    block_bytes: int = 1 << 20

    def marks(self) -> list[str]:
        """The marks; each must start with a character found nowhere else in them, so that an output reads back in one way."""
        out = [self.prefix, self.suffix, self.middle]
        if len(set(out)) < 3 or not all(out) or any(m[0] in n[1:] for m in out for n in out):
            raise ValueError(f"unfit marks {out}")
        return out

    def pattern(self) -> str:
        return "|".join(re.escape(m) for m in self.marks())


def split_units(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Lists of the units of each text, each with one empty item behind them, and the numbers of units."""
    lists = pc.split_pattern(pc.replace_substring_regex(texts, UNIT, b"\\1" + _CUT), _CUT)
    return lists, pc.subtract(pc.list_value_length(lists).cast(pa.int64()), 1)


def _modulo(a: pa.Array, b: pa.Array | int) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _joined(units: pa.Array, counts: pa.Array) -> pa.Array:
    """One string a text: the next `counts` units after one another."""
    ends = pc.cumulative_sum(counts).cast(pa.int32())
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    return pc.binary_join(pa.ListArray.from_arrays(offsets, units), _NOTHING)


def pieces(lists: pa.Array, n: pa.Array, lo: pa.Array, hi: pa.Array) -> list[pa.Array]:
    """Prefix (units before `lo`), middle (before `hi`) and suffix of each text."""
    units, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    starts = pc.subtract(lists.offsets, lists.offsets[0])
    ordinal = pc.subtract(pa.array(np.arange(len(units))), pc.take(starts, parent).cast(pa.int64()))
    lo_of, hi_of, n_of = (pc.take(x, parent) for x in (lo, hi, n))
    roles = [
        pc.less(ordinal, lo_of),
        pc.and_(pc.greater_equal(ordinal, lo_of), pc.less(ordinal, hi_of)),
        pc.and_(pc.greater_equal(ordinal, hi_of), pc.less(ordinal, n_of)),
    ]
    counts = [lo, pc.subtract(hi, lo), pc.subtract(n, hi)]
    return [_joined(pc.filter(units, role), count) for role, count in zip(roles, counts, strict=True)]


def transform(texts: pa.Array, draws: list[pa.Array], s: Settings) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of each of `texts` (large_binary, no nulls)."""
    lists, n = split_units(texts)
    first, second = (_modulo(h, pc.add(n, 1)) for h in draws[:2])
    plain = pc.or_(pc.equal(n, 0), pc.greater_equal(_modulo(draws[2], 100), s.rate))
    plain = pc.or_(plain, pc.match_substring_regex(texts, s.pattern()))
    turned = pc.invert(plain)
    spm = pc.less(_modulo(draws[3], 100), s.spm)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    lo, hi = pc.min_element_wise(first, second), pc.max_element_wise(first, second)
    prefix, middle, suffix = pieces(*(pc.filter(x, turned) for x in (lists, n, lo, hi)))
    p, x, m = (pa.scalar(mark.encode(), pa.large_binary()) for mark in (s.prefix, s.suffix, s.middle))
    output = pc.if_else(
        pc.filter(spm, turned),
        pc.binary_join_element_wise(x, suffix, p, prefix, m, middle, _NOTHING),
        pc.binary_join_element_wise(p, prefix, x, suffix, m, middle, _NOTHING),
    )
    none = pa.nulls(len(texts), pa.int64())
    chars = [
        pc.replace_with_mask(none, turned, pc.utf8_length(piece.cast(pa.large_string(), safe=False)).cast(pa.int64())) for piece in (prefix, middle)
    ]
    return [n, form, *chars, pc.replace_with_mask(texts, turned, output)]


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"
_TYPES = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())]


def fill_in_middle(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row of `docs` (doc_id, text), in one narrow pass.

    Null texts read as empty, and empty texts stay plain with n = 0; a null doc_id draws as empty text. Rows that are alike
    give rows that are alike, an empty table none. Other columns are not read, so their names may clash. Texts are taken in
    blocks of `block_bytes`, or one longer text, and are never cut: memory is some 40 bytes a unit of a block.
    """
    s = settings or Settings()
    s.marks()
    drawn = F.sha2(F.concat(F.lit(f"{s.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(drawn, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(_TYPES)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            _, offsets = utf8(texts)
            for lo, hi in document_blocks(offsets, s.block_bytes):
                rows = batch.slice(lo, hi - lo)
                found = transform(texts.slice(lo, hi - lo), rows.columns[2:], s)
                columns = [rows.column(0), *found[:-1], found[-1].cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), "text", *draws).mapInArrow(lean(run), SCHEMA)
    return rows.withColumn("output", F.col("output").cast("string"))


def restored(settings: Settings | None = None, output: str = "output", form: str = "form") -> Column:
    """The exact text, rebuilt from output and form."""
    s = settings or Settings()
    part = F.split(F.col(output), s.pattern(), 4)
    psm = F.concat(F.get(part, 1), F.get(part, 3), F.get(part, 2))
    spm = F.concat(F.get(part, 2), F.get(part, 3), F.get(part, 1))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))
