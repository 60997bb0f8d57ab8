"""Chat formatting by columnar byte assembly.

A turn becomes `<|im_start|>role<|im_sep|>text<|im_end|>` and a newline. Control strings inside roles and texts are
broken by a backslash after their first character and backslashes are doubled, so the output can be read back exactly.
The bytes of all turns of a batch are scattered into one buffer by numpy.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.text import code_points, lean, utf8


@dataclass(frozen=True)
class Template:
    """Marks of turns; `controls` are further strings that may not occur in texts."""

    open: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    close: str = "<|im_end|>\n"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<|endoftext|>")
    loss_role: str = "assistant"

    def strings(self) -> list[str]:
        """What texts must not hold. No string may hold a backslash or start inside another."""
        out = [self.open, self.sep, self.close.rstrip("\n"), *self.controls]
        for s in out:
            if not s or "\\" in s:
                raise ValueError(f"unfit control string {s!r}")
        return sorted(set(out), key=lambda s: (-len(s), s))

    def escape(self, texts: pa.Array) -> pa.Array:
        """Escaped texts: a backslash is doubled, and one is put after each first character of a control string."""
        texts = pc.replace_substring(texts, "\\", "\\\\")
        for s in self.strings():
            while True:  # a string such as << can overlap itself
                hit = pc.any(pc.match_substring(texts, s)).as_py()
                if not hit:
                    break
                texts = pc.replace_substring(texts, s, f"{s[0]}\\{s[1:]}")
        return texts


_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def assemble(segments: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Concatenate, row by row, one segment of each column given as (bytes, offsets).

    Returns the buffer, the offsets of rows in it, and for each column where its segment of each row starts.
    """
    lengths = np.stack([np.diff(offsets) for _, offsets in segments], axis=1)
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if len(ends) else 0, dtype=np.uint8)
    for k, (data, offsets) in enumerate(segments):
        shift = np.repeat(starts[:, k] - offsets[:-1], lengths[:, k])
        out[np.arange(len(data)) + shift] = data
    rows = np.concatenate([[0], ends[:, -1]]) if len(ends) else np.zeros(1, np.int64)
    return out, rows, [starts[:, k] for k in range(len(segments))]


def _constant(mark: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(mark.encode(), dtype=np.uint8)
    return np.tile(data, n), np.arange(n + 1) * len(data)


def format_turns(role: pa.Array, text: pa.Array, template: Template) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted bytes of all turns, the offsets of turns, and the byte span under the loss mask of each (empty: none)."""
    n = len(text)
    loss = np.asarray(pc.fill_null(pc.equal(role, template.loss_role), False)).astype(bool)
    roles = utf8(template.escape(pc.fill_null(role, "")))
    texts = utf8(template.escape(pc.fill_null(text, "")))
    data, rows, starts = assemble(
        [_constant(template.open, n), roles, _constant(template.sep, n), texts, _constant(template.close, n)]
    )
    return data, rows, starts[3], starts[3] + np.diff(texts[1]) * loss


SCHEMA = "conv_id long, part_partition int, part_no long, n_turns long, formatted string, loss_spans array<struct<start:int,end:int>>"


def format_chats(turns: DataFrame, template: Template | None = None, part_bytes: int = 4 << 20) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as training text, in parts that follow by (part_partition, part_no).

    Rows are ordered by turn, then role, then text, nulls first; repeated rows are repeated turns. Null roles and texts
    read as empty. Rows are range-partitioned by conversation *and* turn, so one conversation with a third of all rows
    spreads over many tasks; a part is at most `part_bytes` of turns, or one longer turn. `loss_spans` are the code
    points of `formatted` under the loss mask. A null conv_id is a conversation of its own. Rows that tie in all of this are alike.
    An empty table gives no part; other columns are not read.
    """
    template = template or Template()
    template.strings()
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select(F.col("conv_id").cast("long"), "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0)
            data, rows, lo, hi = format_turns(batch.column(1), batch.column(2), template)
            known = np.asarray(conv.is_valid())
            ids = np.asarray(conv.fill_null(0))
            chars = code_points(data)
            fresh = np.flatnonzero((ids[1:] != ids[:-1]) | (known[1:] != known[:-1])) + 1
            out = []
            for a, b in zip(np.r_[0, fresh], np.r_[fresh, len(ids)], strict=True):
                while a < b:
                    z = min(b, max(a + 1, int(np.searchsorted(rows, rows[a] + part_bytes, side="right")) - 1))
                    under = [
                        {"start": int(chars[lo[i]] - chars[rows[a]]), "end": int(chars[hi[i]] - chars[rows[a]])}
                        for i in range(a, z)
                        if hi[i] > lo[i]
                    ]
                    out.append((int(ids[a]) if known[a] else None, task, number, int(z - a), data[rows[a] : rows[z]].tobytes().decode(), under))
                    number += 1
                    a = z
            columns = list(zip(*out, strict=True))
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), span)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["conv_id", "part_partition", "part_no", "n_turns", "formatted", "loss_spans"],
            )

    return rows.mapInArrow(lean(parts), SCHEMA)


def read_turns(formatted: str, template: Template) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from formatted text."""
    out = []
    for turn in formatted.split(template.close)[:-1]:
        role, _, text = turn.removeprefix(template.open).partition(template.sep)
        out.append((unescape(role), unescape(text)))
    return out


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(parts: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation, read back from its formatted parts.

    Parts stream through the task of their conversation in order; only running digests are held, so memory does not
    grow with a conversation (a digest is sequential by definition).
    """
    template = template or Template()
    rows = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part_partition", "part_no")
    rows = rows.select("conv_id", "formatted", "loss_spans")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, out = None, None, []

        def close():
            out.append((current[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush():
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for conv, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current != (conv,):
                    if current is not None:
                        close()
                    current, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text, template):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in spans:
                    learned = unescape(text[span["start"] : span["end"]])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(text)
            yield flush()
        if current is not None:
            close()
        yield flush()

    return rows.mapInArrow(lean(read), DIGEST)


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns plus conversation -1, whose two texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = turns.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text")
    )
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)
