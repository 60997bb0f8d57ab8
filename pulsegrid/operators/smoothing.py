"""Most likely state path per key under "stay or move" transitions.

All moves cost the same, so one step needs only the best state so far. A key is not
decoded in one task: each segment becomes a matrix "best score from entry state to
exit state" in (max, +) arithmetic, neighbouring matrices are combined level by level,
and once the states at the borders are known every segment is decoded on its own.
Scores are whole numbers, so cutting a key anywhere gives the same path.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.series import null_safe_join

SEGMENT_FRAMES = 4096
SEGMENTS_PER_BLOCK = 256
SCALE = 1_000_000
IMPOSSIBLE = -(1 << 60)


def whole_scores(probs: str, states: int) -> str:
    """ln(p + 1e-8) in millionths, times a power of two, less the state number.

    The state number decides between paths of equal likelihood.
    """
    unit = _unit(states)
    return f"transform({probs}, (p, i) -> cast(round(ln(p + 1e-8D) * {SCALE}) as bigint) * {unit} - i)"


def _unit(states: int) -> int:
    return 1 << (states - 1).bit_length()


def transition_scores(states: int, stay: float) -> tuple[int, int]:
    unit = _unit(states)
    moved = (1 - stay) / (states - 1)
    return round(float(np.log(stay)) * SCALE) * unit, round(float(np.log(moved)) * SCALE) * unit


def _walk(scores: np.ndarray, start: np.ndarray, first: bool, stay: int, move: int) -> np.ndarray:
    """Advance rows of path scores over the frames; rows are independent entry states."""
    best = start
    for i, emission in enumerate(scores):
        if first and i == 0:
            best = np.broadcast_to(emission, best.shape).copy()
        else:
            best = np.maximum(best + stay, best.max(axis=1, keepdims=True) + move) + emission
    return best


def _chain(matrices: np.ndarray, entry: int | None, exit_: int | None) -> list[int]:
    """Best exit state of each matrix in a row of matrices, given the outer states if known."""
    ahead = [matrices[0][0 if entry is None else entry]]
    for m in matrices[1:]:
        ahead.append((ahead[-1][:, None] + m).max(axis=0))
    states = [int(np.argmax(ahead[-1])) if exit_ is None else exit_]
    for before, m in zip(ahead[-2::-1], matrices[:0:-1]):
        states.append(int(np.argmax(before + m[:, states[-1]])))
    return states[::-1]


def _decode(scores: np.ndarray, entry: int | None, exit_: int, stay: int, move: int) -> np.ndarray:
    n = scores.shape[1]
    kept = np.empty(scores.shape, dtype=np.int32)
    own = np.arange(n)
    best = None
    if entry is not None:
        best = np.full(n, IMPOSSIBLE, dtype=np.int64)
        best[entry] = 0
    for i, emission in enumerate(scores):
        if best is None:
            kept[i], best = own, emission
            continue
        top = int(np.argmax(best))
        stays = best + stay >= best[top] + move
        kept[i] = np.where(stays, own, top)
        best = np.where(stays, best + stay, best[top] + move) + emission
    path = np.empty(len(scores), dtype=np.int64)
    state = exit_
    for i in range(len(scores) - 1, -1, -1):
        path[i] = state
        state = kept[i][state]
    return path


def smooth_states(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    probs: str,
    states: int,
    stay: float = 0.9,
    frames: int = SEGMENT_FRAMES,
    per_block: int = SEGMENTS_PER_BLOCK,
    levels: int | None = None,
    weights: np.ndarray | None = None,
    top: int = 2048,
) -> DataFrame:
    """`(keys, pos, state)`: the most likely state of every row; `probs` has `states` entries.

    With `weights` (n, states), `probs` is a vector of n entries whose products with the columns of `weights`, to whole
    billionths, are the probabilities. They are taken inside the groups, so that only the vectors are shuffled.

    `levels` of combining leave one matrix per `frames * per_block ** levels` positions of a
    key for the last step, which takes a key's matrices in one task. Unless given, there are as many levels as leave
    at most `top` matrices of the longest key, whose last position is looked up first.
    """
    keys = list(keys)
    if levels is None:
        left, levels = -(-((df.agg(F.max(pos)).first()[0] or 0) + 1) // (frames * per_block)), 1
        while left > top:
            left, levels = -(-left // per_block), levels + 1
    stay_score, move_score = transition_scores(states, stay)
    rows = df.select(
        *keys,
        F.col(pos).cast("bigint").alias(pos),
        (F.expr(whole_scores(probs, states)) if weights is None else F.col(probs)).alias("_e"),
        F.expr(f"{pos} div {frames}").alias("_seg"),
    )
    key_type = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def scores_of(column: pd.Series) -> np.ndarray:
        values = np.stack(column.to_numpy())
        if weights is None:
            return values.astype(np.int64)
        likely = np.floor(values @ weights * 1e9 + 0.5) / 1e9
        return np.rint(np.log(likely + 1e-8) * SCALE).astype(np.int64) * _unit(states) - np.arange(states)

    def identity() -> np.ndarray:
        eye = np.full((states, states), IMPOSSIBLE, dtype=np.int64)
        np.fill_diagonal(eye, 0)
        return eye

    def segment_matrix(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        scores = scores_of(pdf["_e"])
        seg = int(pdf["_seg"].iloc[0])
        # A key's first segment has no entry state: one row says it all.
        m = _walk(scores, identity()[:1] if seg == 0 else identity(), seg == 0, stay_score, move_score)
        return pdf[[*keys, "_seg"]].head(1).assign(_m=[m.ravel()])

    def block_matrix(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_seg")
        total = None
        for flat in pdf["_m"]:
            m = np.asarray(flat, dtype=np.int64).reshape(-1, states)
            total = m if total is None else np.stack([(r[:, None] + m).max(axis=0) for r in total])
        return pdf[[*keys, "_block"]].head(1).assign(_m=[total.ravel()])

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        """States on both sides of each matrix, from the states around all of them if known."""
        pdf = pdf.sort_values("_seg")
        outer = [None, None]
        if "_bin" in pdf:
            outer = [None if pd.isna(pdf[c].iloc[0]) else int(pdf[c].iloc[0]) for c in ("_bin", "_bout")]
        found = _chain([np.asarray(f).reshape(-1, states) for f in pdf["_m"]], *outer)
        return pdf[[*keys, "_seg"]].assign(
            _in=pd.array([outer[0], *found[:-1]], dtype="Int64"), _out=np.array(found, dtype=np.int64)
        )

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        first = pdf["_in"].iloc[0]
        path = _decode(
            scores_of(pdf["_e"]),
            None if pd.isna(first) else int(first),
            int(pdf["_out"].iloc[0]),
            stay_score,
            move_score,
        )
        return pdf[[*keys, pos]].assign(state=path)

    matrix_type = f"{key_type}, _seg bigint, _m array<bigint>"
    border_type = f"{key_type}, _seg bigint, _in bigint, _out bigint"
    ladder = [rows.groupBy(*keys, "_seg").applyInPandas(segment_matrix, matrix_type)]
    for _ in range(levels):
        ladder[-1] = ladder[-1].withColumn("_block", F.expr(f"_seg div {per_block}"))
        ladder.append(
            ladder[-1]
            .groupBy(*keys, "_block")
            .applyInPandas(block_matrix, matrix_type.replace("_seg", "_block"))
            .withColumnRenamed("_block", "_seg")
        )
    borders = ladder.pop().groupBy(*keys).applyInPandas(exits, border_type)
    for matrices in reversed(ladder):
        around = borders.withColumnsRenamed({"_seg": "_block", "_in": "_bin", "_out": "_bout"})
        borders = (
            null_safe_join(matrices, around, [*keys, "_block"])
            .groupBy(*keys, "_block")
            .applyInPandas(exits, border_type)
        )
    return (
        null_safe_join(rows, borders, [*keys, "_seg"])
        .groupBy(*keys, "_seg")
        .applyInPandas(decode, f"{key_type}, {pos} bigint, state bigint")
    )
