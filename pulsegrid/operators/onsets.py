"""Adaptive-threshold event picking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.constants import HOP_SIZE, ONSET_K, ONSET_WINDOW, SAMPLE_RATE
from pulsegrid.operators.series import SEGMENT, over_segments


def find_onsets(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    window: int = ONSET_WINDOW,
    k: float = ONSET_K,
    length: int = SEGMENT,
) -> DataFrame:
    """Rows that are strict local maxima above mean + k * deviation of the trailing window.

    The trailing window holds up to `window` values including the current one and
    never position 0; the last position is not reported. The rule does not change
    under a positive scaling, so no pass for the maximum is needed before it.
    """

    def compute(rows, w):
        trail = w.rowsBetween(1 - window, 0)
        counted = F.when(F.col(pos) >= 1, F.col(value))
        return rows.withColumns(
            {
                "_before": F.lag(value).over(w),
                "_after": F.lead(value).over(w),
                "threshold": F.avg(counted).over(trail) + k * F.stddev_pop(counted).over(trail),
            }
        )

    return (
        over_segments(df, keys, pos, window, 1, compute, length)
        .where(
            (F.col(pos) >= 1)
            & (F.col(value) > F.col("_before"))
            & (F.col(value) > F.col("_after"))
            & (F.col(value) > F.col("threshold"))
        )
        .drop("_before", "_after")
    )


def frame_seconds(pos: str, hop: int = HOP_SIZE, rate: int = SAMPLE_RATE):
    """Time of a frame index in seconds."""
    return F.col(pos) * F.lit(float(hop)) / F.lit(float(rate))
