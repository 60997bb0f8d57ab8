"""Routing of events on streams: an interval join of onsets with the rows of the gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def route_events(
    onsets: DataFrame, gates: DataFrame, keys: Sequence[str], frame: str, ts: str, gate: str = "gate", delay: str = "10 minutes", apart: str = "1 minute"
) -> DataFrame:
    """Onsets (keys, frame, ts, ...) with the `path` (chord or note) that the gate's row of the same frame decides.

    Both are streams with a time column `ts`; rows more than `delay` behind the latest time of their own stream are late and may be dropped.
    The times of an onset and of its gate row lie at most `apart` from each other, so that state is kept for `delay` and
    `apart` only. An onset whose gate row is missing gives no row. On ordered input this equals the batch join.
    """
    left = onsets.withWatermark(ts, delay)
    right = gates.select(*[F.col(c).alias(f"_gate_{c}") for c in (*keys, frame, ts, gate)]).withWatermark(f"_gate_{ts}", delay)
    same = F.col(frame) == F.col(f"_gate_{frame}")
    for c in keys:
        same = same & (F.col(c) == F.col(f"_gate_{c}"))
    near = F.expr(f"`_gate_{ts}` between `{ts}` - interval {apart} and `{ts}` + interval {apart}")
    path = F.when(F.col(f"_gate_{gate}"), "chord").otherwise("note").alias("path")
    return left.join(right, same & near).select(*onsets.columns, path)
