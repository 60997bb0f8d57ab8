"""Frames, tapers and filters over keyed series."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.constants import FRAME_SIZE, HIGHPASS_ALPHA, HOP_SIZE
from pulsegrid.functions import arrays as A
from pulsegrid.operators.series import attach_totals, over_segments, segment_arrays, with_halo

SEGMENT_HOPS = 128


def highpass(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    name: str = "y",
    alpha: float = HIGHPASS_ALPHA,
) -> DataFrame:
    """One-pole high-pass `y[n] = x[n] - x[n-1] + alpha * y[n-1]`, `y[0] = x[0]`.

    Unrolled: `y[n] = x[n] - (1 - alpha) * sum_{k>=1} alpha^(k-1) * x[n-k]`. The sum is a running one inside a
    segment, with values scaled by `alpha^-position`. The halo reaches as far back as weights are
    above 1e-12, and segments are short enough for the scale to stay finite, whatever `alpha` in (0, 1) is.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    decay = -math.log(alpha)
    reach = max(1, math.ceil(math.log(1e12) / decay))
    length = max(reach, min(4096, int(600 / decay) - reach))

    def compute(rows, w):
        local = F.expr(f"{pos} - _seg * {length} + {reach}")
        scaled = F.col(value) * F.pow(F.lit(alpha), -(local + 1))
        history = F.sum(scaled).over(w.rowsBetween(W.unboundedPreceding, -1))
        weighted = F.coalesce(history, F.lit(0.0)) * F.pow(F.lit(alpha), local)
        return rows.withColumn(name, F.col(value) - F.lit(1 - alpha) * weighted)

    return over_segments(df, keys, pos, reach, 0, compute, length)


def sliding_frames(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    size: int = FRAME_SIZE,
    hop: int = HOP_SIZE,
    segment_hops: int = SEGMENT_HOPS,
) -> DataFrame:
    """Overlapping frames `(keys, frame, f)`; an incomplete tail is dropped.

    One shuffle by (key, segment); every group has at most
    `segment_hops * hop + size - hop` values.
    """
    after = max(0, size - hop)
    span = segment_hops * hop
    if after > span:
        raise ValueError("a segment must hold a whole frame")
    packed = segment_arrays(df, keys, pos, value, span, after)
    return frames_of_segments(packed, keys, size, hop, segment_hops)


def frames_of_segments(
    packed: DataFrame, keys: Sequence[str], size: int, hop: int, segment_hops: int
) -> DataFrame:
    """Cut packed segments `(keys, seg, samples)` into frames; narrow."""
    starts = f"sequence(0, least({segment_hops - 1}, (size(samples) - {size}) div {hop}))"
    return (
        packed.where(f"size(samples) >= {size}")
        .select(*keys, "seg", "samples", F.explode(F.expr(starts)).alias("_i"))
        .select(
            *keys,
            F.expr(f"seg * {segment_hops} + _i").alias("frame"),
            F.expr(f"slice(samples, cast(_i * {hop} + 1 as int), {size})").alias("f"),
        )
    )


def frame_pairs(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    size: int = FRAME_SIZE,
    hop: int = HOP_SIZE,
    segment_hops: int = SEGMENT_HOPS,
) -> DataFrame:
    """Frames as `sliding_frames` gives them, each with the one before it: `(keys, frame, f, earlier)`.

    A segment holds one hop more at its front, so what compares a frame with its predecessor needs no shuffle of
    frames or spectra.
    """
    span, after = segment_hops * hop, max(0, size - hop)
    if max(hop, after) > span:
        raise ValueError("a segment must hold a whole frame")
    packed = F.array_sort(F.collect_list(F.struct(pos, value)))
    segments = with_halo(df, pos, hop, after, span).groupBy(*keys, F.col("_seg").alias("seg")).agg(packed.alias("_rows"))
    lead = f"if(seg > 0, {hop}, 0)"
    last = f"least({segment_hops - 1}, (size(samples) - {size} - {lead}) div {hop})"
    return (
        segments.select(*keys, "seg", F.col(f"_rows.{value}").alias("samples"))
        .where(f"size(samples) - {lead} >= {size}")
        .select(*keys, "seg", "samples", F.explode(F.expr(f"sequence(0, {last})")).alias("_i"))
        .withColumn("_at", F.expr(f"cast(_i * {hop} + {lead} + 1 as int)"))
        .select(
            *keys,
            F.expr(f"seg * {segment_hops} + _i").alias("frame"),
            F.expr(f"slice(samples, _at, {size})").alias("f"),
            F.expr(f"if(_at > {hop}, slice(samples, _at - {hop}, {size}), null)").alias("earlier"),
        )
    )


def tapered(f: str, size: int, periodic: bool = True) -> str:
    """Frame times Hann window."""
    return A.multiply(f, A.hann(size, periodic))


def whole_blocks(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, size: int, segment_blocks: int = SEGMENT_HOPS
) -> DataFrame:
    """Consecutive blocks `(keys, frame, f)` of `size` values; the last one of a key may be shorter."""
    packed = segment_arrays(df, keys, pos, value, segment_blocks * size)
    starts = f"sequence(0, (size(samples) - 1) div {size})"
    return packed.select(*keys, "seg", "samples", F.explode(F.expr(starts)).alias("_i")).select(
        *keys,
        F.expr(f"seg * {segment_blocks} + _i").alias("frame"),
        F.expr(f"slice(samples, cast(_i * {size} + 1 as int), {size})").alias("f"),
    )


def resample_linear(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, up: int, down: int, name: str = "y"
) -> DataFrame:
    """Whole series at `up / down` of their rate: `(keys, j, name)`, linear between neighbours, the last value held.

    A series of n values gets `n * up div down` values, the j-th at position `j * down / up`. Each row yields the
    points from itself up to its neighbour, so apart from the key's length only one neighbour is looked at.
    """

    def compute(rows, w):
        return rows.withColumn("_next", F.coalesce(F.lead(value).over(w), F.col(value)))

    rows = attach_totals(over_segments(df, keys, pos, 0, 1, compute), keys, pos, [F.max(pos).alias("_end")], source=df)
    first = f"({pos} * {up} + {down - 1}) div {down}"
    last = f"least((({pos} + 1) * {up} + {down - 1}) div {down}, (_end + 1) * {up} div {down}) - 1"
    points = F.expr(f"if({first} <= {last}, sequence({first}, {last}), cast(array() as array<bigint>))")
    share = f"((j * {down} - {pos} * {up}) / cast({up} as double))"
    return rows.withColumn("j", F.explode(points)).select(
        *keys, "j", F.expr(f"{value} + (_next - {value}) * {share}").alias(name)
    )
