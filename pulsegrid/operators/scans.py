"""Work over whole keyed series of any length: recursive filters, lag sums, rational resampling.

Rows are cut into segments by position. What a segment hands on is small and associative, and it is combined in levels of
`FAN` segments, so no window, group or array holds a whole key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.constants import HIGHPASS_ALPHA
from pulsegrid.functions.kernels import kernel_udf
from pulsegrid.functions.polyphase import LOBES, Polyphase
from pulsegrid.operators.series import null_safe_join, segment_arrays, with_halo

FAN = 64


def carried(pairs: DataFrame, keys: Sequence[str], seg: str, segments: int, fan: int = FAN) -> DataFrame:
    """(keys, seg, carry): the value that runs into each segment of (keys, seg, a, b), where a segment makes `a * carry + b` of it.

    Affine maps combine associatively: the maps of `fan` segments are one map of the level above, whose carries
    come back down. `segments` is the largest number of segments of a key; every array holds at most `fan` maps.
    """
    step = "named_struct('a', acc.a * p.a, 'b', acc.b * p.a + p.b, 'out', concat(acc.out, array(named_struct('seg', p.seg, 'a', acc.a, 'b', acc.b))))"
    none = "cast(array() as array<struct<seg:bigint,a:double,b:double>>)"
    packed = (
        pairs.groupBy(*keys, F.expr(f"{seg} div {fan}").alias("_super"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col(seg).cast("bigint").alias("seg"), "a", "b"))).alias("_maps"))
        .withColumn("_all", F.expr(f"aggregate(_maps, named_struct('a', 1D, 'b', 0D, 'out', {none}), (acc, p) -> {step})"))
        .drop("_maps")
    )
    if segments > fan:
        above = packed.select(*keys, F.col("_super").alias("seg"), F.col("_all.a").alias("a"), F.col("_all.b").alias("b"))
        above = carried(above, keys, "seg", -(-segments // fan), fan).withColumnsRenamed({"seg": "_super", "carry": "_from"})
        packed = null_safe_join(packed, above, [*keys, "_super"])
    else:
        packed = packed.withColumn("_from", F.lit(0.0))
    rows = packed.select(*keys, "_from", F.explode("_all.out").alias("_m"))
    return rows.select(*keys, F.col("_m.seg").alias(seg), F.expr("_m.a * _from + _m.b").alias("carry"))


def highpass_scan(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, name: str = "y", alpha: float = HIGHPASS_ALPHA, length: int = 4096, fan: int = FAN
) -> DataFrame:
    """One-pole high-pass `y[n] = x[n] - x[n-1] + alpha * y[n-1]`, `y[0] = x[0]`, of rows at the positions 0, 1, ... of each key.

    With `h[n+1] = alpha * h[n] + x[n]`, `y[n] = x[n] - (1 - alpha) * h[n]`. Each row maps h to `alpha * h + x`; maps are
    composed inside a segment and over segments, so nothing is cut off however near to 1 `alpha` is, and no rows are copied.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    # Running sums are scaled by alpha ** -position inside a segment, which must stay finite.
    length = max(1, min(length, int(600 / -math.log(alpha))))
    rows = df.withColumn("_seg", F.expr(f"{pos} div {length}")).withColumn("_at", F.expr(f"cast({pos} % {length} as double)"))
    w = W.partitionBy(*keys, "_seg").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    scaled = F.sum(F.col(value) * F.pow(F.lit(alpha), -(F.col("_at") + 1))).over(w)
    rows = rows.withColumn("_sum", scaled)
    ends = rows.groupBy(*keys, "_seg").agg(F.max_by("_sum", "_at").alias("_sum"), F.max("_at").alias("_last"))
    decay = F.pow(F.lit(alpha), F.col("_last") + 1)
    pairs = ends.select(*keys, F.col("_seg").alias("seg"), decay.alias("a"), (F.col("_sum") * decay).alias("b"))
    most = (df.agg(F.max(pos)).first()[0] or 0) // length + 1
    into = carried(pairs, keys, "seg", most, fan).withColumnRenamed("seg", "_seg")
    joined = null_safe_join(rows, into, [*keys, "_seg"])
    # The running sum holds the row itself, which h[n] does not.
    before = (F.col("_sum") - F.col(value) * F.pow(F.lit(alpha), -(F.col("_at") + 1)) + F.col("carry")) * F.pow(F.lit(alpha), F.col("_at"))
    return joined.withColumn(name, F.col(value) - F.lit(1 - alpha) * before).drop("_seg", "_at", "_sum", "carry")


def lag_products(own: np.ndarray, whole: np.ndarray, lags: int) -> np.ndarray:
    """`sum_t own[t] * whole[t + lag]` for the lags 0 to `lags`; values behind the end of `whole` count as zero."""
    size = 1 << int(len(own) + len(whole) + lags).bit_length()
    return np.fft.irfft(np.conj(np.fft.rfft(own, size)) * np.fft.rfft(whole, size), size)[: lags + 1]


def block_lag_sums(lags: int, length: int):
    """Products, then squared differences, of the first `length` values of an array with those up to `lags` behind them."""

    @kernel_udf
    def sums(samples: pa.Array) -> pa.Array:
        out = np.empty((len(samples), 2 * (lags + 1)))
        for k, row in enumerate(samples):
            whole = row.values.to_numpy(zero_copy_only=False).astype(np.float64)
            own = whole[:length]
            both = lag_products(own, whole, lags)
            energy = np.concatenate([[0.0], np.cumsum(whole * whole)])
            lag = np.arange(lags + 1)
            paired = np.clip(len(whole) - lag, 0, len(own))  # own values that have a partner
            ahead = energy[paired + np.minimum(lag, len(whole))] - energy[np.minimum(lag, len(whole))]
            both[paired == 0] = 0.0
            out[k, : lags + 1] = both
            out[k, lags + 1 :] = np.where(lag == 0, 0.0, np.maximum(energy[paired] + ahead - 2 * both, 0.0))
        ends = np.arange(len(out) + 1, dtype=np.int32) * np.int32(2 * (lags + 1))
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

    return sums


def lag_sums(df: DataFrame, keys: Sequence[str], pos: str, value: str, lags: int, length: int = 4096) -> DataFrame:
    """(keys, lag, products, differences): `sum_t x[t] * x[t + lag]` and `sum_t (x[t] - x[t + lag]) ** 2` over whole series.

    Each segment of `length` values holds the `lags` values behind it too and yields its share of all sums by one Fourier transform;
    shares are added by key and lag, map-side first. A key of any length is as many segments, and only sums are shuffled by key.
    """
    if lags > length:
        raise ValueError("lags longer than a segment")
    segments = segment_arrays(df, keys, pos, value, length, lags)
    shares = segments.select(*keys, block_lag_sums(lags, length)("samples").alias("_sums"))
    long = shares.select(*keys, F.posexplode("_sums").alias("_i", "_v"))
    lag = F.expr(f"_i % {lags + 1}").alias("lag")
    return long.groupBy(*keys, lag).agg(
        F.sum(F.expr(f"if(_i <= {lags}, _v, 0D)")).alias("products"), F.sum(F.expr(f"if(_i > {lags}, _v, 0D)")).alias("differences")
    )


def resample_polyphase(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, up: int, down: int, lobes: int = LOBES, name: str = "y", length: int = 4096
) -> DataFrame:
    """Whole series at `up / down` of their rate: (keys, j, name), each value a short filter over the rows around it.

    A series of n values gets `n * up div down`, the j-th at position `j * down / up`; beyond the ends it counts as zero. Segments hold the
    filter's reach on both sides, so one long series is as many tasks as it has segments.
    """
    bank = Polyphase(down, up, lobes)
    length = max(length, bank.reach)

    @kernel_udf
    def outputs(samples: pa.Array, begin: pa.Array, seg: pa.Array) -> pa.Array:
        out = []
        for row, first_input, s in zip(samples, begin.to_pylist(), seg.to_pylist(), strict=True):
            x = row.values.to_numpy(zero_copy_only=False).astype(np.float64)
            stop_input = min((s + 1) * length, first_input + len(x))
            first = -(-s * length * up // down)
            stop = -(-stop_input * up // down)
            if first_input + len(x) < (s + 1) * length + bank.reach:  # the series ends here
                stop = min(stop, (first_input + len(x)) * up // down)
            out.append(bank.outputs(x, first_input, first, max(first, stop)))
        ends = np.concatenate([[0], np.cumsum([len(y) for y in out])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out) if out else np.empty(0)))

    packed = F.array_sort(F.collect_list(F.struct(pos, value)))
    segments = (
        with_halo(df, pos, bank.reach, bank.reach, length)
        .groupBy(*keys, F.col("_seg").alias("seg"))
        .agg(packed.alias("_rows"))
        .where(F.expr(f"exists(_rows, r -> r.{pos} div {length} = seg)"))
    )
    made = segments.select(*keys, "seg", outputs(F.col("_rows")[value], F.col("_rows")[0][pos], "seg").alias("_y"))
    first = F.expr(f"cast((seg * {length} * {up} + {down - 1}) div {down} as bigint)")
    return made.select(*keys, first.alias("_first"), F.posexplode("_y").alias("_i", name)).select(*keys, F.expr("_first + _i").alias("j"), name)
