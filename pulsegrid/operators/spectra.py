"""Spectral features. Frame-local ones are array expressions (SQL text)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.operators.series import attach_totals, over_segments


def rise(now: str, earlier: str) -> str:
    """Sum of squared increases between two spectra; 0 when there is no earlier one."""
    return (
        f"coalesce({A.total(f'zip_with({now}, {earlier}, (u, v) -> pow(greatest(0D, u - v), 2D))')}, 0D)"
    )


def spectral_flux(
    df: DataFrame, keys: Sequence[str], pos: str, mag: str, name: str = "flux", length: int = 1024
) -> DataFrame:
    """Add the flux of each frame against the frame before it."""

    def compute(rows, w):
        return rows.withColumn("_earlier", F.lag(mag).over(w))

    return (
        over_segments(df, keys, pos, 1, 0, compute, length)
        .withColumn(name, F.expr(rise(mag, "_earlier")))
        .drop("_earlier")
    )


def normalize_by_max(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, name: str
) -> DataFrame:
    """Divide by the key's maximum; unchanged where that is not positive."""
    return (
        attach_totals(df, keys, pos, [F.max(value).alias("_max")])
        .withColumn(name, F.when(F.col("_max") > 0, F.col(value) / F.col("_max")).otherwise(F.col(value)))
        .drop("_max")
    )


def mean_center(df: DataFrame, keys: Sequence[str], pos: str, value: str, name: str) -> DataFrame:
    """Subtract the key's mean."""
    return (
        attach_totals(df, keys, pos, [F.avg(value).alias("_mean")])
        .withColumn(name, F.col(value) - F.col("_mean"))
        .drop("_mean")
    )


def peak_bins(mag: str, fraction: float, first: str = "1", stop: str | None = None) -> str:
    """Bins in [first, stop) that are strict maxima above `fraction` of the frame's maximum."""
    stop = stop or f"size({mag}) - 1"
    inner = (
        f"filter(sequence({first}, {stop} - 1), k -> {mag}[k] > {mag}[k - 1] "
        f"and {mag}[k] > {mag}[k + 1] and {mag}[k] > floor_)"
    )
    return A.bind(f"{fraction}D * array_max({mag})", "floor_", inner)


def parabola_offset(left: str, mid: str, right: str) -> str:
    """Offset of the vertex through three equidistant points; 0 on a line."""
    return (
        f"if({left} - 2 * {mid} + {right} = 0D, 0D, "
        f"-(({right} - {left}) / 2) / ({left} - 2 * {mid} + {right}))"
    )


def refined_peaks(mag: str, bin_hz: float, fraction: float = 0.01, limit: int = 50) -> str:
    """The first `limit` peaks in bin order as structs (freq, mag, bin), loudest first."""
    point = (
        f"named_struct('freq', (k + {parabola_offset(f'{mag}[k - 1]', f'{mag}[k]', f'{mag}[k + 1]')})"
        f" * {bin_hz}D, 'mag', {mag}[k], 'bin', k)"
    )
    order = (
        "(p, q) -> case when p.mag > q.mag then -1 when p.mag < q.mag then 1 "
        "else sign(p.bin - q.bin) end"
    )
    bins = f"slice({peak_bins(mag, fraction)}, 1, {limit})"
    return f"array_sort(transform({bins}, k -> {point}), (p, q) -> cast(({order.split('-> ', 1)[1]}) as int))"


def entropy(mag: str) -> str:
    return A.bind(
        f"{A.total(mag)} + 1e-9D",
        "s",
        f"aggregate({mag}, 0D, (acc, v) -> acc - v / s * ln(v / s + 1e-9D))",
    )


def flatness(mag: str) -> str:
    n = f"size({mag})"
    logs = f"aggregate({mag}, 0D, (acc, v) -> acc + ln(v + 1e-9D))"
    plain = f"aggregate({mag}, 0D, (acc, v) -> acc + (v + 1e-9D))"
    return f"exp({logs} / {n}) / ({plain} / {n})"
