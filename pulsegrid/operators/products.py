"""Matrix products as joins: a long table of values with a table of weights, added up in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of weights of at most so many rows goes to every task.
SMALL = 1 << 18


def product(values: DataFrame, weights: DataFrame, rows: Sequence[str], index: str, out: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """(rows, out, sums): for each row of the left matrix and column of the right one the sums of expressions over both tables.

    `values` is long: (rows, index, ...); `weights` has the non-zero entries (index, out, ...) only, so a sparse matrix costs what
    it holds. Sums are added map-side, and since the entries of one row lie together, nearly all of them there. A large table of
    weights is joined by `index`.
    """
    small = weights.limit(SMALL + 1).count() <= SMALL
    joined = values.join(F.broadcast(weights) if small else weights, index)
    return joined.groupBy(*rows, *out).agg(*[F.sum(F.expr(e)).alias(name) for name, e in sums.items()])


def best_of(scores: DataFrame, rows: Sequence[str], column: str, score: str, digits: int = 9) -> DataFrame:
    """(rows, column, score): the column with the largest score of each row, the lowest number on ties after rounding."""
    ranked = scores.groupBy(*rows).agg(F.max(F.struct(F.round(score, digits).alias("s"), (-F.col(column)).alias("less"), F.col(score).alias("exact"))).alias("_best"))
    return ranked.select(*rows, (-F.col("_best.less")).alias(column), F.col("_best.exact").alias(score))


def fourier_basis(spark: SparkSession, size: int) -> DataFrame:
    """(i, bin, re, im): weights of the real Fourier transform of `size` values, with the periodic Hann taper."""
    angle = F.expr(f"2 * pi() * ((i * bin) % {size}) / {size}")
    taper = F.expr(f"0.5D - 0.5D * cos(2 * pi() * i / {size})")
    grid = spark.range(size * (size // 2 + 1)).select(
        F.expr(f"cast(id % {size} as int)").alias("i"), F.expr(f"cast(id div {size} as int)").alias("bin")
    )
    return grid.select("i", "bin", (taper * F.cos(angle)).alias("re"), (-taper * F.sin(angle)).alias("im"))


def tone_kernel(spark: SparkSession, size: int, rate: float, bins: int, lowest: float, per_octave: int = 12) -> DataFrame:
    """(i, bin, re, im): Hann-tapered tones of geometric pitch over the middle of a frame; a sparse constant-Q matrix.

    Tone `bin` is as long as its pitch asks for (Q = 1 / (2 ** (1 / per_octave) - 1) periods), at most the frame; entries outside it do not exist.
    """
    q = 1 / (2 ** (1 / per_octave) - 1)
    entries = (
        spark.range(bins)
        .select(F.col("id").cast("int").alias("bin"), F.expr(f"{lowest!r}D * pow(2D, id / {per_octave}D)").alias("hz"))
        .withColumn("n", F.expr(f"cast(least({size}, ceil({q!r}D * {float(rate)!r}D / hz)) as int)"))
        .withColumn("k", F.explode(F.expr("sequence(0, n - 1)")))
        .withColumn("i", F.expr(f"cast(({size} - n) div 2 + k as int)"))
    )
    taper = F.expr("(0.5D - 0.5D * cos(2 * pi() * (k + 0.5D) / n)) / sqrt(n)")
    angle = F.expr(f"2 * pi() * hz * k / {float(rate)!r}D")
    return entries.select("i", "bin", (taper * F.cos(angle)).alias("re"), (-taper * F.sin(angle)).alias("im"))


def magnitudes(frames: DataFrame, rows: Sequence[str], samples: str, kernel: DataFrame) -> DataFrame:
    """(rows, bin, mag): magnitudes of a complex matrix product of the frames in the array column `samples`."""
    long = frames.select(*rows, F.posexplode(samples).alias("i", "_x"))
    summed = product(long, kernel, rows, "i", ["bin"], {"_re": "_x * re", "_im": "_x * im"})
    return summed.select(*rows, "bin", F.expr("sqrt(_re * _re + _im * _im)").alias("mag"))

