"""Thresholds that are kept up day by day: statistics that merge, and an exact median from the bins that hold it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.series import middle_bins, middle_values, null_safe_join, value_counts

OCTAVE = 64


class DailyStatistics:
    """Statistics of the values of keyed features, one part a day, in a shared folder.

    Each day leaves counts by bin (64 an octave, whatever the values), a count, mean and sum of squared deviations, and its counted
    values in order of octaves. Days merge by addition. The bins that hold the middle ranks follow from the counts alone; only then
    the values filed under those bins' octaves are read, of all days, so the median is exact and no day's rows are read twice.
    A day that is added again replaces itself.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    def add(self, rows: DataFrame, features: Sequence[str], day: str = "day") -> None:
        """File the values of `features` in `rows` (keys, features, `day`) under their days; NULLs do not count.

        Only these rows are read. Days that they hold replace what was filed under them; other days stay as they are.
        """
        pairs = ", ".join(f"'{f}', cast(`{f}` as double)" for f in features)
        long = rows.select(F.col(day).cast("string").alias("day"), *self.keys, F.expr(f"stack({len(features)}, {pairs}) as (feature, value)"))
        on = ["day", *self.keys, "feature"]
        counted = value_counts(long, on, "value", OCTAVE)
        values = counted.withColumn("octave", F.expr(f"cast(floor(_bin / {OCTAVE}D) as int)"))
        # In order of octaves, so that a reader passes over the row groups of others.
        self._write("values", values.repartition("day", "octave").sortWithinPartitions("day", "octave", "_bin"))
        self._write("bins", counted.groupBy(*on, "_bin").agg(F.sum("_n").alias("_m")).repartition("day"))
        moments = long.groupBy(*on).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("m2"))
        self._write("moments", moments.repartition("day"))

    def _write(self, kind: str, df: DataFrame) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.path}/{kind}")

    def _all(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{kind}").drop("day")

    def medians(self) -> DataFrame:
        """(keys, feature, median) over all days."""
        on = [*self.keys, "feature"]
        bins = self._all("bins").groupBy(*on, "_bin").agg(F.sum("_m").alias("_m"))
        holding = middle_bins(bins, on).withColumn("octave", F.expr(f"cast(floor(_bin / {OCTAVE}D) as int)"))
        # Octaves without a middle rank are passed over by the scan; equal values of several days are one.
        octaves = [r[0] for r in holding.select("octave").distinct().limit(4096).collect()]
        values = self._all("values").where(F.col("octave").isin(octaves)) if len(octaves) < 4096 else self._all("values")
        values = null_safe_join(values.drop("octave"), holding.select(*on, "_bin"), [*on, "_bin"], "left_semi")
        values = values.groupBy(*on, "value", "_bin").agg(F.sum("_n").alias("_n"))
        return middle_values(values, holding.drop("octave"), on, "value")

    def moments(self) -> DataFrame:
        """(keys, feature, n, mean, deviation) over all days; the deviation is that of the whole population."""
        on = [*self.keys, "feature"]
        mean = F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n"))
        whole = self._all("moments").groupBy(*on).agg(
            F.sum("n").alias("n"), mean.alias("mean"), F.sum("m2").alias("_m2"), F.collect_list(F.when(F.col("n") > 0, F.struct("n", "mean"))).alias("_days")
        )
        between = F.expr("aggregate(_days, 0D, (acc, d) -> acc + d.n * (d.mean - mean) * (d.mean - mean))")
        deviation = F.sqrt(F.try_divide(F.col("_m2") + between, F.col("n")))
        return whole.select(*on, "n", "mean", deviation.alias("deviation"))

    def thresholds(self, k: dict[str, float]) -> DataFrame:
        """(keys, feature, threshold): median + k deviations of each feature; NULL without a value."""
        on = [*self.keys, "feature"]
        factor = F.expr("case " + " ".join(f"when feature = '{f}' then {v!r}D" for f, v in k.items()) + " end")
        both = null_safe_join(self.moments(), self.medians(), on, "left")
        return both.select(*on, (F.col("median") + factor * F.col("deviation")).alias("threshold"))
