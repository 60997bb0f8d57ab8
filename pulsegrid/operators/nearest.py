"""Joins by nearness: the nearest row of another table, and rows at no whole ratio to another table's.

Both are written without a nested loop and without a window or group over a whole key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.operators.series import null_safe_join
from pulsegrid.session import stage_table


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    pos: str,
    payload: Sequence[str],
    rows_per_slice: int = 1 << 20,
) -> DataFrame:
    """Rows of `left` with `near_pos` and `payload` of the row of `right` of the same keys that lies nearest in `pos`.

    On ties the smaller position counts, and of rows at one position the smallest payload. NULL keys are keys; without a partner,
    or without a position, the new columns are NULL. Both tables may be unbounded and one key may hold most of either: the union of both is
    range-partitioned by key and position into slices of about `rows_per_slice` rows and written once. Inside a
    slice the neighbours are the last partner before and the first behind a row; slices hand on their outermost partners,
    one row per key and slice.
    """
    point = F.struct(F.col(pos).alias("p"), F.struct(*payload).alias("v"))
    partners = right.where(F.col(pos).isNotNull()).groupBy(*keys, pos).agg(F.min(F.struct(*payload)).alias("_v"))
    partners = partners.select(*keys, F.col(pos).alias("_p"), F.lit(0).alias("_side"), F.struct(F.col(pos).alias("p"), F.col("_v").alias("v")).alias("_point"))
    kind = right.select(point.alias("_point")).schema["_point"].dataType
    rows = left.select(*keys, F.col(pos).alias("_p"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_point"), F.struct(*left.columns).alias("_row"))
    both = rows.unionByName(partners, allowMissingColumns=True)
    # Left rows at one position may be many; a hash of them splits their slices.
    order = ["_p", "_side", "_tie"]
    both = both.withColumn("_tie", F.xxhash64(F.to_json("_row")))
    slices = max(1, -(-both.count() // rows_per_slice))
    ranged = both.repartitionByRange(slices, *keys, *order) if slices > 1 else both.repartition(1)
    sliced = stage_table(ranged.withColumn("_slice", F.spark_partition_id()), "nearest")

    # Two passes forward: a frame that runs to the end of its partition is evaluated anew for each row.
    part = W.partitionBy(*keys, "_slice")
    below = F.last("_point", ignorenulls=True).over(part.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    behind = part.orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, 0)
    inside = sliced.withColumn("_below", below).withColumn("_above", F.last("_point", ignorenulls=True).over(behind))

    edges = sliced.groupBy(*keys, "_slice").agg(F.min("_point").alias("_least"), F.max("_point").alias("_most"))
    along = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    back = W.partitionBy(*keys).orderBy(F.desc("_slice")).rowsBetween(W.unboundedPreceding, -1)
    carried = edges.select(
        *keys,
        "_slice",
        F.last("_most", ignorenulls=True).over(along).alias("_earlier"),
        F.last("_least", ignorenulls=True).over(back).alias("_later"),
    )
    found = null_safe_join(inside.where("_side = 1"), carried, [*keys, "_slice"])
    found = found.select("_row", "_p", F.coalesce("_below", "_earlier").alias("_a"), F.coalesce("_above", "_later").alias("_b"))
    nearer = F.expr("case when _p is null then null when _a is null then _b when _b is null or _p - _a.p <= _b.p - _p then _a else _b end")
    return found.withColumn("_near", nearer).select("_row.*", F.col("_near.p").alias(f"near_{pos}"), *[F.col("_near.v")[c].alias(c) for c in payload])


def ratio_anti_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    value: str,
    first: int = 2,
    last: int = 6,
    tolerance: float = 0.1,
    salts: int = 1,
) -> DataFrame:
    """Rows of `left` whose `value` is not within `tolerance` of `first` to `last` times a value of `right` with the same keys.

    Values are cut into buckets of equal ratio, narrow enough that the range around a multiple touches two or three; a row of `right` is
    listed under the buckets of its multiples, so rows meet by an equi join and the exact test follows. Values that are not positive,
    and NULLs, meet nothing. Equal values of `right` count once. `salts` spreads a crowded bucket of `left` over as many tasks.
    """
    if not 0 < tolerance < first:
        raise ValueError("the tolerance must lie between 0 and the first ratio")
    width = math.log((first + tolerance) / (first - tolerance))
    bucket = f"cast(floor(ln({{}}) / {width!r}D) as bigint)"
    multiples = right.where(F.col(value) > 0).select(*keys, F.col(value).cast("double").alias("_e")).distinct()
    multiples = multiples.withColumn("_h", F.explode(F.sequence(F.lit(first), F.lit(last))))
    # A hair wider than the test, so that rounding loses no bucket.
    low, high = (bucket.format(f"(_h {sign} {tolerance!r}D) * _e * {hair}") for sign, hair in (("-", "0.999999D"), ("+", "1.000001D")))
    multiples = multiples.withColumn("_bucket", F.explode(F.expr(f"sequence({low}, {high})")))
    multiples = multiples.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    multiples = multiples.withColumnsRenamed({c: f"_right_{c}" for c in keys})
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int") if salts > 1 else F.lit(0)
    rows = left.withColumn("_c", F.expr(f"if({value} > 0, cast({value} as double), null)"))
    rows = rows.withColumn("_at", F.expr(bucket.format("_c"))).withColumn("_part", salt)
    meets = (F.col("_at") == F.col("_bucket")) & (F.col("_part") == F.col("_salt")) & (F.abs(F.col("_c") / F.col("_e") - F.col("_h")) < tolerance)
    for c in keys:
        meets = meets & F.col(c).eqNullSafe(F.col(f"_right_{c}"))
    return rows.join(multiples, meets, "left_anti").drop("_c", "_at", "_part")
