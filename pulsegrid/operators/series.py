"""Positions, halo segments and per-key totals for keyed series.

A key may hold a large share of all rows, so nothing here opens a window or a
group over a whole key. Rows are cut into segments of bounded length by their
position; rows near a border are copied to the neighbour segment (the halo), so
a window with a bounded frame sees all the rows it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from pulsegrid.session import stage_table

SEGMENT = 4096
JOIN_SPAN = 1 << 20


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; the key columns of `left` are kept."""
    named = {c: f"_right_{c}" for c in on}
    right = right.withColumnsRenamed(named)
    same = [left[c].eqNullSafe(right[named[c]]) for c in on]
    return left.join(right, reduce(and_, same), how).drop(*named.values())


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "t",
    rows_per_slice: int = 1 << 20,
) -> DataFrame:
    """Add the 0-based position of each row in its key's order; NULL keys are keys, NULLs come first.

    A table of at most `rows_per_slice` rows is ranked by one window. A larger one is range-partitioned by key and
    order into slices of about that many rows, however keys and order values crowd, and staged once so that
    all uses see the same slices. Rows are ranked inside (key, slice) and the sizes of the key's
    earlier slices are added; only the sizes, one row per key and slice, are windowed by key.
    """
    slices = -(-df.count() // rows_per_slice)
    if slices <= 1:
        whole = W.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(whole) - 1).cast("bigint"))
    ranged = df.repartitionByRange(slices, *keys, *order).withColumn("_slice", F.spark_partition_id())
    sliced = stage_table(ranged, "slices")
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_slice", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*keys, "_slice").orderBy(*order)
    ranked = sliced.withColumn("_rank", F.row_number().over(inside) - 1)
    return (
        null_safe_join(ranked, offsets, [*keys, "_slice"])
        .withColumn(name, (F.col("_rank") + F.col("_offset")).cast("bigint"))
        .drop("_slice", "_rank", "_offset")
    )


def total_length(df: DataFrame, length: str) -> int:
    return int(df.agg(F.sum(F.expr(length))).first()[0] or 0)


def lay_end_to_end(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    length: str,
    ranges: Sequence[str | Column],
    name: str = "at",
    slice_length: int = 1 << 25,
    total: int | None = None,
) -> DataFrame:
    """Add where each row begins if the rows of its key, each `length` long, are laid end to end; NULL keys are keys.

    As `number_rows`: slices of about `slice_length` in all are cut by `ranges`, which must run with the keys and the order but
    may be coarser, so that large values are neither sampled nor compared. Rows that `ranges` does not tell apart share a slice.
    `total` is the length of all rows if it is known.
    """
    slices = -(-(total_length(df, length) if total is None else total) // slice_length)

    def before(size: str, order: Sequence[str], *keys: str) -> Column:
        earlier = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum(F.expr(size)).over(earlier), F.lit(0)).cast("bigint")

    if slices <= 1:
        return df.withColumn(name, before(length, order, *keys))
    sliced = stage_table(df.repartitionByRange(slices, *ranges).withColumn("_slice", F.spark_partition_id()), "slices")
    sizes = sliced.groupBy(*keys, "_slice").agg(F.sum(F.expr(length)).alias("_size"))
    # A struct of keys is never NULL and equal where they are: the window's partitions serve the join, and rows move once.
    key = F.struct(*keys).alias("_key")
    offsets = sizes.select(key, "_slice", before("_size", ["_slice"], *keys).alias("_offset"))
    placed = sliced.select("*", key).withColumn("_before", before(length, order, "_key", "_slice"))
    return (
        placed.join(offsets, ["_key", "_slice"])
        .withColumn(name, F.col("_before") + F.col("_offset"))
        .drop("_key", "_slice", "_before", "_offset")
    )


def with_halo(df: DataFrame, pos: str, before: int, after: int, length: int = SEGMENT) -> DataFrame:
    """Add `_seg`, copying rows needed by the neighbours; own rows have `pos div length = _seg`."""
    if max(before, after) > length:
        raise ValueError("halo longer than a segment")
    homes = [f"{pos} div {length}"]
    if before:
        homes.append(f"if({pos} % {length} >= {length - before}, {pos} div {length} + 1, null)")
    if after:
        homes.append(
            f"if({pos} % {length} < {after} and {pos} >= {length}, {pos} div {length} - 1, null)"
        )
    if len(homes) == 1:
        return df.withColumn("_seg", F.expr(homes[0]))
    return df.withColumn("_seg", F.explode(F.expr(f"array_compact(array({', '.join(homes)}))")))


def over_segments(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    before: int,
    after: int,
    compute: Callable[[DataFrame, WindowSpec], DataFrame],
    length: int = SEGMENT,
) -> DataFrame:
    """Run window columns that look `before`/`after` rows around, segment by segment."""
    halo = with_halo(df, pos, before, after, length)
    window = W.partitionBy(*keys, "_seg").orderBy(pos)
    return compute(halo, window).where(F.expr(f"{pos} div {length} = _seg")).drop("_seg")


def keep_where(df: DataFrame, condition: str) -> DataFrame:
    """Filter on derived columns, evaluated in place.

    A plain filter moves below the projections and repeats the expressions behind its
    columns at every mention. Use it for costly ones; plain filters elsewhere.
    """
    kept = F.expr(f"if({condition}, array(true), cast(array() as array<boolean>))")
    return df.withColumn("_kept", F.explode(kept)).drop("_kept")


def attach_totals(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    totals: Sequence[Column],
    span: int = JOIN_SPAN,
    source: DataFrame | None = None,
) -> DataFrame:
    """Join per-key aggregates back to every row.

    Totals combine map-side. They are then repeated once per `span` positions of
    the key, so the join back is on (key, span) and a large key is spread.
    `source` may hold the rows to aggregate when they differ from `df`.
    """
    summed = (source if source is not None else df).groupBy(*keys).agg(
        *totals, F.max(pos).alias("_last")
    )
    return join_by_span(df, summed, keys, pos, "_last", span).drop("_last")


def join_by_span(
    df: DataFrame, per_key: DataFrame, keys: Sequence[str], pos: str, last: str, span: int = JOIN_SPAN
) -> DataFrame:
    """Inner join of rows with a one-row-per-key table, spread over spans of positions; NULL keys match."""
    spread = per_key.withColumn(
        "_span", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"{last} div {span}")))
    )
    return null_safe_join(df.withColumn("_span", F.expr(f"{pos} div {span}")), spread, [*keys, "_span"]).drop("_span")


def segment_arrays(
    df: DataFrame, keys: Sequence[str], pos: str, value: str, length: int, after: int = 0
) -> DataFrame:
    """One row per (key, segment): the values of the segment and `after` following ones, in order."""
    packed = F.array_sort(F.collect_list(F.struct(pos, value)))
    return (
        with_halo(df, pos, 0, after, length)
        .groupBy(*keys, F.col("_seg").alias("seg"))
        .agg(packed.alias("_rows"))
        .select(*keys, "seg", F.col(f"_rows.{value}").alias("samples"))
    )


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "median", bins_per_octave: int = 64
) -> DataFrame:
    """Exact median per key by counting, without gathering a key's values; NULLs do not count.

    Equal values are counted together first. Bins are fractions of an octave, so values that crowd near zero
    part as well as large ones do. Counts per bin find the bins that hold the middle
    ranks, and only the values of those bins are ordered. A key without a value has median NULL.
    """
    values = value_counts(df, keys, value, bins_per_octave)
    holding = middle_bins(values.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_m")), keys)
    found = middle_values(values, holding, keys, value, name)
    without = df.groupBy(*keys).agg(F.count(value).alias("_n")).where("_n = 0")
    return found.unionByName(without.select(*keys, F.lit(None).cast("double").alias(name)))


def value_counts(df: DataFrame, keys: Sequence[str], value: str, bins_per_octave: int = 64) -> DataFrame:
    """(keys, value, _n, _bin): equal values counted together, and the bin of each; bins are in order of the values."""
    octave = f"cast(floor(log2(abs({value})) * {bins_per_octave}) as bigint) + {1100 * bins_per_octave}"
    part = F.expr(f"case when {value} > 0 then {octave} when {value} < 0 then -({octave}) else 0 end")
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.withColumn("_bin", part)


def middle_bins(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _bin, _below, _total) of the bins that hold the middle ranks, from (keys, _bin, _m)."""
    running = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
    return (
        bins.withColumn("_upto", F.sum("_m").over(running))
        .withColumn("_total", F.sum("_m").over(W.partitionBy(*keys)))
        .withColumn("_below", F.col("_upto") - F.col("_m"))
        .where("_below <= _total div 2 and _upto > (_total - 1) div 2")
        .select(*keys, "_bin", "_below", "_total")
    )


def middle_values(values: DataFrame, holding: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """(keys, name): mean of the values at the middle ranks; only values of the bins in `holding` are ordered."""
    inside = W.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    ranked = (
        null_safe_join(values, holding, [*keys, "_bin"])
        .withColumn("_hi", F.col("_below") + F.sum("_n").over(inside))
        .withColumn("_lo", F.col("_hi") - F.col("_n"))
    )

    def at(rank: str) -> Column:
        return F.max(F.expr(f"if(_lo <= {rank} and {rank} < _hi, {value}, null)"))

    return ranked.groupBy(*keys).agg(((at("(_total - 1) div 2") + at("_total div 2")) / 2).alias(name))
