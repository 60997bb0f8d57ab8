"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.session import stage_table


def _slot(column: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(column), 64 - bits)


def in_table(df: DataFrame, column: str, ids: DataFrame, bits: int = 24, how: str = "left_semi") -> DataFrame:
    """Rows of `df` whose `column` may be (`left_semi`) or surely is not (`left_anti`) among the ids of the one-column `ids`.

    The ids are kept as a table of 2 ** `bits` flags, 64 to a row: at most 2 ** (bits - 6) rows are broadcast, however many
    ids there are. It saves shuffling wide rows that a join with the ids would drop; the exact join still has to follow.
    """
    slot = _slot(ids.columns[0], bits)
    flags = ids.select(F.shiftright(slot, 6).alias("__word"), F.pmod(slot, F.lit(64)).cast("int").alias("__bit"))
    flags = flags.groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__flags"))
    slot = _slot(column, bits)
    bit = F.call_function("shiftrightunsigned", F.col("__flags"), F.pmod(slot, F.lit(64)).cast("int"))
    return df.join(F.broadcast(flags), (F.shiftright(slot, 6) == F.col("__word")) & (bit.bitwiseAND(F.lit(1)) == 1), how)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours of each node with the smallest of them: the larger neighbours, or the smaller ones and the node.

    The smallest neighbours are written first, so that a small table of them is broadcast and edges are not dealt by node; a
    large one is joined as it lies, so that adaptive execution can split the edges of a crowded node.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    back = both.select(F.col("v").alias("u"), F.col("u").alias("v"))
    near = both.union(back) if large else both.union(back).where("v < u")
    least = stage_table(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    linked = near.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = out.where("a != b")
    return out if large else out.distinct()  # repeated edges do not change what the small step makes of the large one's


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of each node of `edges` (a, b: BIGINT); the component is its smallest node.

    Each round is written to the shared stage folder, so lost executors recompute one round at most. Ends when the edges
    are stars: then every node but the smallest of a component is linked with that one alone.
    """
    current = stage_table(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    for _ in range(max_rounds):
        current = stage_table(_star(_star(current, large=True), large=False), "edges")
        ends = current.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.union(current.select("b", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not ends.where("up > 1 or (up = 1 and down = 1)").agg(F.count("*")).first()[0]:
            break
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
