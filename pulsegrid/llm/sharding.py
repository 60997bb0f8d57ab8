"""Sharding by a hierarchical weighted hash tree, with SQL functions only.

A row descends from the regions to a rack to a shard. At each level every child draws -ln(u) / weight, where u in
(0, 1) is a hash of the row's key and the child's name, and the smallest draw wins, so a child gets its weight's share.
A draw depends on the child's own name and weight alone: changing weights below a node moves rows only into or out of
the subtrees whose weights changed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.session import stage_table


@dataclass(frozen=True)
class Leaf:
    """A shard, its place in the tree and its weight."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(n_shards: int, base: int = 40, racks: int = 4, shards: int = 5) -> list[Leaf]:
    """Shards 0 to n_shards - 1: the first `base` in regions of `racks` racks of `shards` shards.

    Each later shard is a region of its own, so that it takes rows from all others and nothing else moves.
    """
    tree = []
    for s in range(n_shards):
        rack = s // shards
        place = (f"r{rack // racks}", f"k{rack}") if s < base else (f"x{s}", f"x{s}")
        tree.append(Leaf(*place, s))
    return tree


def reweighted(tree: list[Leaf], weights: dict[int, float]) -> list[Leaf]:
    """The tree with other weights for some shards; a weight of 0 empties a shard."""
    return [replace(leaf, weight=weights.get(leaf.shard, leaf.weight)) for leaf in tree]


def _children(tree: list[Leaf]) -> list[dict]:
    """For each level, {parent: [(child, hashed name, weight)]}; the parent of regions is 0, nodes are numbered by name."""
    tree = [leaf for leaf in tree if leaf.weight > 0]
    if not tree:
        raise ValueError("no shard has a weight above 0")
    regions = {r: i for i, r in enumerate(sorted({x.region for x in tree}))}
    racks = {k: i for i, k in enumerate(sorted({(x.region, x.rack) for x in tree}))}
    total = lambda keep: float(sum(x.weight for x in tree if keep(x)))
    return [
        {0: [(i, f"region {r}", total(lambda x, r=r: x.region == r)) for r, i in regions.items()]},
        {
            regions[r]: [(i, f"rack {q}/{k}", total(lambda x, p=(q, k): (x.region, x.rack) == p)) for (q, k), i in racks.items() if q == r]
            for r in regions
        },
        {i: [(x.shard, f"shard {x.shard}", float(x.weight)) for x in tree if (x.region, x.rack) == p] for p, i in racks.items()},
    ]


def _descend(key: Column, level: dict, parent: Column) -> Column:
    nodes = F.array(
        *[
            F.array(*[F.struct(F.lit(c).alias("child"), F.lit(name).alias("name"), F.lit(w).alias("weight")) for c, name, w in level[p]])
            for p in sorted(level)
        ]
    )
    children = F.element_at(nodes, parent + 1)

    def draw(c: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(F.concat_ws("|", key, c["name"])), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.log(u) / c["weight"]).alias("draw"), c["child"].alias("child"))

    return F.array_min(F.transform(children, draw))["child"]


def with_shard(df: DataFrame, key: str, tree: list[Leaf], out: str = "shard") -> DataFrame:
    """Add the shard of each row as INT column `out`; a null key is a key of its own."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("\0null"))
    parent = F.lit(0)
    for depth, level in enumerate(_children(tree)):
        step = out if depth == 2 else f"__{out}{depth}"
        df = df.withColumn(step, _descend(name, level, parent))
        parent = F.col(step)
    return df.drop(f"__{out}0", f"__{out}1")


def with_slot(df: DataFrame, shard: str = "shard", out: str = "slot") -> DataFrame:
    """Stage `df` and number its rows from 0 without gaps in each shard, in the order of the staged files.

    Rows are ranked inside (shard, staged file), so no group is larger than a task's output, whatever keys repeat;
    only one count for each shard and file meets in a window by shard.
    """
    staged = stage_table(df, "shards").select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    sizes = staged.groupBy(shard, "__file").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(shard).orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(shard, "__file", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(shard, "__file").orderBy("__row")
    ranked = staged.withColumn("__rank", F.row_number().over(inside) - 1)
    return ranked.join(before, [shard, "__file"]).withColumn(out, F.col("__before") + F.col("__rank")).drop("__file", "__row", "__rank", "__before")


def shard_documents(docs: DataFrame, n_shards: int = 40, tree: list[Leaf] | None = None, grown: list[Leaf] | None = None) -> DataFrame:
    """Every row of `docs` (doc_id, text) with its shard and its place there.

    `size` is the UTF-8 length of the text plus 16; a null text counts as empty in `size` and `text_crc32`. Repeated rows
    and rows without doc_id are kept, equal ids share a shard. `grown_shard` is the shard under `grown`, by default one
    shard more. Other columns of `docs` are not read. An empty table gives an empty result.
    """
    tree = tree or topology(n_shards)
    grown = grown or topology(n_shards + 1)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = with_shard(rows, "doc_id", tree, "shard")
    rows = with_shard(rows, "doc_id", grown, "grown_shard")
    return with_slot(rows)
