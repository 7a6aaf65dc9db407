"""Sharding over a hierarchical weighted hash tree, in DataFrame functions only."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceframe.llm.batches import checkpointed


@dataclass(frozen=True)
class Leaf:
    """A shard: its region, its rack within the region, its number and its weight above 0."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


class HashTree:
    """Regions over racks over shards; a key descends by one weighted draw per child.

    A child's draw is ``-ln(u) / weight`` with ``u`` from the hash of the key and the child's name;
    the least draw wins. Draws of a child depend on nothing but the key, the name and the weight, so
    a change of one weight moves keys only into or out of the subtrees whose weights change.
    """

    def __init__(self, leaves: list[Leaf]) -> None:
        if not leaves or len({x.shard for x in leaves}) != len(leaves):
            raise ValueError("a tree needs leaves with different shard numbers")
        if any(not x.weight > 0 for x in leaves):
            raise ValueError("weights are above 0")
        self.leaves = list(leaves)

    @classmethod
    def regular(cls, regions: int, racks: int, shards: int) -> HashTree:
        """Equal weights, ``regions * racks * shards`` leaves."""
        places = [(a, b, c) for a in range(regions) for b in range(racks) for c in range(shards)]
        return cls([Leaf(a, b, n) for n, (a, b, _) in enumerate(places)])

    def grown(self, weight: float = 1.0) -> HashTree:
        """One more shard, as the only leaf of a new region: it takes keys into itself and moves no others."""
        region = 1 + max(x.region for x in self.leaves)
        shard = 1 + max(x.shard for x in self.leaves)
        return HashTree([*self.leaves, Leaf(region, 0, shard, weight)])

    def children(self) -> dict[str, list[tuple[str, float]]]:
        """Names and weights of each inner node's children; the weight of a node is the sum below it."""
        weights: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        for x in self.leaves:
            region, rack = f"r{x.region}", f"r{x.region}/{x.rack}"
            weights[""][region] += x.weight
            weights[region][rack] += x.weight
            weights[rack][f"{rack}/{x.shard}"] += x.weight
        return {node: sorted(below.items()) for node, below in weights.items()}

    def shard(self, key: Column) -> Column:
        """The shard number of a key; NULL is a key like any other."""
        child = [F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight")) for n, w in below]) for below in self.children().values()]
        tree = F.create_map(*[x for node, below in zip(self.children(), child, strict=True) for x in (F.lit(node), below)])

        def least(node: Column) -> Column:
            draws = F.transform(
                F.element_at(tree, node),
                lambda c: F.struct(
                    (-F.log((F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\0")), c["name"]), 11) + 1) / F.lit(float(1 << 53))) / c["weight"]).alias("draw"),
                    c["name"].alias("name"),
                ),
            )
            return F.array_min(draws)["name"]

        leaf = least(least(least(F.lit(""))))
        return F.element_at(F.split(leaf, "/"), 3).cast("int")


def sharded(df: DataFrame, tree: HashTree, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place every row: key, ``size`` (UTF-8 bytes of the text and 1), ``text_crc32``, ``shard``, ``grown_shard``, ``slot``.

    ``grown_shard`` is the shard after :meth:`HashTree.grown`. ``slot`` counts a shard's rows from 0
    without gaps: a window numbers the rows of one input split within a shard, and running totals
    over the splits' counts shift them, so no task holds a whole shard. The narrow rows are
    checkpointed once, for the two readers to see the same splits.

    NULL key: one key like any other. NULL text: no bytes, checksum 0. Repeated rows each get a
    slot of the same shard. An empty table gives no rows. Other columns are ignored. Starts a job.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    narrow = checkpointed(df.select(
        F.col(key).alias(key),
        (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(whole).alias("text_crc32"),
        tree.shard(F.col(key)).alias("shard"),
        tree.grown().shard(F.col(key)).alias("grown_shard"),
        F.spark_partition_id().alias("_split"),
        F.monotonically_increasing_id().alias("_row"),
    ))
    counts = narrow.groupBy("shard", "_split").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard", "_split").orderBy("_row")
    placed = narrow.withColumn("_at", F.row_number().over(within) - 1).join(starts, ["shard", "_split"])
    return placed.select(key, "size", "text_crc32", "shard", (F.col("_before") + F.col("_at")).alias("slot"), "grown_shard")
