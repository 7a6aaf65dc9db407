"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceframe.runtime import written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as those given, fewer than there are nodes: (node, smallest node)."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes in ``links`` (a, b) but the roots; the root is the component's smallest node.

    Each round writes its links to the shared folder, ends when a round changes nothing, and needs about
    log(nodes) rounds. A hub's links are only joined and aggregated, never gathered. Starts jobs.
    """
    down = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    state = written(links.where("a != b").select(*down).distinct(), "links")
    mark = _mark(state)
    while mark[0]:
        both = state.unionByName(state.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        # large star: hang every larger neighbour on the least of a node and its neighbours
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m"))
        large = state.select(F.col("lo").alias("at"), "hi").join(least.select(F.col("hi").alias("at"), "m"), "at").select("hi", F.col("m").alias("lo"))
        large = large.where("hi != lo").distinct()
        # small star: hang a node and its smaller neighbours on the least of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least, "hi")
        small = joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(least.select("hi", F.col("m").alias("lo")))
        new = written(small.where("hi != lo").distinct(), "links")
        before, mark = mark, _mark(new)
        state = new
        if mark == before:
            break
    return state.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _mark(links: DataFrame) -> tuple:
    """Number of links and a checksum that does not depend on their order."""
    row = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return (row[0], row[1])
