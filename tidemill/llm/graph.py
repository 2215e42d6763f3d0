"""Connected components of links between many small nodes, by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidemill.llm.common import materialize, remove


class Forest:
    """Union-find over 0..n-1 in which the smallest index is the root; links come as arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while True:
            a, b = root[i], root[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (up := root[root] != root).any():
                root[up] = root[root[up]]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """One link (root, member) for each member but the roots."""
        member = np.flatnonzero(self.root != np.arange(len(self.root)))
        return self.root[member], member


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())


#: A node with at least this share of the links is a hub; so at most 1 / HUB_SHARE nodes are, twice that over both ends.
HUB_SHARE = 1e-3


def _joined(links: DataFrame, least: DataFrame, key: str, total: int) -> DataFrame:
    """links with the least neighbour of their node in key. Rows of hubs stay where they are and get it by broadcast of the
    2 / HUB_SHARE hubs at most; those of other nodes meet it by a shuffle, in which no key has many rows."""
    least = materialize(least, "least")
    hub = F.col("n") >= max(16.0, HUB_SHARE * total)
    hubs = least.where(hub).select(key, F.col("least").alias("of_hub"))
    tagged = links.join(F.broadcast(hubs), key, "left")
    rest = tagged.where("of_hub IS NULL").drop("of_hub").join(least.where(~hub).drop("n"), key)
    return tagged.where("of_hub IS NOT NULL").withColumnRenamed("of_hub", "least").unionByName(rest.select(*tagged.drop("of_hub").columns, "least"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (low, high), root the smallest node reachable from it.

    Large-star and small-star steps (Kiveris et al., 2014) move links to ever smaller nodes until each component is a star;
    some ten rounds for any shape. Each round is two aggregations and two joins of as many rows as there are nodes and
    links, written to the shared folder. A hub's minimum is pre-aggregated, and its rows are not moved to one task.
    Nodes may be of any ordered type, structs included. No links: no rows.
    """
    links = materialize(links.where("low != high").select(F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high")).distinct(), "links")
    state = _state(links)
    one = F.count(F.lit(1)).alias("n")
    while True:
        both = links.unionByName(links.select(F.col("high").alias("low"), F.col("low").alias("high")))
        least = both.groupBy("low").agg(F.least(F.min("high"), F.col("low")).alias("least"), one)
        stars = _joined(links, least, "low", state[0]).select(F.col("least").alias("low"), "high")
        stars = materialize(stars.where("low != high").distinct(), "links")
        moved = _joined(stars, stars.groupBy("high").agg(F.min("low").alias("least"), one), "high", state[0])
        linked = moved.select(F.col("least").alias("low"), F.col("low").alias("high")).unionByName(moved.select(F.col("least").alias("low"), "high"))
        new = materialize(linked.where("low != high").distinct(), "links")
        remove(links)
        remove(stars)
        links, old, state = new, state, _state(new)
        if old == state:
            return links.select(F.col("high").alias("node"), F.col("low").alias("root"))
