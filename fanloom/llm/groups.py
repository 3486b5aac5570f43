"""Connected components by minimum labels, in rounds that are written to the shared folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanloom.session import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the least node of each node's component, for every node that an edge between two nodes has.

    Each round takes the least label of a node and its neighbours and then follows labels once more (pointer
    jumping), so that chains shrink by halves; groups that are stars or cliques need two or three rounds."""
    own = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("s"), F.col(b).alias("d"))
    both = materialise(own.unionByName(own.select(F.col("d").alias("s"), F.col("s").alias("d"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("s").alias("node")).agg(F.least(F.min("d"), F.first("s")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("d"), "label"), "d").groupBy(F.col("s").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("next"), "label")
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        found = step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"), (F.col("label") != F.least("next", F.coalesce("far", "next"))).alias("moved"))
        found = materialise(found, "labels")
        labels = found.select("node", "label")
        if not found.where("moved").limit(1).count():
            return labels


def connected(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least of the nodes that pairs (i, j) connect with each of the nodes 0 ... m - 1."""
    least = np.arange(m)
    while True:
        new = least.copy()
        np.minimum.at(new, i, least[j])
        np.minimum.at(new, j, least[i])
        new = new[new]
        if (new == least).all():
            return least
        least = new
