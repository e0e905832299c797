"""Connected components by alternating star contraction.

Each round points every larger neighbour of a node at the smallest node around it (large star),
then every node and its smaller neighbours at the smallest of them (small star), until nothing
changes. Rounds are stored in the shared folder, so lineage stays short and a lost executor costs
one round. Minima combine before they shuffle, and they are joined back by node, a unique key, so
that a node with many links is split over tasks instead of gathered in one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tellmark.llm.common import stored


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct links with ``u`` > ``v``."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _oriented(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    smaller = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _oriented(smaller.unionByName(least.select("u", F.col("m").alias("v"))))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node that has a link to
    another one. Links may repeat, in either direction; links with null are ignored."""
    now = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where(
        "u is not null and v is not null"
    )
    now = stored(_oriented(now), "links")
    before = _state(now)
    while before[0]:
        now = stored(_small_star(_large_star(now)), "links")
        after = _state(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def merge_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable place after adding links between places, given labels so far."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            higher = label[label]
            if (higher == label).all():
                break
            label = higher
