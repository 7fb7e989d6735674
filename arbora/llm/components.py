"""Connected components of a graph given as pairs, without any node's neighbours meeting in one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.session import persisted


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links a - b between ids: each id, and the smallest id it is connected with."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, low = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = np.minimum(new, new[new])
        if (new == low).all():
            return ids, ids[low]
        low = new


def components(pairs: DataFrame, name: str) -> DataFrame:
    """pairs: a, b (bigint). Returns node, component (its smallest node) for every node but the smallest of each component.

    Large and small stars in turn (each node's neighbours move to its smallest neighbour) until nothing moves; the minimum
    is aggregated before it is joined back, so a hub is a skewed join at worst, which Spark splits. Each round is written
    to the shared folder, so that a lost executor costs one round. An empty graph has no rows; a = b and repeated pairs are allowed.
    """
    edges = persisted(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-edges")
    state = None
    while True:
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("low")).select("x", F.least("x", "low").alias("low"))
        large = persisted(both.join(low, "x").where("y > x").select(F.col("y").alias("u"), F.col("low").alias("v")).distinct(), f"{name}-large")
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        moved = large.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = persisted(moved.union(low.select("u", F.col("low").alias("v"))).distinct(), f"{name}-small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now
