"""Connected components of an edge table, in Spark and inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.plans.storage import materialize, release


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges (a, b): the smallest node of each one's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:  # jump to the roots
            up = label[label]
            if (up == label).all():
                break
            label = up
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) to one row (u, v) for each node u but the smallest v of its component.

    Alternating large-star and small-star rounds; every round is written to the shared folder, so
    that neither the plan nor a lost executor grows the work.  Only edges are kept, never groups,
    and aggregates combine on the map side, so a hub of any degree is no burden to one task.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _print(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "stars")
        large = both.join(first, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large-star")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        pairs = large.join(least, "u")
        small = pairs.select("u", F.col("m").alias("v")).unionByName(pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        small = materialize(small, "small-star")
        release(edges, first, large, least)  # the round's result is written: only that is read again
        edges = small
        now = _print(edges)
        if now == before:
            break
        before = now
    return edges
