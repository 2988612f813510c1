"""Vector search by lists: vectors are filed under the nearest of some centroids, and a question looks into few lists.

Centroids are fitted by k-means on a bounded sample (`Lists.fit`); every vector is filed. A list is kept
in cells, so one that holds half of all vectors is still spread over tasks. With `probes` lists a question is
answered from those whose centroids are nearest to it, which may miss some; `exact` looks into every further
list that can hold a better vector: the inner product with x is at most that with x's centroid plus the
question's length times the list's radius, and lists whose bound lies below the k-th score found so far are
left out. Results are then those of `vectors.dense_topk`, ties included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import vectors as V
from lectern.plans.storage import materialize

#: Documented bounds: vectors that centroids are fitted on, lists there are, rounds of fitting.
MOST_SAMPLE, MOST_LISTS, ROUNDS = 20_000, 4_096, 12
#: Scores are compared to six digits, so a bound may lie this much below the k-th score.
SLACK = 2e-6


def _fitted(sample: np.ndarray, n_lists: int, seed: int) -> np.ndarray:
    """k-means centroids; an empty list takes the vector that is farthest from its own."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), n_lists, replace=False)]
    for _ in range(ROUNDS):
        distance = (centroids * centroids).sum(axis=1) - 2 * sample @ centroids.T
        own = distance.argmin(axis=1)
        sums, counts = np.zeros_like(centroids), np.bincount(own, minlength=n_lists)
        np.add.at(sums, own, sample)
        far = np.argsort(-distance[np.arange(len(sample)), own])
        empty = np.flatnonzero(counts == 0)
        sums[empty], counts[empty] = sample[far[: len(empty)]], 1
        centroids = sums / counts[:, None]
    return centroids


@dataclass(frozen=True)
class Lists:
    """Centroids (at most `MOST_LISTS`, so they may be sent to every task), filed vectors (list, cell, vectors), and radii (list, radius, n)."""

    centroids: np.ndarray
    filed: DataFrame
    radii: DataFrame

    @classmethod
    def fit(cls, vectors: DataFrame, n_lists: int | None = None, seed: int = 0) -> Lists:
        """File all vectors (vec_id, embedding; null ones are left out). n_lists is about the root of their number unless given."""
        there = vectors.where("embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        n = there.count()
        some = there.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(MOST_SAMPLE).select("embedding").collect()  # a bounded sample
        if not some:
            empty = there.sparkSession.createDataFrame([], "list int, cell long, vectors array<struct<key:long,embedding:array<double>>>")
            return cls(np.zeros((0, 0)), empty, there.sparkSession.createDataFrame([], "list int, radius double, n long"))
        n_lists = max(1, min(n_lists or round(n**0.5), len(some), MOST_LISTS))
        centroids = _fitted(np.array([r[0] for r in some]), n_lists, seed)
        kind = dict(there.dtypes)["vec_id"]
        placed = materialize(there.mapInArrow(_file(centroids), f"vec_id {kind}, embedding array<double>, list int, distance double"), "filed")
        radii = materialize(placed.groupBy("list").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n")), "radii")
        cell = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / V.CELL).cast("long"))
        filed = materialize(V.cells(placed.join(radii.select("list", "n"), "list"), ["list"], cell, "vec_id"), "lists")
        return cls(centroids, filed, radii)

    def search(self, queries: DataFrame, k: int, probes: int = 24, exact: bool = False) -> DataFrame:
        """q_id, vec_id, score, rank: the k best of the lists that are looked into; of all vectors if exact."""
        kind = dict(queries.dtypes)["q_id"]
        asked = queries.where("q_embedding IS NOT NULL").select("q_id", F.col("q_embedding").cast("array<double>").alias("q_embedding"), F.monotonically_increasing_id().alias("n"))
        asked = materialize(asked, "asked")
        if not len(self.centroids):
            return asked.sparkSession.createDataFrame([], f"q_id {kind}, vec_id long, score double, rank int")
        # a row for each question and list: a bound on what the list can give, and the list's place among the nearest
        radius = np.full(len(self.centroids), -1.0)  # no vectors
        for r in self.radii.collect():  # one number for each list
            radius[r["list"]] = r["radius"]
        bounds = asked.mapInArrow(_bounds(self.centroids, radius, None if exact else probes), f"q_id {kind}, q_embedding array<double>, n long, list int, bound double, place int")
        bounds = materialize(bounds, "bounds") if exact else bounds
        found = self._scan(bounds.where(F.col("place") < probes), k, kind)
        if exact:
            found = materialize(V.ranked(found, k).drop("rank"), "probed")
            least = found.groupBy("n").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
            rest = bounds.where(F.col("place") >= probes).join(least, "n", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))
            found = found.unionByName(self._scan(rest, k, kind))
        return V.ranked(found, k).drop("n")

    def _scan(self, wanted: DataFrame, k: int, kind: str) -> DataFrame:
        """The k best of each cell of the lists that each question wants."""
        sizes = self.radii.select("list", F.ceil(F.col("n") / V.CELL).cast("long").alias("n_cells"))
        counts = wanted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / V.PACK).cast("long").alias("n_packs"))
        asks = V.packs(wanted, ["list"], sizes.join(counts, "list"), ["q_id", "n", "q_embedding"])
        return V.nearest(self.filed.join(asks, ["list", "cell"]), k, kind)


def _file(centroids: np.ndarray):
    squares = (centroids * centroids).sum(axis=1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = V._matrix(part.column("embedding"))
                own = (squares - 2 * rows @ centroids.T).argmin(axis=1)
                distance = np.sqrt(((rows - centroids[own]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.astype(np.int32)), pa.array(distance)], names=["vec_id", "embedding", "list", "distance"])

    return work


def _bounds(centroids: np.ndarray, radius: np.ndarray, most: int | None):
    """Rows (question, list) in order of the bound, the first `most` of each question; lists without vectors are left out."""
    there = np.flatnonzero(radius >= 0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = V._matrix(part.column("q_embedding"))
                near = rows @ centroids[there].T
                bound = near + np.sqrt((rows * rows).sum(axis=1))[:, None] * radius[there]
                order = np.argsort(-near, axis=1, kind="stable")[:, :most]
                who = np.repeat(np.arange(part.num_rows), order.shape[1])
                flat, place = order.ravel(), np.tile(np.arange(order.shape[1]), part.num_rows)
                own = [part.column(c).take(pa.array(who)) for c in ("q_id", "q_embedding", "n")]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(there[flat].astype(np.int32)), pa.array(bound[who, flat]), pa.array(place.astype(np.int32))], names=["q_id", "q_embedding", "n", "list", "bound", "place"]
                )

    return work
