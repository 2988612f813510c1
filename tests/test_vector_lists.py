"""Vector search by lists against all vectors."""

import numpy as np
import pytest

from lectern.operators import vector_lists, vectors
from lectern.operators.vector_lists import Lists

LARGER = "/root/testdata/sf0.1"


def frames(spark, table, asked):
    rows = spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in table.items()], "vec_id long, embedding array<double>")
    return rows, spark.createDataFrame([(q, [float(x) for x in v]) for q, v in asked], "q_id long, q_embedding array<double>")


def plain(table, asked, k):
    there = {i: v for i, v in table.items() if v is not None}
    return sorted((q, n + 1, i) for q, v in asked for n, i in enumerate(sorted(there, key=lambda i: (-round(float(np.dot(there[i], v)), 6), i))[:k]))


def got(found):
    return sorted((r.q_id, r["rank"], r.vec_id) for r in found.collect())


@pytest.mark.parametrize(("cell", "n_lists", "probes"), [(1024, None, 2), (5, 9, 1), (16, 1, 1), (64, 40, 3)])
def test_exact_search_finds_all(spark, monkeypatch, cell, n_lists, probes):
    """Clusters, vectors of any length, ties, copies, nulls; questions given twice and zero questions."""
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "PACK", 3)
    rng = np.random.default_rng(cell)
    middles = rng.normal(size=(6, 5)) * 3
    table = {i: middles[i % 6] + rng.normal(size=5) * 0.3 for i in range(150)} | {i: np.ones(5) for i in range(150, 190)} | {200: None, 201: np.zeros(5), 202: rng.normal(size=5) * 50}
    asked = [(k, np.round(rng.normal(size=5), 2)) for k in range(8)] * 2 + [(50, np.zeros(5)), (51, np.ones(5))]
    rows, asks = frames(spark, table, asked)
    found = Lists.fit(rows, n_lists)
    assert got(found.search(asks, 7, probes, exact=True)) == plain(table, asked, 7)
    assert found.radii.agg({"n": "sum"}).first()[0] == len(table) - 1  # every vector is filed


def test_small_and_empty_tables(spark):
    rows, asks = frames(spark, {1: np.ones(3), 2: None}, [(1, np.ones(3))])
    assert got(Lists.fit(rows).search(asks, 5, exact=True)) == [(1, 1, 1)]
    assert Lists.fit(rows.limit(0)).search(asks, 5).count() == 0 == Lists.fit(rows).search(asks.limit(0), 5, exact=True).count()


def test_recall_of_few_lists(spark):
    """All rows of the embeddings are filed; a few lists find at least nine tenths of what all vectors give."""
    rows = spark.read.parquet(f"{LARGER}/embeddings.parquet").select("vec_id", "embedding")
    asks = rows.where("vec_id % 50 = 0").selectExpr("vec_id AS q_id", "embedding AS q_embedding")
    want = set(got(vectors.dense_topk(rows, asks, 5)))
    found = Lists.fit(rows)
    few = {(q, i) for q, _, i in got(found.search(asks, 5))}
    assert len(few & {(q, i) for q, _, i in want}) >= 0.9 * len(want)
    assert set(got(found.search(asks, 5, probes=4, exact=True))) == want
    bounds = asks.selectExpr("q_id", "CAST(q_embedding AS array<double>) AS q_embedding", "q_id AS n").mapInArrow(vector_lists._bounds(found.centroids, np.zeros(len(found.centroids)), 12), "q_id long, q_embedding array<double>, n long, list int, bound double, place int")
    assert bounds.groupBy("q_id").count().where("count <> 12").count() == 0
