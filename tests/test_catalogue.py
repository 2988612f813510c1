"""Every registered query of the engine against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from lectern.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return f"{value + 0.0:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = con.sql(catalogue.ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    index = [want.columns.index(n) for n in names]
    rows = sorted(tuple(plain(r[n]) for n in names) for r in got.collect())
    assert rows == sorted(tuple(plain(r[i]) for i in index) for r in want.fetchall())
    assert rows or name in ("retrieval_recall",)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_short_items_find_their_documents(spark, tmp_path):
    from lectern.plans import queries_index

    texts = ["one two  three", "so one two three then and more words to follow", "none two three", "a b c d e f g h i", "x", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one two three"), (2, "b c d e f g h i"), (3, "x"), (4, "two four"), (5, None), (6, "ne two thr")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries_index._holding(spark, str(tmp_path))
    assert sorted((r.q_id, r.kb_id) for r in got.collect()) == [(1, 0), (1, 1), (1, 2), (2, 3), (3, 4), (6, 0), (6, 1), (6, 2)]


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
