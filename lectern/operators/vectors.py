"""Dense vectors: embedding through a provider, dot products, top-k, and greedy MMR selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lectern.functions.text import as_column, let
from lectern.plans.storage import merged
from lectern.providers import Embedder, HashingEmbedder


def embed(text: Column | str, make: Callable[[], Embedder] = HashingEmbedder) -> Column:
    """array<double> of a text; the provider is made once for each stream of batches and sees a text once for each batch."""

    @pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            place, once = pd.factorize(batch.fillna(""))
            yield pd.Series(list(model.encode(once)[place]))

    return encode(as_column(text))


#: Arrays of texts that are encoded at a time.
ARRAYS = 1024


def embed_each(texts: Column | str, make: Callable[[], Embedder] = HashingEmbedder) -> Column:
    """array<array<double>> of an array of texts; null stays null. A text is encoded once for each `ARRAYS` arrays, whose vectors are held at a time."""

    @pandas_udf("array<array<double>>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for whole in batches:
            for first in range(0, len(whole), ARRAYS):
                batch = whole[first : first + ARRAYS]
                flat = pd.Series([t for row in batch for t in row], dtype=object)
                place, once = pd.factorize(flat.dropna())
                coded, out = model.encode(once) if len(once) else None, [None] * len(flat)
                for at, k in zip(np.flatnonzero(flat.notna()), place, strict=True):
                    out[at] = coded[k]
                ends = np.cumsum([0, *map(len, batch)])
                yield pd.Series([out[a:b] for a, b in pairwise(ends)])

    return encode(as_column(texts))


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products, in order."""
    products = F.zip_with(as_column(a), as_column(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


#: Vectors of a cell and questions of a pack: a task multiplies one cell by one pack at a time.
CELL, PACK = 1024, 256


def cells(vectors: DataFrame, by: list[str], cell: Column, key: str, embedding: str = "embedding") -> DataFrame:
    """by columns, cell, vectors: an array of (key, embedding) for each cell, a piece of its collection of bounded size."""
    rows = vectors.where(F.col(embedding).isNotNull()).select(*by, cell.cast("long").alias("cell"), F.struct(F.col(key).alias("key"), F.col(embedding).cast("array<double>").alias("embedding")).alias("v"))
    return rows.groupBy(*by, "cell").agg(F.collect_list("v").alias("vectors"))


def packs(asked: DataFrame, by: list[str], sizes: DataFrame, columns: list[str]) -> DataFrame:
    """by columns, cell, pack, asks: the questions of a collection, in packs of about `PACK`, for each of its cells.

    sizes: by columns, n_cells, n_packs.  Questions are packed before they are copied, so a copy is an array.
    """
    rows = merged(asked.where("q_embedding IS NOT NULL"), sizes, by) if by else asked.where("q_embedding IS NOT NULL").crossJoin(sizes)
    packed = rows.groupBy(*by, "n_cells", F.pmod(F.xxhash64("q_id"), "n_packs").alias("pack")).agg(F.collect_list(F.struct(*columns)).alias("asks"))
    return packed.select(*by, "pack", "asks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_cells") - 1)).alias("cell"))


def _structs(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """n + 1 offsets and the structs of a column of arrays of structs; null counts as empty."""
    sizes = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.concatenate(([0], np.cumsum(sizes))), column.flatten()


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _best(values: np.ndarray, keys: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` greatest values, the smaller key first among equals, in that order."""
    if len(values) > most:
        least = np.partition(values, len(values) - most)[len(values) - most]
        near = np.flatnonzero(values >= least)
    else:
        near = np.arange(len(values))
    return near[np.lexsort((keys[near], -values[near]))[:most]]


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest of all vectors (vec_id, embedding) to each query (q_id, q_embedding): q_id, vec_id, score, rank.

    Vectors and queries are dealt into cells and packs by hash, each cell meets each pack by matrix product,
    and hands on its k best for each query only.  Nothing goes through the driver but two counts.  Vectors
    and queries that are null are left out; a query given twice is answered twice; ties go by vec_id.
    """
    n_cells, n_packs = (max(1, -(-df.count() // size)) for df, size in ((vectors, CELL), (queries, PACK)))
    made = cells(vectors, [], F.pmod(F.xxhash64("vec_id"), F.lit(n_cells)), "vec_id")
    sizes = vectors.sparkSession.range(1).select(F.lit(n_cells).cast("long").alias("n_cells"), F.lit(n_packs).cast("long").alias("n_packs"))  # one row
    numbered = queries.select("q_id", "q_embedding", F.monotonically_increasing_id().alias("n"))
    asked = packs(numbered, [], sizes, ["q_id", "n", F.col("q_embedding").cast("array<double>").alias("q_embedding")])

    return ranked(nearest(merged(asked, made, ["cell"]), k, dict(queries.dtypes)["q_id"]), k).drop("n")


def nearest(work: DataFrame, k: int, kind: str) -> DataFrame:
    """q_id, n, vec_id, score: the k best of every row's vectors (key, embedding) for each of its asks (q_id, n, q_embedding)."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (v_at, v), (q_at, q) = (_structs(batch.column(c)) for c in ("vectors", "asks"))
            for row in range(batch.num_rows):
                own, asks = v.slice(v_at[row], v_at[row + 1] - v_at[row]), q.slice(q_at[row], q_at[row + 1] - q_at[row])
                keys = own.field("key").to_numpy()
                scores = np.round(_matrix(asks.field("q_embedding")) @ _matrix(own.field("embedding")).T, 6)
                found = [_best(line, keys, k) for line in scores]
                who = np.repeat(np.arange(len(found)), [len(b) for b in found])
                place = np.concatenate(found)
                yield pa.RecordBatch.from_arrays(
                    [asks.field("q_id").take(pa.array(who)), asks.field("n").take(pa.array(who)), pa.array(keys[place]), pa.array(scores[who, place])], names=["q_id", "n", "vec_id", "score"]
                )

    return work.select("vectors", "asks").mapInArrow(best, f"q_id {kind}, n long, vec_id long, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each asking (n), with their rank."""
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mmr(pool: Column | str, k: int = 3, min_rel: float = 0.2, weight: float = 0.72, max_chars: int = 650) -> Column:
    """Positions (0-based, ascending) that greedy maximal marginal relevance takes from a pool.

    pool: array of structs with rel (relevance, compared to nine digits), emb (vector), chars (length), in reading order.  The
    next pick has the largest weight * rel - (1 - weight) * (largest similarity to a pick); the first of
    equals wins.  Selection stops after k picks, at max_chars, or before the first pick but one that
    would pass it.
    """
    none = F.array().cast("array<int>")

    def run(pool: Column) -> Column:
        def step(state: Column, _: Column) -> Column:
            def best(chosen: Column) -> Column:
                value = lambda p: F.round(F.lit(weight) * p["rel"] - F.lit(1.0 - weight) * F.coalesce(F.array_max(F.transform(chosen, lambda c: dot(p["emb"], F.get(pool, c)["emb"]))), F.lit(0.0)), 9)
                scored = F.transform(pool, lambda p, i: F.when((F.round(p["rel"], 9) >= min_rel) & ~F.array_contains(chosen, i), F.struct(value(p).alias("v"), (-i).alias("at"), p["chars"].alias("chars"))))
                return F.array_max(F.filter(scored, lambda s: s.isNotNull()))

            open_ = ~state["done"] & (state["total"] < max_chars)

            def take(pick: Column) -> Column:
                fits = pick.isNotNull() & ((F.size(state["chosen"]) == 0) | (state["total"] + 1 + pick["chars"] <= max_chars))
                return F.when(
                    open_ & fits, F.struct(F.concat(state["chosen"], F.array((-pick["at"]).cast("int"))).alias("chosen"), (state["total"] + pick["chars"] + 1).cast("int").alias("total"), F.lit(False).alias("done"))
                ).otherwise(F.struct(state["chosen"].alias("chosen"), state["total"].alias("total"), F.lit(True).alias("done")))

            return let(best(state["chosen"]), take)

        start = F.struct(none.alias("chosen"), F.lit(0).alias("total"), F.lit(False).alias("done"))
        return F.aggregate(F.array(*[F.lit(i) for i in range(k)]), start, step, lambda s: F.array_sort(s["chosen"]))

    return F.when(F.size(as_column(pool)) > 0, let(as_column(pool), run)).otherwise(none)
