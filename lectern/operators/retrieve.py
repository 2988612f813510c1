"""Hybrid retrieval of chunks for questions, candidate counts, and reranking.

asks: q_id, kb_id, question; each question goes to the collections it is asked of, by an equi-join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lectern.config import DEFAULT, Settings
from lectern.operators import chunking, tfidf, vectors
from lectern.plans.storage import materialize, merged
from lectern.plans.vector_table import VectorTable
from lectern.providers import Embedder, HashingEmbedder, Reranker

PAIR = ["q_id", "kb_id"]
#: Ids of collections that can't be indexed, up to which they may be broadcast.
FEW = 250_000


@dataclass(frozen=True)
class Index:
    """A collection's index as frames: chunks with vectors, vocabulary, postings; all with kb_id; and the stop list they were made with.

    runs: vocabulary and postings once more, as `tfidf.folded` has them; a store takes these if there are.
    """

    chunks: DataFrame
    vocab: DataFrame
    postings: DataFrame
    stop_words: tuple[str, ...] = tfidf.STOP_WORDS
    runs: DataFrame | None = None

    def where(self, condition: Column | str) -> Index:
        """The index of some collections; the condition is one on kb_id."""
        some = {part: getattr(self, part).where(condition) for part in ("chunks", "vocab", "postings", "runs") if getattr(self, part) is not None}
        return replace(self, **some)


def default_embedder(cfg: Settings) -> Callable[[], Embedder]:
    return partial(HashingEmbedder, cfg.embed_dim)


def embedded(rows: DataFrame, text: str, out: str, cfg: Settings, embedder: Callable[[], Embedder] | None, table: VectorTable | None) -> DataFrame:
    """rows with vectors of a column of texts: those of a table, which encodes new texts only, or made anew."""
    return table.embedded(rows, text, out) if table is not None else rows.withColumn(out, vectors.embed(text, embedder or default_embedder(cfg)))


def build_index(chunks: DataFrame, cfg: Settings = DEFAULT, embedder: Callable[[], Embedder] | None = None, stop_words: tuple[str, ...] = tfidf.STOP_WORDS, table: VectorTable | None = None, asks: DataFrame | None = None) -> Index:
    """Vectors and TF-IDF of chunks; collections of fewer than `min_chunks` chunks aren't indexed (see `chunking.indexable`).

    All parts are written to the shared folder, so that no action makes them again: a model sees a chunk
    once, and not at all if `table` (which then stands for the embedder) has its text already.

    asks: the questions, where the index is made for these alone and not kept. Vocabulary and postings then needn't
    have other terms than theirs (`tfidf.index_terms`); what there is has the values of the whole index.
    """
    chunks = chunks if hasattr(chunks, "_written_at") else materialize(chunks, "given-chunks")  # it is read four times
    few = materialize(chunking.rejected(chunks, cfg), "rejected")
    if not few.isEmpty():  # compressed bytes say little about ids, so they are counted: only so many may be broadcast
        chunks = chunks.join(few, "kb_id", "left_anti") if few.count() <= FEW else merged(chunks, few, ["kb_id"], "left_anti")
    vocab, postings, runs = tfidf.index_runs(chunks, cfg, stop_words, asks=asks)
    return Index(materialize(embedded(chunks, "embed_text", "embedding", cfg, embedder, table), "index-chunks"), vocab, postings, stop_words, runs)


def norm01(x: Column, low: Column, high: Column) -> Column:
    """Min-max scaling; 0 where all are equal."""
    return F.when(high - low < 1e-12, F.lit(0.0)).otherwise((x - low) / (high - low))


def dynamic_k(n: Column, cfg: Settings = DEFAULT) -> Column:
    return F.least(F.lit(cfg.dynamic_high), F.greatest(F.lit(cfg.dynamic_low), F.floor(n / cfg.dynamic_divisor))).cast("int")


def sparse_scores(index: Index, asks: DataFrame) -> DataFrame:
    """q_id, kb_id, chunk_idx, sparse: cosine of every chunk that shares a term with the question."""
    asked = materialize(tfidf.text_weights(asks, PAIR, "question", index.vocab, index.stop_words), "ask-weights")
    return tfidf.cosine(asked, index.postings, PAIR, ["kb_id", "chunk_idx"]).withColumnRenamed("cosine", "sparse")


def distinct_asks(asks: DataFrame) -> DataFrame:
    """Each (q_id, kb_id) once; of different questions under one id the first by its text. Questions without either id reach no collection."""
    return asks.where("q_id IS NOT NULL AND kb_id IS NOT NULL").groupBy(*PAIR).agg(F.min(F.coalesce("question", F.lit(""))).alias("question"))


#: What a cell finds out about a question.
_PART = "low_dense double, high_dense double, low_sparse double, high_sparse double, n_chunks long, bound double, best array<struct<chunk_idx:int,dense:double,sparse:double>>"


def _scan(keep: int, exact: bool, alpha: float):
    """Cells against packs: a row for each question of a pack.

    best holds all chunks that share a term with the question and the `keep` others of greatest dense
    score; bound is the least of these if the cell has more. With `exact` the ranges of both scores are
    known, and best holds the `keep` chunks of greatest score (to nine digits), the smaller index first.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("chunk_idx", pa.int32()), ("dense", pa.float64()), ("sparse", pa.float64())]))
        for batch in batches:
            (v_at, v), (q_at, q), (m_at, m) = (vectors._structs(batch.column(c)) for c in ("vectors", "asks", "matched"))
            ids, embedded, asked = v.field("key").to_numpy(), vectors._matrix(v.field("embedding")), vectors._matrix(q.field("q_embedding"))
            names, m_names = q.field("q_id").to_pylist(), m.field("q_id").to_pylist()
            m_ids, m_sparse = m.field("chunk_idx").to_numpy(), m.field("sparse").to_numpy()
            spans = np.array([q.field(c).to_numpy() for c in ("low_dense", "high_dense", "low_sparse", "high_sparse")]) if exact else None
            rows: list[tuple] = []
            for row in range(batch.num_rows):
                a, z, first, last = v_at[row], v_at[row + 1], q_at[row], q_at[row + 1]
                order = np.argsort(ids[a:z])
                keys, dense = ids[a:z][order], asked[first:last] @ embedded[a:z][order].T
                place = {name: k for k, name in enumerate(names[first:last])}
                sparse, has = np.zeros_like(dense), np.zeros(dense.shape, dtype=bool)
                who = np.array([place[x] for x in m_names[m_at[row] : m_at[row + 1]]], dtype=np.int64)
                at = np.searchsorted(keys, m_ids[m_at[row] : m_at[row + 1]])
                sparse[who, at], has[who, at] = m_sparse[m_at[row] : m_at[row + 1]], True
                for k in range(last - first):
                    bound = None
                    if exact:
                        low_d, high_d, low_s, high_s = spans[:, first + k]
                        scaled = lambda x, low, high: np.zeros(len(x)) if high - low < 1e-12 else (x - low) / (high - low)
                        score = np.round(alpha * scaled(dense[k], low_d, high_d) + (1 - alpha) * scaled(sparse[k], low_s, high_s), 9)
                        chosen = vectors._best(score, keys, keep)
                    else:
                        others = np.flatnonzero(~has[k])
                        if len(others) > keep:
                            others = others[vectors._best(dense[k][others], keys[others], keep)]
                            bound = float(dense[k][others[-1]])
                        chosen = np.concatenate((np.flatnonzero(has[k]), others))
                    rows.append((dense[k].min(), dense[k].max(), sparse[k].min(), sparse[k].max(), len(keys), bound, keys[chosen], dense[k][chosen], sparse[k][chosen]))
            ends = np.concatenate(([0], np.cumsum([len(r[6]) for r in rows]))).astype(np.int32)
            flat = [np.concatenate([r[k] for r in rows]) if rows else np.zeros(0) for k in (6, 7, 8)]
            best = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[0].astype(np.int32)), pa.array(flat[1]), pa.array(flat[2])], fields=list(kind.value_type)))
            who = np.repeat(np.arange(batch.num_rows), np.diff(q_at))
            numbers = [pa.array([r[k] for r in rows], kind) for k, kind in ((0, pa.float64()), (1, pa.float64()), (2, pa.float64()), (3, pa.float64()), (4, pa.int64()), (5, pa.float64()))]
            yield pa.RecordBatch.from_arrays([q.field("q_id"), batch.column("kb_id").take(pa.array(who)), *numbers, best], names=[*PAIR, "low_dense", "high_dense", "low_sparse", "high_sparse", "n_chunks", "bound", "best"])

    return work


def _scanned(index: Index, asked: DataFrame, sparse: DataFrame, keep: int, alpha: float, exact: bool = False) -> DataFrame:
    """What each cell of a collection finds out about each of its questions: PAIR and the columns of `_scan`."""
    sizes = index.chunks.groupBy("kb_id").agg((F.floor(F.max("chunk_idx") / vectors.CELL) + 1).cast("long").alias("n_cells"))
    counts = asked.groupBy("kb_id").agg(F.ceil(F.count(F.lit(1)) / vectors.PACK).cast("long").alias("n_packs"))
    sizes = materialize(merged(sizes, counts, ["kb_id"]), "cells")
    spans = ["low_dense", "high_dense", "low_sparse", "high_sparse"] if exact else []
    asks = vectors.packs(asked, ["kb_id"], sizes, ["q_id", "q_embedding", *spans])
    cell = F.floor(F.col("chunk_idx") / vectors.CELL).cast("long")
    hits = merged(sparse, sizes, ["kb_id"]).groupBy("kb_id", cell.alias("cell"), F.pmod(F.xxhash64("q_id"), "n_packs").alias("pack")).agg(F.collect_list(F.struct("q_id", "chunk_idx", "sparse")).alias("matched"))
    work = merged(merged(asks, hits, ["kb_id", "cell", "pack"], "left"), vectors.cells(index.chunks, ["kb_id"], cell, "chunk_idx"), ["kb_id", "cell"])
    kinds = dict(asked.dtypes)
    return work.select("kb_id", "vectors", "asks", "matched").mapInArrow(_scan(keep, exact, alpha), f"q_id {kinds['q_id']}, kb_id {kinds['kb_id']}, {_PART}")


def hybrid(index: Index, asks: DataFrame, cfg: Settings = DEFAULT, top_k: int | None = None, embedder: Callable[[], Embedder] | None = None, table: VectorTable | None = None) -> DataFrame:
    """The best chunks of each question and collection: chunk columns, question, dense, sparse, score, rank, n_chunks.

    A collection is cut into cells of `vectors.CELL` chunks, so a question to a large one is spread over
    tasks. A cell multiplies its vectors by those of a pack of questions and hands on, for each question,
    the ranges of both scores, the chunks that share a term with it, and one more of the others than can
    be asked for. What it holds back has a smaller dense score than these and no sparse one, which bounds
    its score once all ranges have met: where the last chunk asked for is above that bound (to nine digits),
    the ranks are complete. Questions for which it isn't (many chunks of one score) are scanned again with
    the ranges known, and every cell gives its best by score. Texts are fetched for the chosen chunks alone.

    A question that is given twice for a collection is asked once (`distinct_asks`).
    """
    asks = distinct_asks(asks)
    asked = materialize(embedded(asks, "question", "q_embedding", cfg, embedder, table), "asked")
    sparse = materialize(sparse_scores(index, asks), "sparse")
    most = top_k or cfg.dynamic_high
    parts = materialize(_scanned(index, asked, sparse, most + 1, cfg.alpha), "parts")
    span = materialize(parts.groupBy(*PAIR).agg(F.min("low_dense").alias("low_dense"), F.max("high_dense").alias("high_dense"), F.min("low_sparse").alias("low_sparse"), F.max("high_sparse").alias("high_sparse"), F.sum("n_chunks").alias("n_chunks"), F.max("bound").alias("bound")), "spans")
    ranked = materialize(_ranked(parts, span, cfg, most, top_k), "ranked")
    worst = F.round(_score(cfg, F.col("bound"), F.lit(0.0)), 9)
    ends = ranked.groupBy(*PAIR).agg(F.min(F.round("score", 9)).alias("least"))
    open_ = materialize(merged(span.where("bound IS NOT NULL"), ends, PAIR).where(F.col("least") <= worst).select(*PAIR, "low_dense", "high_dense", "low_sparse", "high_sparse"), "open")
    if not open_.isEmpty():
        few = replace(index, chunks=merged(index.chunks, open_.select("kb_id").distinct(), ["kb_id"], "left_semi"))
        again = materialize(_scanned(few, merged(asked, open_, PAIR), merged(sparse, open_.select(*PAIR), PAIR, "left_semi"), most, cfg.alpha, exact=True), "parts-again")
        # written, so that what is made of the ranks doesn't plan the scan again with each of its stages
        ranked = materialize(merged(ranked, open_, PAIR, "left_anti").unionByName(_ranked(again, span, cfg, most, top_k)), "ranked-again")
    return merged(merged(ranked, index.chunks.drop("embedding"), ["kb_id", "chunk_idx"]), asked, PAIR)


def _score(cfg: Settings, dense: Column, sparse: Column) -> Column:
    part = lambda x, c: norm01(x, F.col(f"low_{c}"), F.col(f"high_{c}"))
    return F.lit(cfg.alpha) * part(dense, "dense") + F.lit(1 - cfg.alpha) * part(sparse, "sparse")


def _ranked(parts: DataFrame, span: DataFrame, cfg: Settings, most: int, top_k: int | None) -> DataFrame:
    """PAIR, chunk_idx, dense, sparse, score, n_chunks, rank of the best among what cells handed on."""
    found = merged(parts.select(*PAIR, F.explode("best").alias("b")).select(*PAIR, "b.*"), span, PAIR)
    scored = found.withColumn("score", _score(cfg, F.col("dense"), F.col("sparse")))
    rank = F.row_number().over(Window.partitionBy(*PAIR).orderBy(F.round("score", 9).desc(), "chunk_idx"))
    ranked = scored.select(*PAIR, "chunk_idx", "dense", "sparse", "score", "n_chunks", rank.alias("rank")).where(F.col("rank") <= most)
    return ranked if top_k else ranked.where(F.col("rank") <= dynamic_k(F.col("n_chunks"), cfg))


def rerank(candidates: DataFrame, cfg: Settings = DEFAULT, reranker: Callable[[], Reranker] | None = None) -> DataFrame:
    """The first candidates by a pair scorer, ranked anew; scores stay those of retrieval. Without a scorer they pass through."""
    if reranker is None:
        return candidates.where(F.col("rank") <= cfg.rerank_k)

    @pandas_udf("double")
    def pair_score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = reranker()
        for questions, chunks in batches:
            yield pd.Series(model.score(questions, chunks))

    scored = candidates.withColumn("_pair", pair_score("question", "chunk"))
    rank = F.row_number().over(Window.partitionBy(*PAIR).orderBy(F.col("_pair").desc(), "rank"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= cfg.rerank_k).drop("_pair")
