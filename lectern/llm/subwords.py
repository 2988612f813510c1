"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed features: words, pairs of neighbouring
words (a word that repeats the one before has a feature of its own), and n-grams of three and four
characters within words.  A softmax layer reads the average.  All kinds of features share one table of
65,536 buckets, so some share a vector.  Vectors and layer are trained by stochastic gradient descent
in numpy on a bounded sample of labelled documents (`Training.max_train` documents, whole texts of
`Training.max_bytes` together, none of over a sixteenth of that; the executors count their features).

The layer is linear, so a trained model collapses to one number per hash bucket; scoring sums these
over all features of whole texts, however long, in numpy.  What is broadcast has a fixed size.

Nulls: null and empty texts have no features and get the score of the bias.  Missing labels are left
out of the sample; of contradicting labels of one document 1 counts; with no labelled rows, or one class
only, every score is the share of label 1 (0.5 without any).  Repeated rows are scored each for itself.
Ties: a score of exactly 0.3 is predicted 1.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import kernels as K
from lectern.llm.labelled import held_out, sample

BUCKETS = 1 << 16
GRAMS = (3, 4)


@dataclass(frozen=True)
class Training:
    max_train: int = 3000
    max_bytes: int = 16 << 20
    dim: int = 16
    epochs: int = 6
    rate: float = 40.0
    seed: int = 7


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Kinds of features of the documents in data, each as bucket numbers and n + 1 firsts."""
    prefix = K.prefix_hash(K.BYTE_VALUE[data])
    starts, ends, firsts = K.word_bounds(data, offsets, K.TEXT_WORD)
    words = K.range_hash(prefix, starts, ends)
    yield (words & np.uint64(BUCKETS - 1)).astype(np.int64), firsts
    if len(words) > 1:
        inner = np.ones(len(words) - 1, dtype=bool)
        cut = firsts[1:-1]
        inner[cut[(cut > 0) & (cut < len(words))] - 1] = False
        pairs = np.where(words[:-1] == words[1:], np.uint64(1), K.mix64(words[:-1] * np.uint64(3) + words[1:]))
        at = np.concatenate(([0], np.cumsum(inner)))
        yield (pairs[inner] & np.uint64(BUCKETS - 1)).astype(np.int64), at[np.clip(firsts, 0, len(inner))]
    inside = K.TEXT_WORD[data] & ((data & 0xC0) != 0x80)  # first bytes of the words' characters
    place = np.flatnonzero(inside)
    word = np.searchsorted(starts, place, side="right") - 1
    after = np.append(place[1:], len(data))
    after = np.minimum(after, ends[word]) if len(place) else place  # where each character ends
    for n in GRAMS:
        some = np.flatnonzero(word[: len(word) - n + 1] == word[n - 1 :]) if len(word) >= n else np.zeros(0, np.int64)
        grams = K.range_hash(prefix, place[some], after[some + n - 1]) * np.uint64(0x9E3779B97F4A7C15 + 2 * n)
        yield (grams >> np.uint64(48)).astype(np.int64), np.searchsorted(word[some], firsts)


def counted(rows: DataFrame) -> DataFrame:
    """y, bucket numbers and their counts (arrays of int32 as bytes) of each sampled document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in K.slices(batches):
            kinds = list(features(data, offsets))
            ids, counts = [], []
            for d in range(batch.num_rows):
                own = np.concatenate([bucket[first[d] : first[d + 1]] for bucket, first in kinds])
                some, n = np.unique(own, return_counts=True)
                ids.append(some.astype("<i4").tobytes())
                counts.append(n.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "y", "ids", "counts"])

    return rows.mapInArrow(work, "doc_id long, y int, ids binary, counts binary")


@dataclass
class Model:
    table: np.ndarray  # per bucket: what it adds to the log-odds of label 1
    bias: float


def train(documents: list[tuple[int, bytes, bytes]], how: Training) -> Model:
    """Stochastic gradient descent over (y, ids, counts)."""
    y = np.array([d[0] for d in documents])
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        edge = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS), float(np.log(edge / (1 - edge))))
    rng = np.random.default_rng(how.seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, how.dim))
    layer, bias = rng.normal(0, 0.3, (how.dim, 2)), np.zeros(2)
    seen = [(np.frombuffer(i, "<i4"), np.frombuffer(c, "<i4")) for _, i, c in documents]
    steps, done = how.epochs * len(y), 0
    for _ in range(how.epochs):
        for d in rng.permutation(len(y)):
            ids, counts = seen[d]
            rate = how.rate * (1 - done / steps)
            done += 1
            if not len(ids):
                continue
            part = counts / counts.sum()
            mean = part @ vectors[ids]
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[y[d]] -= 1
            back = layer @ error
            layer -= 0.05 * rate / how.rate * np.outer(mean, error)
            bias -= 0.02 * rate / how.rate * error
            vectors[ids] -= rate * part[:, None] * back
    both = vectors @ layer
    return Model(both[:, 1] - both[:, 0], float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", how: Training | None = None) -> Model:
    """A model from a bounded sample, trained on the driver."""
    how = how or Training()
    rows = counted(sample(docs, labels, label, how.max_train, how.max_bytes)).collect()
    rows.sort(key=lambda r: (r.doc_id, r.y, bytes(r.ids)))
    return train([(r.y, bytes(r.ids), bytes(r.counts)) for r in rows], how)


def segment_sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of values[firsts[d]:firsts[d + 1]], each in an order that depends on its own values only."""
    out, some = np.zeros(len(firsts) - 1), np.flatnonzero(np.diff(firsts))
    if len(some):
        out[some] = np.add.reduceat(values[: firsts[-1]], firsts[some])
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, data, offsets in K.slices(batches):
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for bucket, first in features(data, offsets):
                total += segment_sums(model.table[bucket], first)
                n += np.diff(first)
            logit = total / np.maximum(n, 1) + model.bias
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(1 / (1 + np.exp(-logit)), 9))], names=["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, score double")


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
