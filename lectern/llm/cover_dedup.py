"""Substring dedup of word sequences by difference-cover anchors.

Words are hashed; runs of `PERIOD` words are anchors where their place modulo the period is in a
difference cover.  For any two places p and q some shift below the period puts both p + shift and
q + shift in the cover, so two equal windows of 2 * PERIOD - 1 words or more hold equal anchors at the
same place in them, wherever they stand.  An anchor extends to all windows that hold it (its
context); what contexts don't settle is compared window by window.

Contexts go, as words joined by one space, to the task that holds all of an anchor's.  Windows of equal
hash are held against each other byte for byte there, so hashes decide only what is compared.

Nulls: a null or empty text has no words and the SHA-256 of nothing.  Texts of fewer words than a
window stay whole.  Rows that repeat a doc_id are each compared with smaller ids only.  Ties: of equal
windows those of the smallest id stay, in every row that has it.  An empty table gives an empty result.  A
text longer than a slice is a slice of its own and is worked on whole.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import kernels as K
from lectern.llm.repeats import SPREAD_OVER, Anchors, Slice, Units, dedup, ranges, representatives

WINDOW = 13
#: A perfect difference cover; the differences of its members modulo 7 are all of 0..6.
PERIOD = 7
COVER = (0, 1, 3)


class Words(Units):
    window = WINDOW

    def load(self, part: Slice) -> None:
        starts, ends, self.firsts = K.word_bounds(part.data, part.offsets, K.TEXT_WORD)
        self.n = len(starts)
        # the words of the slice behind each other, with one space behind each
        size = ends - starts
        self.ends = np.cumsum(size + 1) - 1
        self.starts = self.ends - size
        self.text = np.full(int(self.ends[-1]) + 1 if self.n else 0, 0x20, np.uint8)
        self.text[ranges(self.starts, size)] = part.data[ranges(starts, size)]
        self.prefix = K.prefix_hash(K.range_hash(K.prefix_hash(K.BYTE_VALUE[self.text]), self.starts, self.ends))

    def anchors(self) -> Anchors:
        doc = K.owner(self.firsts)
        place = np.arange(self.n) - self.firsts[doc]
        size = np.diff(self.firsts)[doc]
        at = np.flatnonzero(np.isin(place % PERIOD, COVER) & (place + PERIOD <= size) & (size >= WINDOW))
        doc = doc[at]
        first = np.maximum(self.firsts[doc], at - (WINDOW - PERIOD))
        last = np.minimum(self.firsts[doc + 1] - WINDOW, at)
        context = K.mix64(K.range_hash(self.prefix, first, last + WINDOW) + np.uint64(3) * (at - first).astype(np.uint64))
        return Anchors(K.range_hash(self.prefix, at, at + PERIOD), context, doc, first, last)

    def context_bytes(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = self.starts[first]
        return begin, self.ends[last + WINDOW - 1] + 1 - begin  # with the space behind the last word

    def window_hashes(self, at: np.ndarray) -> np.ndarray:
        return K.range_hash(self.prefix, at, at + WINDOW)

    @staticmethod
    def classes(text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        space = np.flatnonzero(text == 0x20) + 1  # where words end, their space included
        after = np.searchsorted(space, begin + size, side="right")
        before = np.searchsorted(space, begin, side="right")  # words of the text before each context
        windows = after - before - WINDOW + 1
        first = ranges(before, windows)
        start = np.where(first > 0, space[first - 1], 0)
        length = space[first + WINDOW - 1] - start
        prefix, eight = K.prefix_hash(K.BYTE_VALUE[text]), K.eights(text)

        def equal(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = length[i] == length[j]
            out[out] = K.same_ranges(eight, start[i[out]], start[j[out]], length[i[out]])
            return out

        return representatives((K.range_hash(prefix, start, start + length),), np.arange(len(start)), equal, exact=True), windows


def _cut(units: Words, part: Slice, repeat: np.ndarray) -> pa.RecordBatch:
    where = np.flatnonzero(repeat)
    gone = K.covered(units.n, where, np.minimum(where + WINDOW, units.n))
    raw, kept, removed = units.text.tobytes(), [], []
    for a, b in zip(units.firsts[:-1].tolist(), units.firsts[1:].tolist(), strict=True):
        opens, closes = K.runs(~gone[a:b])
        removed.append(int(gone[a:b].sum()))
        kept.append(b" ".join([raw[x:y] for x, y in zip(units.starts[a + opens].tolist(), units.ends[a + closes - 1].tolist(), strict=True)]))
    ids = pa.array(part.ids, mask=part.null.astype(bool))
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(units.firsts)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def dedup_words(docs: DataFrame, spread_over: int = SPREAD_OVER) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space) of every row."""
    return dedup(docs, Words, _cut, "doc_id long, n_words long, n_removed long, kept_text binary", spread_over)


def op8_cover_dedup(spark, sf_dir: str) -> DataFrame:
    """Words of all documents that repeat in windows of 13 from smaller ids."""
    found = dedup_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY p) AS first FROM windows) WHERE first < doc_id),
gone AS (SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(i, i + 13)) AS k FROM again) GROUP BY doc_id),
flat AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM words),
lost AS (SELECT doc_id, unnest(ks) AS k, true AS is_gone FROM gone),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS t, count(*) AS n FROM flat LEFT JOIN lost USING (doc_id, k) WHERE is_gone IS NULL GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
