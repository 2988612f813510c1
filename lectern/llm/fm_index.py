"""Benchmark decontamination by an FM-index per shard of documents.

A shard's words become numbers (0: a word of no benchmark phrase, which no occurrence can hold; it
ends a stretch).  Its Burrows-Wheeler transform lies in a wavelet matrix, whose ranks carry all test
phrases through backward search at once; the rows found are walked back to sampled suffix positions,
the occurrences are held against the bytes of the words, and their words merge to removal spans.

Shards are slices of a partition of some MB, so an index needs little memory and a lost executor
costs its shards only.  The benchmark is a query set: it is read in blocks of about `block_bytes` (a
longer text in parts that share nine words), so what is broadcast is bounded; one pass over the documents serves each block, and hands on hits only.

Nulls: null and empty texts have no words, and aren't contaminated.  Benchmark rows without words are
ignored; rows that repeat an item id count as that item once.  Rows without an id are searched like
others: their words are hit and make a document contaminated, but they are no items.  An empty
benchmark leaves all documents clean.  Extra columns of either table are ignored.  Long texts are
shards of their own, whole.  There are no ties: every occurrence counts.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import kernels as K
from lectern.plans.storage import materialize

WINDOW = 10
BLOCK_BYTES = 8 << 20
SAMPLE = 16
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass
class Phrases:
    """Test phrases as rows of word numbers (1...), by length, and the items that hold each."""

    hashes: np.ndarray  # of the words, sorted
    numbers: np.ndarray  # of the words in that order
    data: np.ndarray  # bytes of all words, by number
    offsets: np.ndarray
    groups: list[tuple[np.ndarray, np.ndarray]]  # (phrases x length, phrase numbers)
    item_first: np.ndarray  # phrase number -> where its items start
    items: np.ndarray  # item indexes
    item_ids: list
    shortest: int


def phrases_of(rows: list[tuple], window: int = WINDOW) -> Phrases | None:
    """Phrases of benchmark rows (item_id, text); None if there are none."""
    words: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[int]] = {}
    ids: dict = {}
    for item, text in rows:
        own = [words.setdefault(w, len(words) + 1) for w in _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())]
        if own:
            at = ids.setdefault(item, len(ids))
            for i in range(max(1, len(own) - window + 1)):
                found.setdefault(tuple(own[i : i + window]), set()).add(at)
    if not found:
        return None
    data = np.frombuffer(b"".join(words), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
    hashes = K.range_hash(K.prefix_hash(K.BYTE_VALUE[data]), offsets[:-1], offsets[1:])
    order = np.argsort(hashes)
    every = list(found)
    groups = []
    for n in sorted({len(p) for p in every}):
        which = np.array([k for k, p in enumerate(every) if len(p) == n])
        groups.append((np.array([every[k] for k in which], dtype=np.int64), which))
    sizes = [len(found[p]) for p in every]
    return Phrases(hashes[order], order + 1, data, offsets, groups, np.concatenate(([0], np.cumsum(sizes))), np.array([i for p in every for i in sorted(found[p])], dtype=np.int64), list(ids), min(map(len, every)))


class FMIndex:
    """Suffix ranks of a number sequence in which each 0 ends a stretch and differs from every other 0."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE) -> None:
        n = len(text)
        self.n = n
        order = self._suffix_order(text)
        before = text[order - 1]  # text[-1] is a 0
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))))
        self.levels = max(1, int(text.max()).bit_length())
        self.zeros, self.rank0 = [], []
        row = before
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level) & 1
            self.rank0.append(np.concatenate(([0], np.cumsum(bit == 0))))
            self.zeros.append(int(self.rank0[-1][-1]))
            row = np.concatenate((row[bit == 0], row[bit == 1]))
        self.before = before
        marked = (order % sample == 0) | (before == 0)  # no walk passes the end of a stretch
        self.marked = marked
        self.mark_rank = np.cumsum(marked) - 1
        self.samples = order[marked]

    @staticmethod
    def _suffix_order(text: np.ndarray) -> np.ndarray:
        n, ends = len(text), text == 0
        key = np.where(ends, np.cumsum(ends) - 1, text + int(ends.sum()))
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        step = 1
        while True:
            order = np.argsort(rank, kind="stable")
            if rank[order[-1]] == n - 1:
                return order
            behind = np.zeros(n, dtype=np.int64)
            behind[:-step] = rank[step:] + 1
            both = rank * (n + 1) + behind
            order = np.argsort(both, kind="stable")
            row = both[order]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(row[1:] != row[:-1])))
            step *= 2
            if step >= n:
                return np.argsort(rank, kind="stable")

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first `at` places of the transform."""
        base, at = np.zeros_like(at), at.copy()
        for k in range(self.levels):
            r0, one = self.rank0[k], (symbols >> (self.levels - 1 - k)) & 1 == 1
            base = np.where(one, self.zeros[k] + base - r0[base], r0[base])
            at = np.where(one, self.zeros[k] + at - r0[at], r0[at])
        return at - base

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that start with each row of phrases."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            known = c < len(self.counts) - 1
            start = self.counts[np.where(known, c, 0)]
            lo, hi = start + self.rank(c, low[live]), start + self.rank(c, high[live])
            hi = np.where(known, hi, lo)
            low[live], high[live] = lo, hi
            live = live[hi > lo]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of rows of the suffix order."""
        place, walked = np.zeros(len(rows), np.int64), 0
        open_, rows = np.arange(len(rows)), rows.copy()
        while len(open_):
            done = self.marked[rows]
            place[open_[done]] = self.samples[self.mark_rank[rows[done]]] + walked
            open_, rows = open_[~done], rows[~done]
            c = self.before[rows]
            rows = self.counts[c] + self.rank(c, rows)
            walked += 1
        return place


def occurrences(phrases: Phrases, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, word count and phrase number of every occurrence within a document. data is in lower case."""
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, none
    hashes = K.range_hash(K.prefix_hash(K.BYTE_VALUE[data]), starts, ends)
    at = np.minimum(np.searchsorted(phrases.hashes, hashes), len(phrases.hashes) - 1)
    number = np.where(phrases.hashes[at] == hashes, phrases.numbers[at], 0)
    # stretches of known words that are long enough for a phrase; a document's end ends a stretch
    begin = np.zeros(len(starts) + 1, dtype=bool)
    begin[firsts] = True
    known = number > 0
    opens = np.flatnonzero(known & (begin[:-1] | ~np.concatenate(([False], known[:-1]))))
    closes = np.flatnonzero(known & (begin[1:] | ~np.concatenate((known[1:], [False])))) + 1
    long = closes - opens >= phrases.shortest
    opens, sizes = opens[long], (closes - opens)[long]
    if not len(opens):
        return none, none, none
    to = np.cumsum(sizes + 1)  # each stretch and a 0 behind it
    text, place = np.zeros(int(to[-1]), np.int64), np.full(int(to[-1]), -1, np.int64)
    word = np.repeat(opens - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    where = np.repeat(to - sizes - 1 - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    text[where], place[where] = number[word], word
    index = FMIndex(text)
    out = []
    for rows, names in phrases.groups:
        low, high = index.search(rows)
        size = high - low
        row = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        out.append((place[index.locate(row)], np.full(len(row), rows.shape[1]), np.repeat(names, size)))
    first, count, name = (np.concatenate(x) for x in zip(*out, strict=True))
    good = _same_bytes(phrases, data, starts, ends, number, first, count)
    return first[good], count[good], name[good]


def _same_bytes(phrases: Phrases, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, number: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Whether all words of each occurrence are their vocabulary words byte for byte."""
    if not len(first):
        return np.zeros(0, dtype=bool)
    hit = np.flatnonzero(K.covered(len(starts), first, first + count))
    n, at = number[hit] - 1, starts[hit]
    size = phrases.offsets[n + 1] - phrases.offsets[n]
    bad = size != ends[hit] - at
    size = np.where(bad, 0, size)
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    wrong = data[np.repeat(at, size) + step] != phrases.data[np.repeat(phrases.offsets[n], size) + step]
    bad[np.repeat(np.arange(len(hit)), size)[wrong]] = True
    errors = np.concatenate(([0], np.cumsum(np.bincount(hit[bad], minlength=len(starts)))))
    return errors[first + count] == errors[first]


_DDL = "n_words long, hit_from array<long>, hit_to array<long>, item_ids array<string>"


def _pass(docs: DataFrame, phrases: Phrases | None) -> DataFrame:
    """docs with n_words, the hit words as ranges of bytes (hit_from, hit_to) and item_ids of one block of phrases; its broadcast goes along in _phrases."""
    shared = docs.sparkSession.sparkContext.broadcast(phrases)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for batch, data, offsets in K.slices(batches):
            low = K.LOWER[data]
            starts, ends, firsts = K.word_bounds(low, offsets, K.ALNUM_WORD)
            hit = np.zeros(len(starts), dtype=bool)
            items: list[list[str]] = [[] for _ in range(batch.num_rows)]
            if phrases is not None:
                first, count, name = occurrences(phrases, low, starts, ends, firsts)
                hit = K.covered(len(starts), first, first + count)
                doc = np.searchsorted(firsts, first, side="right") - 1
                pairs = np.unique(np.stack((doc, name), axis=1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
                sizes = phrases.item_first[pairs[:, 1] + 1] - phrases.item_first[pairs[:, 1]]
                which = phrases.items[np.repeat(phrases.item_first[pairs[:, 1]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
                both = np.unique(np.stack((np.repeat(pairs[:, 0], sizes), which), axis=1), axis=0)
                for d, i in both.tolist():
                    if phrases.item_ids[i] is not None:
                        items[d].append(str(phrases.item_ids[i]))
            lists = []
            hits = np.flatnonzero(hit)
            cut = np.searchsorted(hits, firsts)
            base = np.repeat(offsets[:-1], np.diff(cut))
            for value in (starts[hits] - base, ends[hits] - base):
                lists.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(value, pa.int64())))
            columns = [*batch.columns, pa.array(np.diff(firsts)), *lists, pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "n_words", "hit_from", "hit_to", "item_ids"])
        K.trim()

    out = docs.mapInArrow(work, T.StructType([*docs.schema.fields, *T.StructType.fromDDL(_DDL).fields]))
    out._phrases = shared
    return out


def _parts(text: str, window: int, most: int) -> Iterator[str]:
    """A benchmark text, or the parts of a long one, of about `most` bytes, which share words so that every window lies whole in one."""
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) <= most:
        yield text
        return
    spans = [m.span() for m in _WORD.finditer(raw.lower())]
    ends, at = [b for _, b in spans], 0
    while at < len(spans):
        end = max(at + window, bisect_right(ends, spans[at][0] + most))
        yield raw[spans[at][0] : ends[min(end, len(ends)) - 1]].decode("utf-8", "surrogatepass")
        if end >= len(spans):
            return
        at = end - (window - 1)


def _blocks(bench: DataFrame, window: int, block_bytes: int) -> Iterator[list[tuple]]:
    rows, size = [], 0
    for row in bench.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        for part in _parts(row[1], window, block_bytes):
            rows.append((row[0], part))
            size += len(part.encode("utf-8", "surrogatepass"))
            if size >= block_bytes:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


#: The number that rows get while several blocks are searched.
_ROW = "_decontaminated_row"


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """doc_id, text, the columns to carry, n_words, hit_from and hit_to (byte ranges of the hit words, in order), item_ids (sorted as strings)."""
    own, blocks = ["doc_id", "text", *(carry or [])], _blocks(bench, window, block_bytes)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        return _pass(docs.select(*own), phrases_of(first, window) if first else None).withColumn("item_ids", F.array_sort("item_ids"))
    # several blocks: texts are written once, with numbers, and the blocks' hits meet them at the end
    rows = materialize(docs.select(*own).withColumn(_ROW, F.monotonically_increasing_id()), "decontaminate")
    found = None
    for block in chain([first, second], blocks):
        searched = _pass(rows.select(_ROW, "text"), phrases_of(block, window))
        part = searched.where(F.size("hit_from") > 0).select(_ROW, F.arrays_zip("hit_from", "hit_to").alias("hits"), "item_ids")
        part = materialize(part, "decontaminate")
        searched._phrases.destroy()  # the block's hits are written: one block is held at a time
        found = part if found is None else found.unionByName(part)
    once = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    found = found.groupBy(_ROW).agg(once("hits").alias("hits"), once("item_ids").alias("item_ids"))
    low = F.translate(F.coalesce("text", F.lit("")), ascii_uppercase, ascii_lowercase)
    ranges = lambda name: F.coalesce(F.col("hits").getField(name), F.array().cast("array<long>")).alias(name)
    return rows.join(found, _ROW, "left").select(
        *own, F.regexp_count(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")).cast("long").alias("n_words"), ranges("hit_from"), ranges("hit_to"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")
    )


def removal_spans(marked: DataFrame) -> DataFrame:
    """marked with spans: byte ranges of the runs of hit words that no other word parts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, start, end in zip(batch.column("text").cast(pa.binary()), batch.column("hit_from"), batch.column("hit_to"), strict=True):
                raw, spans = text.as_py(), []
                for a, b in zip(start.as_py(), end.as_py(), strict=True):
                    if spans and not _WORD.search(raw[spans[-1][1] : a].lower()):
                        spans[-1][1] = b
                    else:
                        spans.append([a, b])
                at, out = 0, []
                for a, b in spans:
                    out.append(raw[at:a])
                    at = b
                kept.append(None if raw is None else b"".join([*out, raw[at:]]).decode("utf-8", "replace"))
            yield batch.append_column("clean_text", pa.array(kept, pa.string()))
        K.trim()

    return marked.mapInArrow(work, T.StructType([*marked.schema.fields, T.StructField("clean_text", T.StringType())]))


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contamination of every document with every benchmark item."""
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.size("hit_from").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP3_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, len(w[i:i + 9]) AS n, array_to_string(w[i:i + 9], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM phrases),
spots AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n)),
found AS (SELECT s.doc_id, s.n, s.i, p.item_id FROM spots s JOIN phrases p ON s.n = p.n AND s.p = p.p),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM found WHERE item_id IS NOT NULL GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""
