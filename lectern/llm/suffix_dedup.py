"""Suffix-array dedup of bytes: repeats of `WINDOW` bytes from documents with a smaller id.

Anchors are minimizers: of each window of 50 bytes the 16-byte string with the least hash, so equal
windows have equal anchors at equal places.  Hashes only decide what has to be compared.  Wherever an
anchor stands in several documents, its contexts go, as bytes, to the task that holds all of them.
There every different context stands once, with its smallest id, and the windows of all, which are
suffixes of the contexts cut at 50 bytes, are sorted deep-shallow: a multikey quicksort on characters
of eight bytes orders them to a depth of 16; groups that are still equal there are small sets of long
common prefixes, which blind tries order (sets of two are compared at once).  Windows that end up in
one class are equal byte for byte, and each learns the smallest id of its class.  So each byte that is
removed stands in a window whose bytes were found equal, by the sort, or because its whole context is
byte for byte a context that was sorted (or, within a slice, a context of a smaller id).

An anchor with over `spread_over` contexts (the edge of a passage that very many documents share) sends
its windows each for itself, dealt out by window, so that they are spread over tasks; they are
sorted in the same way.

Nulls: a null or empty text has no bytes and the SHA-256 of nothing.  Texts of fewer than 50 bytes
stay whole.  Rows that repeat a doc_id are each compared with smaller ids only.  Removal can cut a
character of several bytes, so kept texts are bytes.  A text longer than a slice is a slice of its own,
in which anchors are found piece by piece.  Ties: of equal windows those of the smallest id stay, in every
row that has it.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import kernels as K
from lectern.llm.repeats import SPREAD_OVER, Anchors, Slice, Units, dedup, ranges

WINDOW = 50
GRAM = 16
SHALLOW = 16
#: Windows whose anchors are found at once; places in a piece, and 49 bytes more, fit in 24 bits.
PIECE = 1 << 20


class Bytes(Units):
    window = WINDOW

    def load(self, part: Slice) -> None:
        self.text, self.firsts, self.n = part.data, part.offsets, len(part.data)
        self.prefix = K.prefix_hash(K.BYTE_VALUE[part.data])

    def _least(self) -> np.ndarray:
        """For each window the place of its 16-byte string with the least hash (its first 40 bits; the first of equals)."""
        windows, width = self.n - WINDOW + 1, WINDOW - GRAM + 1
        _, down = K.powers(len(self.prefix))
        out, low = np.empty(windows, np.int64), np.uint64(24)
        for lo in range(0, windows, PIECE):
            n = min(PIECE, windows - lo)
            m = n + width - 1
            grams = K.mix64((self.prefix[lo + GRAM : lo + GRAM + m] - self.prefix[lo : lo + m]) * down[lo : lo + m])
            least, span = (grams >> low << low) | np.arange(m, dtype=np.uint64), 1
            while span * 2 <= width:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            least = np.minimum(least[:n], least[width - span : width - span + n])
            out[lo : lo + n] = (least & np.uint64((1 << 24) - 1)).astype(np.int64) + lo
        return out

    def anchors(self) -> Anchors:
        none = np.zeros(0, np.int64)
        if self.n < WINDOW:
            return Anchors(none.astype(np.uint64), none.astype(np.uint64), none, none, none)
        own = self._least()
        # windows within a document; those of one anchor are neighbours
        inside = np.ones(len(own), dtype=bool)
        for end in self.firsts[1:-1].tolist():
            inside[max(0, end - WINDOW + 1) : end] = False
        places = np.flatnonzero(inside)
        own = own[places]
        new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else none
        first, at = places[new], own[new]
        last = places[np.append(new[1:], len(own)) - 1] if len(own) else none
        doc = np.searchsorted(self.firsts, first, side="right") - 1
        context = K.mix64(K.range_hash(self.prefix, first, last + WINDOW) + np.uint64(3) * (at - first).astype(np.uint64))
        return Anchors(K.range_hash(self.prefix, at, at + GRAM), context, doc, first, last)

    def context_bytes(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return first, last + WINDOW - first

    def window_hashes(self, at: np.ndarray) -> np.ndarray:
        return K.range_hash(self.prefix, at, at + WINDOW)

    @staticmethod
    def classes(text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        windows = size - WINDOW + 1
        return deep_shallow(text, ranges(begin, windows)), windows


def _characters(eight: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place, first byte highest."""
    return eight[at].astype(np.uint64)


def multikey_sort(eight: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes by their first `depth` bytes, and group numbers of what is equal so far.

    A multikey quicksort whose characters are eight bytes: each level sorts, by the next character,
    only suffixes that stand in a group of several.
    """
    order = np.arange(len(at))
    group = np.zeros(len(at), np.int64)  # of each place in the order
    for level in range(0, depth, 8):
        size = np.bincount(group, minlength=1)
        open_ = np.flatnonzero(size[group] > 1)
        if not len(open_):
            break
        key = _characters(eight, at[order[open_]] + level)
        way = np.lexsort((key, group[open_])) if level else np.argsort(key, kind="stable")  # groups stay in place
        order[open_] = order[open_][way]
        value = np.zeros(len(at), np.uint64)
        value[open_] = key[way]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (value[1:] != value[:-1])))
        group = np.cumsum(new) - 1
    return order, group


class _Node:
    __slots__ = ("depth", "ways", "members")

    def __init__(self, depth: int, members: list[int] | None = None) -> None:
        self.depth, self.ways, self.members = depth, {}, members


def blind_trie(texts: list[bytes]) -> list[list[int]]:
    """Classes of equal texts of one length, in order.

    A blind (Patricia) trie keeps only the depths at which texts part and the bytes there.  A text goes
    down unread to some leaf, is compared with that leaf's text once, and joins where they part.
    """
    n = len(texts[0])
    root = _Node(n, [0])
    numbers = [int.from_bytes(t, "big") for t in texts]
    for i in range(1, len(texts)):
        node, text = root, texts[i]
        while node.members is None:
            node = node.ways.get(text[node.depth]) or next(iter(node.ways.values()))
        differ = numbers[i] ^ numbers[node.members[0]]
        if not differ:
            node.members.append(i)
            continue
        part = n - (differ.bit_length() + 7) // 8
        other = texts[node.members[0]][part]
        above, node = None, root
        while node.members is None and node.depth < part:
            above, node = node, node.ways[text[node.depth]]
        if node.members is None and node.depth == part:
            node.ways[text[part]] = _Node(n, [i])
            continue
        fork = _Node(part)
        fork.ways = {other: node, text[part]: _Node(n, [i])}
        if above is None:
            root = fork
        else:
            above.ways[text[above.depth]] = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.members is not None:
            out.append(node.members)
        else:
            stack += [node.ways[b] for b in sorted(node.ways, reverse=True)]
    return out


def deep_shallow(data: np.ndarray, at: np.ndarray, length: int = WINDOW, shallow: int = SHALLOW) -> np.ndarray:
    """Class numbers of the strings of `length` bytes at these places, in the strings' order."""
    data = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = K.eights(data)
    order, group = multikey_sort(eight, at, shallow)
    if not len(order):
        return np.zeros(0, np.int64)
    firsts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    size = np.diff(firsts)
    rank = np.zeros(len(at), np.int64)  # within its group, by place in the order
    two = firsts[:-1][size == 2]
    a, b = at[order[two]], at[order[two + 1]]
    verdict, open_ = np.zeros(len(two), np.int8), np.ones(len(two), bool)  # 0: equal, 1 or -1: which is larger
    for level in range(shallow, length, 8):
        ka, kb = (_characters(eight, np.minimum(x + level, len(eight) - 1)) for x in (a, b))
        if length - level < 8:
            cut = np.uint64(8 * (8 - (length - level)))
            ka, kb = ka >> cut, kb >> cut
        new = np.where(ka > kb, -1, np.where(ka < kb, 1, 0))
        verdict = np.where(open_, new, verdict)
        open_ &= new == 0
    rank[two[verdict == -1]] = 1
    rank[two[verdict == 1] + 1] = 1
    raw = data.tobytes()
    for k in np.flatnonzero(size > 2).tolist():
        lo, hi = int(firsts[k]), int(firsts[k + 1])
        texts = [raw[p + shallow : p + length] for p in at[order[lo:hi]].tolist()]
        for number, members in enumerate(blind_trie(texts)):
            for m in members:
                rank[lo + m] = number
    # classes in the order of (group, rank)
    way = np.lexsort((rank, group))
    g, r = group[way], rank[way]
    out = np.empty(len(at), np.int64)
    out[order[way]] = np.cumsum(np.concatenate(([True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])))) - 1
    return out


def _cut(units: Bytes, part: Slice, repeat: np.ndarray) -> pa.RecordBatch:
    where = np.flatnonzero(repeat)
    gone = K.covered(units.n, where, where + WINDOW)
    kept, removed, spans = [], [], []
    for a, b in zip(units.firsts[:-1].tolist(), units.firsts[1:].tolist(), strict=True):
        own = gone[a:b]
        removed.append(int(own.sum()))
        spans.append(len(K.runs(own)[0]))
        kept.append(part.data[a:b][~own].tobytes())
    ids = pa.array(part.ids, mask=part.null.astype(bool))
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(units.firsts)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup_bytes(docs: DataFrame, spread_over: int = SPREAD_OVER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) of every row."""
    return dedup(docs, Bytes, _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", spread_over)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes of all documents that repeat in strings of 50 from smaller ids."""
    found = dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = """
WITH doc AS (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
windows AS (SELECT doc_id, i, md5_number(b[i + 1:i + 50]) AS k FROM (SELECT doc_id, b, unnest(range(0, n - 49)) AS i FROM doc WHERE n >= 50)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM windows) WHERE first < doc_id),
marked AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM again),
runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (
    SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked)
  GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
kept AS (
  SELECT g.doc_id, string_agg(hex(b[before + 1:a]), '' ORDER BY a) AS head, max(z) AS tail, sum(z - a) AS n_removed, count(*) AS n_spans
  FROM gaps g JOIN doc USING (doc_id) GROUP BY g.doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || hex(b[coalesce(tail, 0) + 1:n]))) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""
