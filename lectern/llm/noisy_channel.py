"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Words that may be disguised (a digit or sign beside a letter, signs alone, a doubled letter, letters parted
by any white space or marks) become lattices: each character may stand for itself, for a letter it imitates, or
for nothing (a separator, a repetition), at a cost.  Viterbi search over pairs of last letters finds
the cheapest readings under a character trigram model.  A separator may part letters of one word or two
words: the search takes what is cheaper, and all that stands between any two separators is looked up.
Restored words join the text's own words.

A lexicon of words and of word beginnings (4 to 6 bytes) is learned from the labels: those that mark
toxic documents of different make with high precision.  A document's score is a logistic function of
the evidence of its distinct lexicon entries: each weighs the log-odds that the lower end of its
precision's confidence interval gives, so that an entry seen in a few toxic documents only can't
decide alone.  Trigrams are counted in all texts; lexicon and curve come from a bounded sample of
labelled documents (`Training.max_train` documents, whole texts of `Training.max_bytes` together, none
of over a sixteenth of that); scoring reads whole texts of all documents, however long.  What is
broadcast is bounded.

Nulls: null and empty texts have no words and get the score of no evidence.  Without labelled rows
every score is 0.5; with one class only it is that class's share; of contradicting labels of one
document 1 counts.  Repeated rows are scored each for itself.  Ties: of readings that cost the same the
first in the order of characters stays; a score of exactly 0.5 is predicted 1.  An empty table gives an
empty one.  Extra columns are ignored.

Known bounds: a word parted into pieces of several letters by spaces alone (``id iot``) isn't tried.  A
disguised word whose own characters (repetitions cut to three, parting marks to one) are over half of
`MAX_WORD` may fall between two windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import kernels as K
from lectern.llm.labelled import held_out, sample
from lectern.llm.subwords import segment_sums

#: Letters that signs and digits imitate.
IMITATES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "°": "o", "%": "o", "#": "h",
}
SEPARATORS = " .-_*~'`^/\\,|"
GLUE, GAP = "\x1f", " "  # a separator within a word, and between two; readings have GLUE for both
COST_IMITATES, COST_SEPARATOR, COST_REPEAT = 1.0, 0.2, 0.4
LETTERS = 28  # a-z, 26: a word's edge, 27: any other letter
EDGE, OTHER = 26, 27
MAX_WORD = 64  # characters that are read at once
READINGS = 4
#: Signs of a word without letters, single letters of a run, and bytes of a word beside a run that may belong to it.
ALL_SIGNS, LEAST_RUN, SHORT = 3, 3, 4
PREFIXES = (4, 5, 6)


def letter(c: str) -> int:
    k = ord(c) - 97
    return k if 0 <= k < 26 else OTHER


def trigram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts (28 x 28 x 28, flat) of letter trigrams of the words in lower-case bytes; digits are edges."""
    symbols = np.full(256, EDGE)
    symbols[97:123] = np.arange(26)
    symbols[0xC0:] = OTHER  # the first byte of a longer character stands for it
    row = symbols[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    row = np.insert(row, np.flatnonzero(edge), EDGE)
    row = row[~np.isin(np.insert(data, np.flatnonzero(edge), 0), np.arange(0x80, 0xC0))]
    row = row[np.concatenate(([True], (row[1:] != EDGE) | (row[:-1] != EDGE)))]  # one edge between words
    row = np.concatenate(([EDGE], row, [EDGE]))
    # the trigram (edge, edge, x) stands for a word's first letter
    first = row[1:][(row[:-1] == EDGE) & (row[1:] != EDGE)]
    # none reaches over an edge, so counts of slices add up to those of the whole
    within = np.flatnonzero(row[1:-1] != EDGE)
    out = np.bincount(row[within] * LETTERS * LETTERS + row[within + 1] * LETTERS + row[within + 2], minlength=LETTERS**3)
    return out + np.bincount(EDGE * LETTERS * LETTERS + EDGE * LETTERS + first, minlength=LETTERS**3)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Costs (negative logarithms) of a letter after two letters, smoothed by shorter contexts."""
    c3 = counts.reshape(LETTERS, LETTERS, LETTERS).astype(np.float64)
    c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
    p1 = (c1 + 1) / (c1.sum() + LETTERS)
    p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
    return -np.log((c3 + 5 * p2) / (c3.sum(axis=2, keepdims=True) + 5))


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each character of a lower-case word what it may stand for ('' for nothing, GLUE and GAP for a separator), with costs."""
    out: list[list[tuple[str, float]]] = []
    for i, c in enumerate(word):
        ways: list[tuple[str, float]] = []
        if c.isalpha():
            ways.append((c, 0.0))
            if i and word[i - 1] == c:
                ways.append(("", COST_REPEAT))
        else:
            ways += [(x, COST_IMITATES) for x in IMITATES.get(c, "")]
            if c in SEPARATORS or not ways:
                ways += [(GLUE, COST_SEPARATOR), (GAP, COST_SEPARATOR)]
            elif i in (0, len(word) - 1) and not c.isdigit():
                ways.append(("", COST_SEPARATOR))
            elif i and word[i - 1] == c:
                ways.append(("", COST_REPEAT))
        out.append(ways)
    return out


def readings(word: str, costs: np.ndarray, most: int = READINGS) -> list[str]:
    """The cheapest readings of a disguised word, best first, with GLUE for separators: Viterbi search with `most` paths per state."""
    states: dict[tuple[int, int], list[tuple[float, str]]] = {(EDGE, EDGE): [(0.0, "")]}
    for ways in lattice(word):
        ahead: dict[tuple[int, int], list[tuple[float, str]]] = {}
        for (a, b), paths in states.items():
            for c, fee in ways:
                key = (a, b)
                if c == GAP:
                    if b == EDGE:  # no word to end
                        continue
                    key, fee, c = (EDGE, EDGE), fee + costs[a, b, EDGE], GLUE
                elif c and c != GLUE:
                    k = letter(c)
                    key, fee = (b, k), fee + costs[a, b, k]
                ahead.setdefault(key, []).extend((cost + fee, text + c) for cost, text in paths)
        states = {}
        for key, paths in ahead.items():
            best: dict[str, float] = {}
            for cost, text in sorted(paths)[: 4 * most]:
                best.setdefault(text, cost)
            states[key] = [(cost, text) for text, cost in list(best.items())[:most]]
    ends = sorted((cost + (costs[a, b, EDGE] if b != EDGE else 0.0), text) for (a, b), paths in states.items() for cost, text in paths)
    return list(dict.fromkeys(text for _, text in ends if text.strip(GLUE)))[:most]


def restore(word: str, costs: np.ndarray, most: int = READINGS) -> list[str]:
    """The cheapest readings of a disguised word as one word each, best first."""
    return list(dict.fromkeys(text.replace(GLUE, "") for text in readings(word, costs, most)))


_AGAIN = re.compile(r"(.)\1{3,}", re.DOTALL)
_PARTING = rf"(?:[^\w{re.escape(''.join(IMITATES))}]|_)"  # characters that only part letters
_PARTINGS = re.compile(rf"({_PARTING}){_PARTING}+")
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[0x80:] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True
_DISGUISE = _DIGIT.copy()
_DISGUISE[[*b"@$!|+(<%#"]] = True
_MARK = ~(_LETTER | _DISGUISE)
_WIDE_SIGNS = [c.encode() for c in IMITATES if not c.isascii()]


def _signs(low: np.ndarray) -> np.ndarray:
    """Which bytes are signs, or the first byte of one, that imitate letters."""
    out = _DISGUISE[low]
    for sign in _WIDE_SIGNS:
        at = np.flatnonzero(low[: max(0, len(low) - len(sign) + 1)] == sign[0])
        for k in range(1, len(sign)):
            at = at[low[at + k] == sign[k]]
        out[at] = True
    return out


def _twice(low: np.ndarray) -> np.ndarray:
    """Where a letter of one to four bytes begins that also stands before."""
    out = np.zeros(len(low), dtype=bool)
    for n, (first, end) in enumerate(((0x61, 0x7B), (0xC2, 0xE0), (0xE0, 0xF0), (0xF0, 0xF5)), 1):
        row = low[: max(0, len(low) - 2 * n + 1)]
        at = np.flatnonzero((row >= first) & (row < end))
        for k in range(n):
            at = at[low[at + k] == low[at + n + k]]
        out[at + n] = True
    return out


def disguised(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Document numbers and texts (lower case) of what may be disguised words: tokens, and runs of single letters with a short word on either side."""
    starts, ends, firsts = K.word_bounds(low, offsets, K.TEXT_WORD)
    if not len(starts):
        return np.zeros(0, np.int64), []
    sums = lambda mask: (lambda c: c[ends] - c[starts])(np.concatenate(([0], np.cumsum(mask))))
    is_letter, is_sign, size = _LETTER[low], _signs(low), ends - starts
    letters, signs = sums(is_letter), sums(is_sign)
    last = low[ends - 1]
    ending = _DISGUISE[last] & ~_DIGIT[last]  # one sign that ends a word is no disguise
    twice = _twice(low)
    twice[starts] = False
    # marks with a letter or sign of their word on both sides
    solid = np.concatenate(([0], np.cumsum(is_letter | is_sign)))
    mark = np.flatnonzero(_MARK[low])
    word = np.searchsorted(starts, mark, side="right") - 1
    mark, word = mark[word >= 0], word[word >= 0]
    inner = np.zeros(len(starts), dtype=bool)
    inner[word[(mark < ends[word]) & (solid[mark] > solid[starts[word]]) & (solid[ends[word]] > solid[mark])]] = True
    alone = ((letters == 1) | (signs == 1)) & (size <= 2)
    odd = (letters >= 1) & ((signs - ending >= 1) | inner | (sums(twice) > 0)) & ~alone
    odd |= (letters == 0) & (signs >= ALL_SIGNS) & (signs > sums(_DIGIT[low])) & ~alone  # words without any plain letter, numbers left out
    doc = K.owner(firsts)
    raw = low.tobytes()
    where = np.flatnonzero(odd)
    docs, texts = [doc[where]], [raw[a:b].decode("utf-8", "ignore") for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
    # runs of single letters or signs within a document, any white space and tokens of marks alone between them
    linked = alone | ((letters == 0) & (signs == 0) & (size <= 2))
    joined = linked[1:] & linked[:-1] & (doc[1:] == doc[:-1])
    opens, closes = K.runs(joined)
    singles = np.concatenate(([0], np.cumsum(alone)))
    long = singles[closes + 1] - singles[opens] >= LEAST_RUN
    opens, closes = opens[long], closes[long]
    # a short word on either side may be a part of what is spelled: such runs are read with and without
    short = (letters > 0) & (size <= SHORT)
    before, after = np.maximum(opens - 1, 0), np.minimum(closes + 1, len(starts) - 1)
    first = np.where((before < opens) & short[before] & (doc[before] == doc[opens]), before, opens)
    last = np.where((after > closes) & short[after] & (doc[after] == doc[closes]), after, closes)
    more = (first < opens) | (last > closes)
    for a, b in ((opens, closes), (first[more], last[more])):
        docs.append(doc[a])
        texts += [raw[x:y].decode("utf-8", "ignore") for x, y in zip(starts[a].tolist(), ends[b].tolist(), strict=True)]
    return np.concatenate(docs), texts


def entries(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, longest: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of words and of their beginnings (those of the words in longest, if given), with the indexes of the words they are of."""
    prefix = K.prefix_hash(K.BYTE_VALUE[data])
    every = np.arange(len(starts))
    yield K.range_hash(prefix, starts, ends), every
    longest = every if longest is None else longest
    for n in PREFIXES:
        some = longest[(ends - starts)[longest] > n]
        yield K.mix64(K.range_hash(prefix, starts[some], starts[some] + n) + np.uint64(n)), some


def squeezed(word: str) -> str:
    """The word with at most three of a character in a row, and one of characters that only part letters.

    Leaving out a repetition costs the same for each, and so does passing over a separator (of several in a
    row one may end a word at most), so the order of readings doesn't change.
    """
    return _AGAIN.sub(r"\1\1\1", _PARTINGS.sub(r"\1", word))


def pieces(word: str) -> list[str]:
    """What of a disguised word is read at once: long ones in overlapping windows, so that half a window lies whole in one."""
    word = squeezed(word)
    return [word[at : at + MAX_WORD] for at in range(0, max(1, len(word) - MAX_WORD // 2), MAX_WORD // 2)]


class Memo(dict):
    """Entry hashes of the readings of disguised words (only those that are in `known`, if given), forgotten when there are too many."""

    def __init__(self, costs: np.ndarray, known: np.ndarray | None = None) -> None:
        super().__init__()
        self.costs, self.known, self.size = costs, known, 0

    def look_up(self, words: list[str]) -> list[np.ndarray]:
        if len(self) > 100_000 or self.size > 1 << 22:
            self.clear()
            self.size = 0
        new = [w for w in dict.fromkeys(words) if w not in self]
        for at in range(0, len(new), 1024):
            self._read(new[at : at + 1024])
        return [self[w] for w in words]

    def _read(self, words: list[str]) -> None:
        data, starts, ends, longest, owner, base = [], [], [], [], [], 0
        for k, word in enumerate(words):
            for reading in dict.fromkeys(r for piece in pieces(word) for r in readings(piece, self.costs)):
                parts = [p.encode() for p in reading.split(GLUE) if p]
                cuts = [base, *(base + x for x in accumulate(map(len, parts)))]
                for i, a in enumerate(cuts[:-1]):
                    starts += [a] * (len(cuts) - 1 - i)
                    ends += cuts[i + 1 :]
                    longest.append(len(ends) - 1)
                owner += [k] * (len(starts) - len(owner))
                data += parts
                base = cuts[-1]
        whole = np.frombuffer(b"".join(data), np.uint8)
        of = np.array(owner, np.int64)
        found = [(h, of[w]) for h, w in entries(whole, np.array(starts, np.int64), np.array(ends, np.int64), np.array(longest, np.int64))]
        hashes, of = (np.concatenate(x) for x in zip(*found, strict=True))
        if self.known is not None:
            at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            hit = self.known[at] == hashes
            hashes, of = hashes[hit], of[hit]
        order = np.argsort(of, kind="stable")
        cut = np.searchsorted(of[order], np.arange(len(words) + 1))
        for k, word in enumerate(words):
            self[word] = np.unique(hashes[order[cut[k] : cut[k + 1]]]) if cut[k] < cut[k + 1] else _NONE
            self.size += len(self[word])


_NONE = np.zeros(0, np.uint64)


def evidence(low: np.ndarray, offsets: np.ndarray, memo: Memo) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Entry hashes and their documents, of the words as they stand and of restored ones."""
    starts, ends, firsts = K.word_bounds(low, offsets, K.ALNUM_WORD)
    doc = K.owner(firsts)
    for hashes, word in entries(low, starts, ends):
        yield hashes, doc[word]
    docs, texts = disguised(low, offsets)
    if texts:
        read = memo.look_up(texts)
        sizes = np.array([len(r) for r in read])
        yield np.concatenate([r for r in read if len(r)] or [_NONE]), np.repeat(docs, sizes)


@dataclass(frozen=True)
class Training:
    max_train: int = 5000
    max_bytes: int = 16 << 20
    support: int = 6
    precision: float = 0.85


@dataclass
class Model:
    costs: np.ndarray
    hashes: np.ndarray  # of the lexicon, sorted
    weights: np.ndarray
    slope: float
    bias: float


_MOST = 6.0


def trigram_totals(docs: DataFrame) -> np.ndarray:
    """Letter trigram counts of all texts: at most 28**3 sums from a task, added up in an aggregate."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, dtype=np.int64)
        for _, data, offsets in K.slices(batches):
            total += trigram_counts(K.LOWER[data], offsets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["trigram", "n"])

    out = np.zeros(LETTERS**3, dtype=np.int64)
    for r in docs.select("text").mapInArrow(work, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n")).collect():
        out[r.trigram] = r.n
    return out


def _evident(rows: DataFrame, costs: np.ndarray) -> DataFrame:
    """y and the distinct entry hashes of each sampled document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(costs)
        for batch, data, offsets in K.slices(batches):
            pairs = list(evidence(K.LOWER[data], offsets, memo))
            hashes, doc = (np.concatenate(x) for x in zip(*pairs, strict=True))
            order = np.argsort(doc, kind="stable")
            cut = np.searchsorted(doc[order], np.arange(batch.num_rows + 1))
            own = [np.unique(hashes[order[cut[d] : cut[d + 1]]]).tobytes() for d in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(own, pa.binary())], names=["doc_id", "y", "hashes"])

    return rows.mapInArrow(work, "doc_id long, y int, hashes binary")


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic curve by Newton steps with a small ridge."""
    w = np.zeros(2)
    rows = np.stack((x, np.ones_like(x)), axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        step = np.linalg.solve(rows.T @ (rows * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), rows.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def sure_precision(hits: np.ndarray, n: np.ndarray, z: float = 1.96) -> np.ndarray:
    """The lower end of the Wilson interval of hits out of n."""
    p = hits / n
    return (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def train(documents: list[tuple[int, bytes]], costs: np.ndarray, how: Training) -> Model:
    """The lexicon and the score's curve from (y, entry hashes) of sampled documents."""
    none = np.zeros(0, np.uint64)
    y = np.array([d[0] for d in documents], dtype=np.int64)
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        edge = min(max(share, 1e-6), 1 - 1e-6)
        return Model(costs, none, np.zeros(0), 0.0, float(np.log(edge / (1 - edge))))
    hashes = [np.frombuffer(h, np.uint64) for _, h in documents]
    toxic = [h for h, v in zip(hashes, y, strict=True) if v]
    some, counts = np.unique(np.concatenate(toxic), return_counts=True)
    some, counts = some[counts >= how.support], counts[counts >= how.support]
    clean = np.zeros(len(some), dtype=np.int64)
    for h, v in zip(hashes, y, strict=True):
        if not v:
            clean[np.searchsorted(some, np.intersect1d(some, h, assume_unique=True))] += 1
    # copies of a document prove a word once: they have the same smallest hash
    makes: list[set[int]] = [set() for _ in some]
    for h in toxic:
        if len(h):
            sign = int(K.mix64(h).min())
            for k in np.searchsorted(some, np.intersect1d(some, h, assume_unique=True)).tolist():
                makes[k].add(sign)
    support = np.array([len(m) for m in makes], dtype=np.int64)
    good = (support >= how.support) & (support >= how.precision * (support + clean))
    lexicon, sure = some[good], sure_precision(support[good], support[good] + clean[good])
    weights = np.clip(np.log(sure / (1 - sure) * (1 - share) / share), 0.0, _MOST)
    x = np.array([min(_MOST, weights[np.searchsorted(lexicon, np.intersect1d(lexicon, h, assume_unique=True))].sum()) for h in hashes])
    slope, bias = _logistic(x, y.astype(np.float64))
    return Model(costs, lexicon, weights, max(slope, 0.0), bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", how: Training | None = None) -> Model:
    """The language model from all texts, lexicon and curve from a bounded sample; the executors read the texts."""
    how = how or Training()
    rows = sample(docs, labels, label, how.max_train, how.max_bytes)
    costs = language_model(trigram_totals(docs))
    found = _evident(rows, costs).collect()
    found.sort(key=lambda r: (r.doc_id, r.y, bytes(r.hashes)))
    return train([(r.y, bytes(r.hashes)) for r in found], costs, how)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        memo, n = Memo(model.costs, model.hashes), len(model.hashes)
        for batch, data, offsets in K.slices(batches):
            docs_, hits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            if n:
                for hashes, doc in evidence(K.LOWER[data], offsets, memo):
                    at = np.minimum(np.searchsorted(model.hashes, hashes), n - 1)
                    same = model.hashes[at] == hashes
                    docs_.append(doc[same])
                    hits.append(at[same])
            pairs = np.unique(np.concatenate(docs_) * max(n, 1) + np.concatenate(hits))
            doc, hit = pairs // max(n, 1), pairs % max(n, 1)
            total = segment_sums(model.weights[hit], np.searchsorted(doc, np.arange(batch.num_rows + 1)))
            logit = model.slope * np.minimum(total, _MOST) + model.bias
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(1 / (1 + np.exp(-logit)), 9))], names=["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, score double")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
