"""TF-IDF per collection as relations: vocabulary, weights, and cosine scores by an inverted-index join.

A text's terms are counted where it is read (`term_counts`), so that counting needs no shuffle. Small
collections are weighed as a whole (`index_terms`); of large ones the counts are written once and serve the
vocabulary and the weights.

Unigrams and bigrams of tokens of two word characters or more, lower case; stop words go before bigrams
are formed.  tf = 1 + ln(count), idf = ln((1 + n) / (1 + df)) + 1, rows of unit length.  The vocabulary
keeps the most frequent terms of a collection (ties by term).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.config import DEFAULT, Settings
from lectern.operators.vectors import _structs
from lectern.plans.storage import LONG_ROWS, materialize, merged

#: Word characters are letters, numbers and the underscore in every alphabet: the same as [\\p{L}\\p{N}_].
_TOKEN = re.compile(r"\w\w+")

#: The default stop list: English function words. Another one can be given wherever this is used.
STOP_WORDS = tuple(
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from "
    "further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own same she "
    "should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your".split()
)


#: Collections with more terms than the cap are ranked in so many parts first.
RANK_PARTS = 64
#: Texts whose terms are counted before they are handed on, and characters of whole collections that are.
BATCH_ROWS, BLOCK_CHARS = 1024, 1 << 19
#: Terms that a task's summaries hold before they go out.
MOST_HELD = 2_000_000
#: Characters up to which a collection is weighed as a whole.
TOGETHER_CHARS = 1 << 20


def terms(text: str | None, stop_words: frozenset[str] = frozenset(STOP_WORDS)) -> list[str]:
    """Unigrams and bigrams of a text, as often as they occur."""
    tokens = [t for t in _TOKEN.findall((text or "").lower()) if t not in stop_words]
    return tokens + [f"{a} {b}" for a, b in pairwise(tokens)]


def term_counts(texts: DataFrame, by: list[str], text: str, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """by columns (which tell rows apart), term, n, head: how often each term of a text occurs; head marks a text's first row.

    A text without terms has one row, without a term. Counted batch by batch in Arrow, since native lambdas
    over arrays of tokens are interpreted, and handed on flat, since nested rows take longer to copy than to count.
    """
    kinds = T.StructType([*(texts.schema[c] for c in by), *T.StructType.fromDDL("term string, n long, head boolean").fields])
    return texts.select(*by, F.col(text).alias("_text")).mapInArrow(_counter(by, stop_words), kinds)


def _counter(by: list[str], stop_words: tuple[str, ...], kb: str | None = None):
    """The work of `term_counts`; with `kb` its rows are packed (`_runs`), and no text is in two of them."""
    stop = frozenset(stop_words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                found = [Counter(terms(x, stop)) or {None: 0} for x in part.column("_text").to_pylist()]
                sizes = np.array([len(c) for c in found])
                head = np.zeros(int(sizes.sum()), dtype=bool)
                head[np.cumsum(sizes) - sizes] = True
                who = pa.array(np.repeat(np.arange(part.num_rows), sizes))
                own = [pa.array([x for c in found for x in c], pa.string()), pa.array([n for c in found for n in c.values()], pa.int64()), pa.array(head)]
                made = pa.RecordBatch.from_arrays([*(part.column(c).take(who) for c in by), *own], names=[*by, "term", "n", "head"])
                yield _runs(made, kb) if kb else made

    return work


def _runs(batch: pa.RecordBatch, kb: str) -> pa.RecordBatch:
    """kb and arrays of the other columns: a row for each stretch of a collection's rows."""
    n, keys = batch.num_rows, batch.column(kb)
    same = pc.fill_null(pc.equal(keys.slice(1), keys.slice(0, max(0, n - 1))), False).to_numpy(zero_copy_only=False).astype(bool)
    starts = np.concatenate(([0], np.flatnonzero(~same) + 1)) if n else np.zeros(0, np.int64)
    ends = pa.array(np.append(starts, n).astype(np.int32))
    return pa.RecordBatch.from_arrays([keys.take(pa.array(starts)), *(pa.ListArray.from_arrays(ends, batch.column(c)) for c in batch.schema.names if c != kb)], names=[kb, *(c for c in batch.schema.names if c != kb)])


def _arrays(schema: T.StructType, kb: str) -> T.StructType:
    return T.StructType([schema[kb], *(T.StructField(f.name, T.ArrayType(f.dataType)) for f in schema if f.name != kb)])


def packed(rows: DataFrame, kb: str = "kb_id") -> DataFrame:
    """kb and arrays of the other columns, for each stretch of a collection's rows in a batch: a shuffle of these is a fraction of one of the rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _runs(batch, kb)

    return rows.mapInArrow(work, _arrays(rows.schema, kb))


def unpacked(runs: DataFrame, kb: str = "kb_id") -> DataFrame:
    """The rows that `packed` packed."""
    return runs.select(kb, F.inline(F.arrays_zip(*(c for c in runs.columns if c != kb))))


def _found(counts: DataFrame, by: list[str]) -> DataFrame:
    """by columns, term, n."""
    return counts.where("term IS NOT NULL").select(*by, "term", "n")


def vocabulary(counts: DataFrame, cfg: Settings = DEFAULT, kb: str = "kb_id", summary: int | None = None) -> DataFrame:
    """kb_id, term, df, cf, idf of the terms a collection keeps, from the counts (best written before) of its chunks.

    Collections of no more terms than the cap keep all. Of others every task keeps a summary of its frequent
    terms (`_summaries`, of `summary` terms, sixteen times the cap unless given). Together the summaries name the
    terms that can be among the most frequent, and only these are counted exactly, so the many rare terms aren't
    shuffled. Where the summaries can't tell (the cap reaches terms as rare as what they have dropped), all terms
    are counted and ranked: in parts by hash first, each of which keeps `max_features` terms, then the parts'
    terms together, so that no task sorts a collection.
    """
    every = lambda rows: _found(rows, [kb]).groupBy(kb, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf"))
    sizes = materialize(counts.groupBy(kb).agg(F.count(F.when(F.col("head"), 1)).alias("n_chunks"), F.count("term").alias("most")), "tfidf-sizes")
    idf = F.log((1 + F.col("n_chunks")) / (1 + F.col("df"))) + 1
    large = sizes.where(F.col("most") > cfg.max_features).select(kb)
    if large.isEmpty():
        return every(counts).join(sizes, kb).select(kb, "term", "df", "cf", idf.alias("idf"))
    kept = every(counts.join(large, kb, "left_anti"))
    some = counts.join(large, kb, "left_semi")
    likely = materialize(candidates(some, cfg.max_features, summary or 16 * cfg.max_features, kb), "likely-terms")
    told = materialize(likely.select(kb).distinct(), "told")
    sure = every(_found(some, [kb]).join(likely, [kb, "term"], "left_semi"))
    rest = every(some.join(told, kb, "left_anti"))
    part = F.pmod(F.xxhash64("term"), F.lit(RANK_PARTS)).alias("part")
    order = [F.col("cf").desc(), F.col("term")]
    ranked = sure.unionByName(rest).select("*", part)
    for keys in ([kb, "part"], [kb]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= cfg.max_features).drop("rank")
    return kept.unionByName(ranked.drop("part")).join(sizes, kb).select(kb, "term", "df", "cf", idf.alias("idf"))


def candidates(counts: DataFrame, most: int, summary: int, kb: str = "kb_id") -> DataFrame:
    """kb_id, term: all terms that can be among the `most` most frequent of a collection; no row for collections that summaries can't tell about.

    A summary's count of a term is too small by at most what the summary has dropped. So is the sum over summaries
    by the sum of what they dropped: a term that is in none has no more occurrences than that. If the `most`-th
    largest sum is above it, all terms that reach that sum at best are candidates, and no others are.
    """
    own = materialize(_found(counts, [kb]).mapInArrow(_summaries(kb, summary), T.StructType([counts.schema[kb], *T.StructType.fromDDL("term string, n long, dropped long").fields])), "summaries")
    lost = own.where("term IS NULL").groupBy(kb).agg(F.sum("dropped").alias("lost"))
    sums = own.where("term IS NOT NULL").groupBy(kb, "term").agg(F.sum("n").alias("n"))
    # the most-th largest count, by a table of how many terms have each count
    table = sums.groupBy(kb, "n").agg(F.count(F.lit(1)).alias("terms"))
    above = F.sum("terms").over(Window.partitionBy(kb).orderBy(F.col("n").desc()))
    least = table.withColumn("above", above).where(F.col("above") >= most).groupBy(kb).agg(F.max("n").alias("least")).join(lost, kb, "left").withColumn("lost", F.coalesce("lost", F.lit(0)))
    return sums.join(least.where(F.col("least") > F.col("lost")), kb).where(F.col("n") + F.col("lost") >= F.col("least")).select(kb, "term")


def _summaries(kb: str, most: int):
    """Frequent terms of each collection in a task (Misra-Gries, in batches), and a row without a term that says what was dropped."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, Counter] = {}
        dropped: Counter = Counter()
        total, kind = 0, None

        def cut(key: object) -> None:
            counter = held[key]
            if len(counter) > most:
                least = sorted(counter.values(), reverse=True)[most]
                dropped[key] += least
                held[key] = Counter({t: n - least for t, n in counter.items() if n > least})

        def rows(keys: list) -> pa.RecordBatch:
            flat = [(k, t, n, 0) for k in keys for t, n in held[k].items()] + [(k, None, 0, dropped[k]) for k in keys]
            columns = list(zip(*flat, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=[kb, "term", "n", "dropped"])

        for batch in batches:
            kind = batch.schema.field(kb).type
            for key, term, n in zip(batch.column(kb).to_pylist(), batch.column("term").to_pylist(), batch.column("n").to_pylist(), strict=True):
                counter = held.setdefault(key, Counter())
                if term not in counter:
                    total += 1
                counter[term] += n
                if len(counter) >= 2 * most:
                    total -= len(counter)
                    cut(key)
                    total += len(held[key])
            if total > MOST_HELD:  # many collections in one task: what there is goes out, in several summaries
                for k in held:
                    cut(k)
                yield rows(list(held))
                held.clear()
                dropped.clear()
                total = 0
        for k in held:
            cut(k)
        if held:
            yield rows(list(held))

    return work


def index_terms(chunks: DataFrame, cfg: Settings = DEFAULT, stop_words: tuple[str, ...] = STOP_WORDS, text: str = "embed_text", together: int = TOGETHER_CHARS, asks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Vocabulary (kb_id, term, df, cf, idf) and postings (kb_id, chunk_idx, term, weight) of chunks, written.

    Collections of up to `together` characters, whose terms are few, come to one task as a whole, which counts,
    cuts and weighs them: one shuffle of texts, and no term is joined to its own count. Larger ones go through
    `term_counts`, `vocabulary` and `weights`, which deal their terms out.

    asks (kb_id, question): where these are all that the index is for. Small collections then give rows for the
    terms of their own questions alone, out of the same counts, cut and norms; questions come to their
    collection's task behind its chunks, equal ones once.
    """
    return index_runs(chunks, cfg, stop_words, text, together, asks)[:2]


def index_runs(chunks: DataFrame, cfg: Settings = DEFAULT, stop_words: tuple[str, ...] = STOP_WORDS, text: str = "embed_text", together: int = TOGETHER_CHARS, asks: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vocabulary and postings as `index_terms` gives them, and both as runs (see `folded`)."""
    sizes = materialize(chunks.groupBy("kb_id").agg(F.sum(F.length(text)).alias("_chars")).where(F.col("_chars") > together).select("kb_id"), "large-collections")
    small = chunks if sizes.isEmpty() else chunks.join(sizes, "kb_id", "left_anti")
    rows = small.select("kb_id", "chunk_idx", F.coalesce(F.col(text), F.lit("")).alias("_text"), F.lit(False).alias("_asked"))
    if asks is not None:
        rows = rows.unionByName(asks.select("kb_id", F.lit(0).alias("chunk_idx"), F.col("question").alias("_text"), F.lit(True).alias("_asked")).where("kb_id IS NOT NULL AND _text IS NOT NULL").distinct())
    dealt = rows.repartition("kb_id").sortWithinPartitions("kb_id", "_asked")
    kinds = T.StructType([chunks.schema["kb_id"], *T.StructType.fromDDL(_RUNS).fields])
    runs = materialize(dealt.mapInArrow(_weighed(cfg.max_features, frozenset(stop_words), asks is not None), kinds), "weighed-terms", None, LONG_ROWS)
    vocab, postings = unfolded(runs)
    if sizes.isEmpty():
        return vocab, postings, runs
    counts = materialize(term_counts(chunks.join(sizes, "kb_id", "left_semi"), ["kb_id", "chunk_idx"], text, stop_words), "term-counts")
    rest = materialize(vocabulary(counts, cfg), "vocab")
    weighed = materialize(weights(counts, rest, ["kb_id", "chunk_idx"]), "postings")
    return vocab.unionByName(rest), postings.unionByName(weighed), runs.unionByName(folded(rest, weighed))


#: Columns of runs besides kb_id.
_RUNS = "terms array<string>, df array<long>, cf array<long>, idf array<double>, chunk_idx array<int>, number array<int>, weight array<double>"


def unfolded(runs: DataFrame, kb: str = "kb_id") -> tuple[DataFrame, DataFrame]:
    """Vocabulary and postings of runs, a row for each term."""
    at = lambda column, place: F.get(F.col(column), F.col(place)).alias(column)
    known = runs.where("df IS NOT NULL").select(kb, "df", "cf", "idf", F.posexplode("terms").alias("_at", "term"))
    found = runs.select(kb, "chunk_idx", "terms", "weight", F.posexplode("number").alias("_at", "_n"))
    return known.select(kb, "term", at("df", "_at"), at("cf", "_at"), at("idf", "_at")), found.select(kb, at("chunk_idx", "_at"), F.get("terms", F.col("_n")).alias("term"), at("weight", "_at"))


def folded(vocab: DataFrame, postings: DataFrame, kb: str = "kb_id") -> DataFrame:
    """Both as runs: rows of arrays, so that a table of them is dealt out, merged and copied by collection instead of by term.

    kb, terms, df, cf, idf: terms of a collection. chunk_idx, number, weight: its postings, whose terms are those of the
    row by number. A collection that is weighed as a whole is one row, whose terms are in order. Here rows hold either
    terms or postings; the latter's terms aren't to be known from them, so df, cf and idf are null.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                runs = _runs(batch, kb)
                each = [x.dictionary_encode() for x in (runs.column("term").slice(row, 1).flatten() for row in range(runs.num_rows))]
                ends = pa.array(np.concatenate(([0], np.cumsum([len(x.dictionary) for x in each]))).astype(np.int32))
                number = pa.ListArray.from_arrays(runs.column("term").offsets, pa.concat_arrays([x.indices for x in each]))
                yield pa.RecordBatch.from_arrays([runs.column(kb), pa.ListArray.from_arrays(ends, pa.concat_arrays([x.dictionary for x in each])), runs.column("chunk_idx"), number, runs.column("weight")], names=[kb, "terms", "chunk_idx", "number", "weight"])

    kinds = T.StructType([postings.schema[kb], *(f for f in T.StructType.fromDDL(_RUNS) if f.name not in ("df", "cf", "idf"))])
    found = postings.select(kb, "chunk_idx", "term", "weight").mapInArrow(work, kinds)
    return packed(vocab.select(kb, F.col("term").alias("terms"), "df", "cf", "idf"), kb).unionByName(found, allowMissingColumns=True)


def _weighed(most: int, stop: frozenset[str], some: bool = False):
    """Rows sorted by kb_id, chunks before questions, to the weighed terms of whole collections (runs); with some to those that a question has.

    Collections are worked through some `BLOCK_CHARS` characters at a time. A term is a number: with w tokens in the block
    and one more, the place of its first token among them by bytes, times w, and for two tokens the second one's, from 1. Numbers are in
    the order of terms, since all that tokens are made of comes behind the space.
    """
    dropped = pa.array(sorted(stop), pa.string())

    def block(keys: list, kind: pa.DataType, owner: list[int], at: list[int], texts: list[str], wanted: list[set[str]]) -> pa.RecordBatch | None:
        found = [_TOKEN.findall(x.lower()) for x in texts]
        tokens = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
        names = tokens.dictionary
        order = pc.sort_indices(names)
        names, place = names.take(order), np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        code = place[tokens.indices.to_numpy()]
        keep = ~pc.is_in(names, dropped).to_numpy(zero_copy_only=False)[code]
        code, who = code[keep], np.repeat(np.arange(len(texts)), list(map(len, found)))[keep]
        if not len(code):
            return None
        w = len(names) + 1
        span = w * w
        pair = who[1:] == who[:-1]
        term = np.concatenate((code * w, code[:-1][pair] * w + code[1:][pair] + 1))
        # postings: text, times of the term in it, place among the terms of collections
        mixed, times = np.unique(np.concatenate((who, who[:-1][pair])) * span + term, return_counts=True)
        text, term = np.divmod(mixed, span)
        owners = np.array(owner)
        own, place = np.unique(owners[text] * span + term, return_inverse=True)
        whose, term = np.divmod(own, span)
        df, cf = np.bincount(place, minlength=len(own)), np.bincount(place, weights=times, minlength=len(own)).astype(np.int64)
        idf = np.log((1 + np.bincount(owners, minlength=len(keys))[whose]) / (1 + df)) + 1
        kept = np.ones(len(own), dtype=bool)
        for k in np.flatnonzero(np.bincount(whose) > most):
            mine = np.flatnonzero(whose == k)
            kept[mine[np.lexsort((mine, -cf[mine]))[most:]]] = False
        if not kept.all():
            left = kept[place]
            text, times, place = text[left], times[left], place[left]
        raw = (1 + np.log(times)) * idf[place]
        first = np.flatnonzero(np.diff(text, prepend=-1))
        weight = raw / np.repeat(np.sqrt(np.add.reduceat(raw * raw, first)), np.diff(first, append=len(text)))
        if some:
            asked = [(k, *(t.split(" ") + [None])[:2]) for k, ts in enumerate(wanted) for t in ts]
            a, b = (pc.fill_null(pc.index_in(pa.array([x[k] for x in asked], pa.string()), names), -1).to_numpy() for k in (1, 2))
            there = (a >= 0) & ((b >= 0) | np.array([x[2] is None for x in asked], dtype=bool))
            kept &= np.isin(own, (np.array([x[0] for x in asked], np.int64) * span + a * w + b + 1)[there])
            left = kept[place]
            text, place, weight = text[left], place[left], weight[left]
            if not len(text):
                return None
        term, whose = term[kept], whose[kept]
        n_terms, n_postings = np.bincount(whose, minlength=len(keys)), np.bincount(owners[text], minlength=len(keys))
        rows = np.flatnonzero(n_terms)
        ends = lambda n: pa.array(np.concatenate(([0], np.cumsum(n[rows]))).astype(np.int32))
        of_terms, of_postings = ends(n_terms), ends(n_postings)
        number = (np.cumsum(kept) - 1)[place] - (np.cumsum(n_terms) - n_terms)[owners[text]]
        one, two = np.divmod(term, w)
        one, single = names.take(pa.array(one)), two == 0
        both = pc.binary_join_element_wise(one, names.take(pa.array(np.maximum(two - 1, 0))), " ")
        columns = [(of_terms, pc.if_else(pa.array(single), one, both)), *((of_terms, pa.array(x[kept])) for x in (df, cf, idf))]
        columns += [(of_postings, pa.array(x)) for x in (np.array(at, np.int32)[text], number.astype(np.int32), weight)]
        return pa.RecordBatch.from_arrays([pa.array([keys[k] for k in rows], kind), *(pa.ListArray.from_arrays(*x) for x in columns)], names=["kb_id", "terms", "df", "cf", "idf", "chunk_idx", "number", "weight"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owner, at, texts, wanted, chars, kind = [], [], [], [], [], 0, None
        for batch in batches:
            kind = batch.schema.field("kb_id").type
            for key, chunk_idx, text, asked in zip(*(batch.column(c).to_pylist() for c in ("kb_id", "chunk_idx", "_text", "_asked")), strict=True):
                if not keys or keys[-1] != key:
                    if chars > BLOCK_CHARS:
                        made = block(keys, kind, owner, at, texts, wanted)
                        if made is not None:
                            yield made
                        keys, owner, at, texts, wanted, chars = [], [], [], [], [], 0
                    keys.append(key)
                    wanted.append(set())
                if asked:
                    wanted[-1].update(terms(text, stop))
                else:
                    owner.append(len(keys) - 1)
                    at.append(chunk_idx)
                    texts.append(text)
                chars += len(text)
        made = block(keys, kind, owner, at, texts, wanted) if keys else None
        if made is not None:
            yield made

    return work


def weights(counts: DataFrame, vocab: DataFrame, by: list[str], kb: str = "kb_id") -> DataFrame:
    """by columns (kb_id among them), term, weight; each text's weights have unit length. Unknown terms are ignored."""
    raw = merged(_found(counts, by), vocab.select(kb, "term", "idf"), [kb, "term"]).withColumn("w", (1 + F.log("n")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*by)))
    return raw.select(*by, "term", (F.col("w") / norm).alias("weight"))


def text_weights(texts: DataFrame, by: list[str], text: str, vocab: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS, kb: str = "kb_id", only: DataFrame | None = None) -> DataFrame:
    """The same from the texts themselves, each counted and weighed by one task: packed terms meet their collection's vocabulary by kb.

    A vocabulary is one row, since its terms are capped. only (kb, term): terms whose weights are wanted; others count in the norms alone.
    """
    some_only = only is not None
    columns = [*(c for c in by if c != kb), "term", "n", "head"]
    counted = T.StructType([*(texts.schema[c] for c in by), *T.StructType.fromDDL("term string, n long, head boolean").fields])
    runs = texts.select(*by, F.col(text).alias("_text")).mapInArrow(_counter(by, stop_words, kb), _arrays(counted, kb))
    known = packed(vocab.select(kb, "term", "idf"), kb).groupBy(kb).agg(F.flatten(F.collect_list("term")).alias("_terms"), F.flatten(F.collect_list("idf")).alias("_idf"))
    if some_only:
        known = merged(known, packed(only.select(kb, "term"), kb).groupBy(kb).agg(F.array_distinct(F.flatten(F.collect_list("term"))).alias("_only")), [kb])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (at, names), (v_at, v_names), idf = _structs(batch.column("term")), _structs(batch.column("_terms")), batch.column("_idf").flatten().to_numpy()
            n, head = batch.column("n").flatten().to_numpy(), batch.column("head").flatten().to_numpy(zero_copy_only=False)
            o_at, o_names = _structs(batch.column("_only")) if some_only else (None, None)
            weight, wanted = np.zeros(len(names)), np.zeros(len(names), dtype=bool)
            for row in range(batch.num_rows):
                a, z = at[row], at[row + 1]
                own, vocabulary = names.slice(a, z - a), v_names.slice(v_at[row], v_at[row + 1] - v_at[row])
                place = pc.fill_null(pc.index_in(own, vocabulary, skip_nulls=True), -1).to_numpy()
                hit = np.flatnonzero(place >= 0)
                weight[a + hit] = (1 + np.log(n[a + hit])) * idf[v_at[row] + place[hit]]
                wanted[a + hit] = True
                if some_only:
                    wanted[a:z] &= pc.is_in(own, o_names.slice(o_at[row], o_at[row + 1] - o_at[row]), skip_nulls=True).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(head)
            norm = np.repeat(np.sqrt(np.add.reduceat(weight * weight, first)), np.diff(np.append(first, len(head)))) if len(first) else np.zeros(0)
            some = pa.array(np.flatnonzero(wanted))
            who = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(at))).take(some)
            out = [batch.column(kb).take(who) if c == kb else batch.column(c).flatten().take(some) for c in [*by, "term"]]
            yield pa.RecordBatch.from_arrays([*out, pa.array(weight[wanted] / norm[wanted])], names=[*by, "term", "weight"])

    both = merged(runs, known, [kb]).select(kb, *columns, "_terms", "_idf", *(["_only"] if some_only else []))
    return both.mapInArrow(work, T.StructType([*(texts.schema[c] for c in by), *T.StructType.fromDDL("term string, weight double").fields]))


def cosine(queries: DataFrame, postings: DataFrame, q_by: list[str], p_by: list[str], kb: str = "kb_id") -> DataFrame:
    """Sums of products of weights of equal terms in equal collections; pairs without a common term are absent.

    Both sides meet packed by kb, so that of the postings, which are many, only those that a question has come out as rows.
    """
    q_own, p_own = ([c for c in by if c != kb] for by in (q_by, p_by))
    out = list(dict.fromkeys([*q_by, *p_by]))
    q = packed(queries.select(kb, *(F.col(c).alias(f"_q_{c}") for c in q_own), F.col("term").alias("_q_term"), F.col("weight").alias("_q_weight")), kb)
    both = merged(q, packed(postings.select(kb, *p_own, "term", "weight"), kb), [kb])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (q_at, q_names), (p_at, p_names) = _structs(batch.column("_q_term")), _structs(batch.column("term"))
            found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
            for row in range(batch.num_rows):
                asked = q_names.slice(q_at[row], q_at[row + 1] - q_at[row]).dictionary_encode()
                code = asked.indices.to_numpy()
                order, times = np.argsort(code, kind="stable"), np.bincount(code, minlength=len(asked.dictionary))
                place = pc.fill_null(pc.index_in(p_names.slice(p_at[row], p_at[row + 1] - p_at[row]), asked.dictionary), -1).to_numpy()
                hit = np.flatnonzero(place >= 0)
                many, first = times[place[hit]], (np.cumsum(times) - times)[place[hit]]
                each = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                found.append((q_at[row] + order[np.repeat(first, many) + each], p_at[row] + np.repeat(hit, many), np.full(len(each), row)))
            qs, ps, rows = (np.concatenate(x) for x in zip(*found, strict=True))
            products = batch.column("_q_weight").flatten().to_numpy()[qs] * batch.column("weight").flatten().to_numpy()[ps]
            got = {kb: batch.column(kb).take(pa.array(rows))}
            got |= {c: batch.column(c).flatten().take(pa.array(ps)) for c in p_own} | {c: batch.column(f"_q_{c}").flatten().take(pa.array(qs)) for c in q_own}
            yield pa.RecordBatch.from_arrays([*(got[c] for c in out), pa.array(products)], names=[*out, "product"])

    kinds = {f.name: f for f in [*postings.select(*p_by).schema, *queries.select(*q_by).schema]}
    products = both.mapInArrow(work, T.StructType([*(kinds[c] for c in out), T.StructField("product", T.DoubleType())]))
    return products.groupBy(*out).agg(F.sum("product").alias("cosine"))
