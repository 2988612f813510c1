"""Periodic runs of words by a scan over all lags.

A run is a maximal stretch of words with smallest period q that is at least `least` words and at least
`exponent` times q long.  Words become numbers, and the array of a document is compared with itself
shifted by each lag q up to n // exponent; stretches of equality are measured, and one of L places is
a run of L + q words with period q.  A stretch that a shorter period makes as well is that period's run,
since it has the same ends (two periods of so long a stretch have a common divisor that is one).

Lags go through numpy in blocks.  A run of lag q makes at least ``max(least - q, (exponent - 1) * q)``
equalities in a row, so at every quarter of that length one of them has to show; lags are held against
the array at these places first, all lags of a block at once, and only those that show `PROBES` in a
row are compared in full.  No lag and no place is left out, and texts without runs cost n log n.

Work is cut by document and range of lags.  Texts of up to `whole_bytes` are scanned in the task that
reads them, without a shuffle.  Longer ones are written with a row number, each range of lags goes to a
task of its own with the array of numbers, and the runs come back by row number; a range holds at most
`most_compares` comparisons, should every lag have to be compared in full.

Nulls: a null text has no words, a null id is an id like any other.  Rows are independent of each other,
so repeated rows get equal results.  An empty table gives an empty one.  Runs that overlap are all given,
in order of start and period.  Texts of any length are scanned whole, and by all their lags.  Extra
columns are kept out.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import kernels as K
from lectern.plans.storage import materialize

LEAST, EXPONENT = 24, 3
#: Equal probes in a row that a lag has to show, and comparisons of a block of lags.
PROBES, BLOCK = 4, 1 << 19
#: Bytes up to which a text is scanned where it is read, and comparisons of a range of lags of longer ones.
WHOLE_BYTES, MOST_COMPARES = 900_000, 1 << 36

_RUNS = "array<struct<start:long,length:long,period:long>>"


def _shows(ids: np.ndarray, low: int, high: int, step: int, probes: int) -> np.ndarray:
    """Lags of [low, high) with so many equalities in a row at places 0, step, 2 * step ..."""
    n = len(ids)
    places = -(-(n - low) // step)
    padded = np.concatenate((ids, np.full(high - low + step, -1, ids.dtype)))  # past the end nothing is equal
    width = padded.strides[0]
    shifted = as_strided(padded[low:], shape=(high - low, places), strides=(width, width * step))
    equal = shifted == ids[: places * step : step][:places]
    row = equal[:, : places - probes + 1].copy()
    for k in range(1, probes):
        row &= equal[:, k : places - probes + 1 + k]
    return np.flatnonzero(row.any(axis=1)) + low


def lag_runs(ids: np.ndarray, low: int, high: int, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the stretches of an array of numbers (none negative) that have a lag of [low, high) as a period, not as the smallest one surely."""
    n, out = len(ids), []
    high = min(high, n // exponent + 1)
    need = lambda q: np.maximum(least - q, (exponent - 1) * q)
    q = low
    while q < high:
        # steps for lags up to twice the first, as many as a block holds
        top = min(high, 2 * q)
        shortest = max(1, int(need(np.arange(q, min(top, least + 1) if q < least else q + 1)).min()))
        probes = min(PROBES, shortest)
        step = shortest // probes
        top = min(top, q + max(1, BLOCK // max(1, n // step)))
        if -(-(n - q) // step) >= probes:
            for lag in _shows(ids, q, top, step, probes).tolist():
                starts, ends = K.runs(ids[lag:] == ids[:-lag])
                long = ends - starts >= max(1, need(lag))
                out += [(a, b - a + lag, lag) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True) if b - a + lag >= max(least, exponent * lag)]
        q = top
    return out


def primitive(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of stretches with the same ends that with the smallest period, by start and period."""
    best: dict[tuple[int, int], int] = {}
    for start, length, period in found:
        known = best.get((start, length))
        best[start, length] = period if known is None else min(known, period)
    return sorted(((s, n, p) for (s, n), p in best.items()), key=lambda r: (r[0], r[2]))


def _numbers(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal ones."""
    table: dict[bytes, int] = {}
    return np.fromiter((table.setdefault(w, len(table)) for w in words), np.int32, len(words))


def _words(text: bytes, doc_id, rewrite: Callable | None) -> list[bytes]:
    words = text.split()  # at ASCII white space
    order = rewrite(doc_id, len(words)) if rewrite else None
    return words if order is None else [words[k] for k in order.tolist()]


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside of what runs repeat."""
    if runs:
        starts, ends = np.array([s + q for s, _, q in runs]), np.array([s + n for s, n, _ in runs])
        words = [words[k] for k in np.flatnonzero(~K.covered(len(words), starts, ends)).tolist()]
    return b" ".join(words)


def _result(names: list[pa.Array], n: list[int], runs: list[list], texts: list[bytes]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    packed = pa.array([[{"start": s, "length": z, "period": q} for s, z, q in r] for r in runs], kind)
    return pa.RecordBatch.from_arrays([*names, pa.array(n, pa.int64()), packed, pa.array(texts, pa.binary()).view(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, rewrite: Callable | None = None, whole_bytes: int = WHOLE_BYTES, most_compares: int = MOST_COMPARES) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period), collapsed (the words that no run repeats, joined by one space).

    Words are ``[^\\x20\\x09-\\x0D]+``.  rewrite, if given, takes (doc_id, number of words) and returns the places
    whose words stand in for a document's, or None.
    """
    if least < 1 or exponent < 2:
        raise ValueError("runs have a word at least and an exponent of 2 or more")
    out = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(f"n_words long, runs {_RUNS}, collapsed string").fields])
    text = F.coalesce("text", F.lit(""))
    short = docs.where(F.octet_length(text) <= whole_bytes).select("doc_id", "text").mapInArrow(_scan_whole(least, exponent, rewrite), out)
    spark = docs.sparkSession
    long = materialize(docs.where(F.octet_length(text) > whole_bytes).select("doc_id", "text", F.monotonically_increasing_id().alias("_row")), "long-texts")
    ranges = long.mapInArrow(_lag_ranges(exponent, rewrite, most_compares), "row long, low long, high long, ids binary")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = ranges.repartition(tasks, "row", "low").mapInArrow(_scan_range(least, exponent), "row long, found array<struct<start:long,length:long,period:long>>")
    found = found.select(F.col("row").alias("_row"), F.explode("found").alias("r")).groupBy("_row").agg(F.collect_list("r").alias("found"))  # of one document
    return short.unionByName(long.join(found, "_row", "left").select("doc_id", "text", "found").mapInArrow(_gather(rewrite), out))


def _scan_whole(least: int, exponent: int, rewrite: Callable | None) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in K.slices(batches):
            names, n, runs, texts = batch.column("doc_id").to_pylist(), [], [], []
            for k, doc_id in enumerate(names):
                words = _words(data[offsets[k] : offsets[k + 1]].tobytes(), doc_id, rewrite)
                found = primitive(lag_runs(_numbers(words), 1, len(words), least, exponent)) if len(words) >= least else []
                n.append(len(words))
                runs.append(found)
                texts.append(_collapsed(words, found))
            yield _result([batch.column("doc_id")], n, runs, texts)
        K.trim()

    return work


def _lag_ranges(exponent: int, rewrite: Callable | None, most_compares: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in K.slices(batches):
            for k, (doc_id, row) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("_row").to_pylist(), strict=True)):
                ids = _numbers(_words(data[offsets[k] : offsets[k + 1]].tobytes(), doc_id, rewrite))
                lags, packed = max(1, most_compares // max(1, len(ids))), ids.tobytes()
                for low in range(1, len(ids) // exponent + 1, lags):
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (row, low, low + lags)] + [pa.array([packed], pa.binary())], names=["row", "low", "high", "ids"])

    return work


def _scan_range(least: int, exponent: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for k in range(batch.num_rows):
                row, low, high = (batch.column(c)[k].as_py() for c in ("row", "low", "high"))
                found = lag_runs(np.frombuffer(batch.column("ids")[k].as_buffer(), np.int32), low, high, least, exponent)
                runs = [{"start": s, "length": n, "period": q} for s, n, q in primitive(found)]  # of equal ends the smallest of this range
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([runs], kind)], names=["row", "found"])
        K.trim()

    return work


def _gather(rewrite: Callable | None) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in K.slices(batches):
            for k in range(batch.num_rows):
                doc_id = batch.column("doc_id")[k].as_py()
                words = _words(data[offsets[k] : offsets[k + 1]].tobytes(), doc_id, rewrite)
                found = primitive([(r["start"], r["length"], r["period"]) for r in batch.column("found")[k].as_py() or []])
                yield _result([batch.column("doc_id").slice(k, 1)], [len(words)], [found], [_collapsed(words, found)])
        K.trim()

    return work


def planted(doc_id, n: int) -> np.ndarray | None:
    """The contract's periodic tails: a tenth of the documents, chosen and shaped by the CRC-32 of their id; none without an id."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    order = np.arange(n)
    order[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return order


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """The runs of every document as digests, its run of the greatest exponent, and its collapsed words."""
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), rewrite=planted)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    # runs are in order of start and period, so the first of equal exponents stays; products are exact
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP12_SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
coded AS (
  SELECT *, len(w) AS n, CASE WHEN doc_id IS NOT NULL THEN xor(list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * length(doc_id::VARCHAR))), lambda c, k:
    xor((xor(c, CASE WHEN k % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (k // 8 + 1)::INT, 1)) ELSE 0 END::BIGINT) >> 1),
        3988292384::BIGINT * (xor(c, CASE WHEN k % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (k // 8 + 1)::INT, 1)) ELSE 0 END::BIGINT) & 1))), 4294967295::BIGINT) END AS h FROM doc),
shaped AS (SELECT *, h // 10 % n AS a, 1 + (n - h // 10 % n) // (3 + h // 10 % 8) AS p FROM coded),
words AS (
  SELECT r, i, n, CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word FROM (SELECT *, unnest(range(0, n)) AS i FROM shaped WHERE n > 0)),
-- every run has 16 equalities in a row or more, so it begins where a window of 16 words comes again
windows AS (
  SELECT r, n, i, md5(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)) AS g FROM words),
pairs AS (SELECT a.r, a.i, b.i - a.i AS q FROM windows a JOIN windows b ON a.r = b.r AND a.g = b.g AND b.i > a.i AND a.i <= a.n - 16 AND b.i <= b.n - 16 AND 3 * (b.i - a.i) <= a.n),
islands AS (SELECT r, q, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island, i FROM pairs),
stretches AS (SELECT r, q, min(i) AS start, count(*) + 15 + q AS length FROM islands GROUP BY r, q, island),
runs AS (SELECT r, start, length, min(q) AS period FROM stretches WHERE length >= 24 AND length >= 3 * q GROUP BY r, start, length),
listed AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY r),
ranked AS (
  SELECT a.r, a.start, a.length, a.period FROM runs a WHERE NOT EXISTS (
    SELECT 1 FROM runs b WHERE b.r = a.r AND (b.length * a.period > a.length * b.period OR (b.length * a.period = a.length * b.period AND (b.start < a.start OR (b.start = a.start AND b.period < a.period)))))),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
left_ AS (SELECT w.r, string_agg(word, ' ' ORDER BY w.i) AS kept FROM words w ANTI JOIN gone g ON w.r = g.r AND w.i = g.i GROUP BY w.r)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, k.start, k.length, k.period, 1000 * k.length // k.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM doc d LEFT JOIN listed l USING (r) LEFT JOIN ranked k USING (r) LEFT JOIN left_ t USING (r)
"""
