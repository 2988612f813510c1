"""Runs of text that also start in a document with a smaller id: the frame that two operators share.

Texts are packed into slices of some MB, written once; all else is keyed by slice, so no text is
joined by document and no key is hot.  Then

1. every slice samples anchors, such that equal windows hold equal anchors at equal places, and sends
   short hashes of each anchor and of its context (all windows it speaks for), dealt out by anchor;
2. a task that holds all occurrences of an anchor tells each whether it stands in several documents;
3. the slices send the contexts of those that do, as bytes; the task that holds all contexts of an anchor
   keeps each different one once, with its smallest id, and finds the classes of equal windows in them;
4. the slices gather what repeats and cut it.

Hashes only decide what is compared: nothing is removed whose bytes weren't found equal.

A slice sends one occurrence only for each anchor and context among its documents, that of the
smallest id (of larger ones in it the windows are known to repeat), so a passage that a third of all
documents share gives as many rows as there are slices.  Anchors with more than `spread_over` contexts
are compared window by window, dealt out by window, which spreads them.

Rows of a verdict come in order of bucket and are judged a few buckets at a time; the numbers of buckets
and of partitions follow the number of slices, so what a task holds doesn't grow with the input.

A null doc_id isn't ordered: such documents are neither cut nor a reason to cut.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import kernels as K
from lectern.plans.storage import materialize

NONE, WHOLE, COMPARE, SPREAD = 0, 1, 2, 3
SPREAD_OVER = 4096
#: Blobs are judged in runs of about so many bytes; buckets are never cut.
RUN_BYTES = 3 << 20
#: Slices for each partition of a shuffle, buckets for each partition, and the most partitions.
SLICES_A_TASK, BUCKETS_A_TASK, MOST_TASKS = 4, 6, 50_000
NO_ID = np.iinfo(np.int64).max


@dataclass
class Slice:
    """The documents of a slice: ids (NO_ID for null), null flags, bytes and offsets."""

    ids: np.ndarray
    null: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def pack(self) -> bytes:
        body = b"".join(x.tobytes() for x in (self.ids, self.null, self.offsets, self.data))
        return struct.pack("<I", len(self.ids)) + zstandard.compress(body, 3)

    @classmethod
    def unpack(cls, packed: bytes) -> Slice:
        (n,) = struct.unpack_from("<I", packed)
        body = zstandard.decompress(memoryview(packed)[4:])
        ids = np.frombuffer(body, np.int64, n)
        null = np.frombuffer(body, np.uint8, n, 8 * n)
        offsets = np.frombuffer(body, np.int64, n + 1, 9 * n)
        return cls(ids, null, np.frombuffer(body, np.uint8, -1, 17 * n + 8), offsets)


@dataclass
class Anchors:
    """Per anchor: hashes of it and of its context, its document, and its first and last window (unit numbers)."""

    anchor: np.ndarray
    context: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray


class Units:
    """How an operator sees a slice: its units, anchors and windows, and a text in which windows are ranges of bytes (eight at least)."""

    window: int
    text: np.ndarray

    def load(self, part: Slice) -> None:
        """Take a slice; sets n, the number of units, and firsts, the first unit of each document."""
        raise NotImplementedError

    def anchors(self) -> Anchors:
        raise NotImplementedError

    def context_bytes(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows from `first` to `last` begin in `text`, and how many bytes they cover."""
        raise NotImplementedError

    def window_hashes(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the windows that start at these units."""
        raise NotImplementedError

    @staticmethod
    def classes(text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For contexts (ranges of a text, all different): a class number for each of their windows, and how many windows each has."""
        raise NotImplementedError

    def same(self, first: np.ndarray, last: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """Whether pairs of these contexts are equal, byte for byte."""
        begin, size = self.context_bytes(first, last)
        eight = K.eights(self.text)

        def equal(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = size[i] == size[j]
            out[out] = K.same_ranges(eight, begin[i[out]], begin[j[out]], size[i[out]])
            return out

        return equal


def pack_slices(docs: DataFrame, most: int = K.SLICE_BYTES) -> DataFrame:
    """slice_id and payload of slices of the documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch, data, offsets in K.slices(batches, most=most):
            column = batch.column("doc_id").cast(pa.int64())
            null = np.asarray(column.is_null()).astype(np.uint8)
            ids = column.fill_null(NO_ID).to_numpy(zero_copy_only=False)
            payload = Slice(ids, null, data, offsets).pack()
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([payload], pa.binary())], names=["slice_id", "payload"])
            at += 1

    return docs.select("doc_id", "text").mapInArrow(work, "slice_id long, payload binary")


def planes(values: np.ndarray, width: int) -> bytes:
    """The low bytes of 64-bit values, plane by plane: equal high bytes compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(data: bytes, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return out.reshape(-1).view("<u8"), at + n * width


def _buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    """Buckets by the high bits; the low bits stay to tell hashes apart."""
    return ((hashes >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


@dataclass
class Sent:
    """What a slice sends of one kind: which of its items, in order of bucket, and where each bucket begins."""

    item: np.ndarray
    bucket: np.ndarray
    cut: np.ndarray


def sent_items(hashes: np.ndarray, items: np.ndarray, n: int) -> Sent:
    bucket = _buckets(hashes[items], n)
    order = np.argsort(bucket, kind="stable")
    names, cut = np.unique(bucket[order], return_index=True)
    return Sent(items[order], names, np.append(cut, len(items)))


def representatives(keys: tuple[np.ndarray, ...], ids: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray], exact: bool = False) -> np.ndarray:
    """For each item the first item of the smallest id with equal keys that `same` finds equal too.

    Items that only collide with that one stand for themselves; if exact is set, they are grouped again
    until every two equal items have one representative.
    """
    like = np.arange(len(ids))
    open_ = like
    while len(open_):
        order = open_[np.lexsort((ids[open_], *(k[open_] for k in keys)))]
        new = np.zeros(len(order), dtype=bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
        first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        equal = first == order
        some = np.flatnonzero(~equal)
        equal[some] = same(order[some], first[some])
        like[order[equal]] = first[equal]
        open_ = np.sort(order[~equal]) if exact else order[:0]
    return like


def runs_of_buckets(batches: Iterator[pa.RecordBatch], most: int = RUN_BYTES) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Rows (bucket, slice_id, kind, blob), which come in order of bucket, in lists of whole buckets of about `most` bytes."""
    run: list[tuple[int, int, int, bytes]] = []
    size, last = 0, None
    for batch in batches:
        for bucket, slice_id, kind, blob in zip(batch.column("bucket").to_pylist(), batch.column("slice_id").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
            if bucket != last and size > most:
                yield run
                run, size = [], 0
            run.append((bucket, slice_id, kind, blob.as_py()))
            size, last = size + len(run[-1][3]), bucket
    if run:
        yield run


def sent_rows(slice_id: int, buckets: list[int], kinds: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array([slice_id] * len(blobs), pa.int64()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "slice_id", "kind", "blob"])


def told_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    ids, names, blobs = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], names=["slice_id", "bucket", "blob"])


#: Bytes of an anchor's hash (its bucket is a part of the hash that isn't sent), of its context's (which only tells how many there are), and of its id.
_ANCHOR_BYTES = 4 + 3 + 8


@dataclass
class Found:
    """A slice's anchors of documents with an id, their ids, the one each is like, and what is sent.

    like: an anchor of the smallest id with the same context (or itself); above: whether its own id is larger.
    """

    anchors: Anchors
    ids: np.ndarray
    like: np.ndarray
    above: np.ndarray
    sent: Sent


class _Work:
    """The tasks of both operators. Made on the driver, sent to the executors with its limits."""

    def __init__(self, units: Callable[[], Units], buckets: int, spread_over: int = SPREAD_OVER) -> None:
        self.units, self.buckets, self.spread_over = units, buckets, spread_over

    # 1: anchors to hashes
    def found(self, units: Units, part: Slice) -> Found:
        a = units.anchors()
        own = np.flatnonzero(part.ids[a.doc] != NO_ID)
        a = Anchors(a.anchor[own], a.context[own], a.doc[own], a.first[own], a.last[own])
        ids = part.ids[a.doc]
        like = representatives((a.anchor, a.context), ids, units.same(a.first, a.last))
        return Found(a, ids, like, ids > ids[like], sent_items(a.anchor, np.flatnonzero(like == np.arange(len(ids))), self.buckets))

    def send_anchors(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = self.units()
        for batch in batches:
            for slice_id, payload in zip(batch.column("slice_id").to_pylist(), batch.column("payload"), strict=True):
                part = Slice.unpack(payload.as_py())
                units.load(part)
                f = self.found(units, part)
                blobs = []
                for a, b in zip(f.sent.cut[:-1].tolist(), f.sent.cut[1:].tolist(), strict=True):
                    own = f.sent.item[a:b]
                    blobs.append(planes(f.anchors.anchor[own], 4) + planes(f.anchors.context[own], 3) + planes(f.ids[own], 8))
                yield sent_rows(slice_id, f.sent.bucket.tolist(), [0] * len(blobs), blobs)

    # 2: verdicts on hashes
    def judge(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Codes (a byte each) of the items of every blob that has some to act on."""
        for run in runs_of_buckets(batches):
            out = self._judged(run)
            if out:
                yield told_batch(out)

    def _judged(self, run: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, bytes]]:
        rows, parts = [], []
        for bucket, slice_id, kind, blob in run:
            n, at = len(blob) // _ANCHOR_BYTES, 0
            a, at = from_planes(blob, at, n, 4)
            c, at = from_planes(blob, at, n, 3)
            ids, at = from_planes(blob, at, n, 8)
            rows.append((slice_id, bucket, n))
            parts.append((a | np.uint64(bucket << 32), c, ids.view(np.int64)))
        anchor, context, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order = np.lexsort((ids, context, anchor))
        anchor, context, ids = anchor[order], context[order], ids[order]
        new_a = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        new_c = new_a | np.concatenate(([True], context[1:] != context[:-1]))
        group = np.cumsum(new_a) - 1
        starts = np.flatnonzero(new_a)
        least, most = np.minimum.reduceat(ids, starts), np.maximum.reduceat(ids, starts)
        contexts = np.add.reduceat(new_c.astype(np.int64), starts)
        code = np.where((contexts > self.spread_over)[group], SPREAD, COMPARE)
        code = np.where((least < most)[group], code, NONE)
        back = np.empty(len(code), np.uint8)
        back[order] = code
        at, out = 0, []
        for slice_id, bucket, n in rows:
            own = back[at : at + n]
            at += n
            if own.any():
                out.append((slice_id, bucket, zstandard.compress(own.tobytes(), 1)))
        return out

    def codes(self, n: int, sent: Sent, told: dict[int, bytes]) -> np.ndarray:
        """The codes of n items, of which some were sent."""
        out = np.zeros(n, np.uint8)
        where = {b: k for k, b in enumerate(sent.bucket.tolist())}
        for bucket, blob in told.items():
            k = where[bucket]
            out[sent.item[sent.cut[k] : sent.cut[k + 1]]] = np.frombuffer(zstandard.decompress(blob), np.uint8)
        return out

    def told_codes(self, f: Found, told: dict[int, bytes]) -> np.ndarray:
        """The codes of all of a slice's anchors: those that weren't sent share that of the one they are like, or repeat as a whole."""
        code = self.codes(len(f.ids), f.sent, told)
        return np.where(f.above, WHOLE, code[f.like])

    @staticmethod
    def windows(units: Units, f: Found, which: np.ndarray) -> np.ndarray:
        """Which windows belong to some of the anchors."""
        return K.covered(units.n, f.anchors.first[which], f.anchors.last[which] + 1)


def told_rows(parts: DataFrame, told: DataFrame, tasks: int) -> DataFrame:
    """Slices behind what was told of them: rows (slice_id, bucket, blob), the payload last with bucket NO_ID."""
    return (
        told.select("slice_id", "bucket", "blob")
        .unionByName(parts.select("slice_id", F.lit(int(NO_ID)).cast("long").alias("bucket"), F.col("payload").alias("blob")))
        .repartition(tasks, "slice_id")
        .sortWithinPartitions("slice_id", "bucket")
    )


def dealt(sent: DataFrame, tasks: int) -> DataFrame:
    """What slices sent, whole buckets to a task and in their order."""
    return sent.repartition(tasks, "bucket").sortWithinPartitions("bucket")


def told_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Slice, dict[int, bytes]]]:
    """slice_id, slice, and blobs by bucket, of rows in told_rows' order."""
    told: dict[int, bytes] = {}
    for batch in batches:
        for slice_id, bucket, blob in zip(batch.column("slice_id").to_pylist(), batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
            if bucket != NO_ID:
                told[bucket] = blob.as_py()
                continue
            yield slice_id, Slice.unpack(blob.as_py()), told
            told = {}


def task_count(df: DataFrame, slices: int) -> int:
    """Partitions for a shuffle of what slices send: by the number of slices, so that each has about the same to do."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(MOST_TASKS, max(min(cores, slices), -(-slices // SLICES_A_TASK))))


SENT = "bucket long, slice_id long, kind int, blob binary"
TOLD = "slice_id long, bucket long, blob binary"


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


#: Kinds of what slices send in the second round: contexts, and windows of anchors that are spread.
CONTEXTS, WINDOWS = 1, 2
#: Verdicts on contexts: no window repeats, all do, or as the bits say.
NO, ALL, SOME = 0, 1, 2
#: Answers to contexts and windows come under their bucket and kind; the first verdict's buckets as -1 - bucket.
_KIND = 1 << 40


def compare_contexts(blobs: list[bytes], classes: Callable) -> list[bytes]:
    """For blobs of contexts: a verdict byte for each context, and bits for the windows of those whose verdict is SOME."""
    ids, sizes, texts, counts = [], [], [], []
    for blob in blobs:
        n = int.from_bytes(blob[:4], "little")
        body = zstandard.decompress(blob[4:])
        own, at = from_planes(body, 0, n, 8)
        size, at = from_planes(body, at, n, 8)
        ids.append(own.view(np.int64))
        sizes.append(size.view(np.int64))
        texts.append(body[at:])
        counts.append(n)
    raw, id_, size = b"".join(texts), np.concatenate(ids), np.concatenate(sizes)
    begin = np.cumsum(size) - size
    seen: dict[bytes, int] = {}  # equal contexts, byte for byte, are compared once
    kind = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(begin.tolist(), (begin + size).tolist(), strict=True)], dtype=np.int64)
    seen.clear()
    _, one = np.unique(kind, return_index=True)
    least = np.full(len(one), NO_ID)
    np.minimum.at(least, kind, id_)
    class_, windows = classes(np.frombuffer(raw, np.uint8), begin[one], size[one])
    of_class = np.full(int(class_.max()) + 1, NO_ID)
    mine = np.repeat(least, windows)
    np.minimum.at(of_class, class_, mine)
    again = mine > of_class[class_]
    where = np.cumsum(windows) - windows
    hits = np.add.reduceat(again.astype(np.int64), where)
    code = np.where((id_ > least[kind]) | (hits == windows)[kind], ALL, np.where(hits[kind] > 0, SOME, NO)).astype(np.uint8)
    out, k = [], 0
    for n in counts:
        own = code[k : k + n]
        some = kind[k : k + n][own == SOME]
        k += n
        out.append(zstandard.compress(own.tobytes() + np.packbits(again[ranges(where[some], windows[some])]).tobytes(), 1) if own.any() else b"")
    return out


def _by_bucket(sent: Sent) -> Iterator[tuple[int, int, int]]:
    return zip(sent.bucket.tolist(), sent.cut[:-1].tolist(), sent.cut[1:].tolist(), strict=True)


class _Asked:
    """What of a slice has to be compared after the first verdict: the same, in the same order, when it is sent and when the answers come."""

    def __init__(self, work: _Work, units: Units, part: Slice, told: dict[int, bytes]) -> None:
        f = self.f = work.found(units, part)
        self.work, self.units, self.code = work, units, work.told_codes(f, told)
        rep = f.like == np.arange(len(f.ids))
        self.contexts = sent_items(f.anchors.anchor, np.flatnonzero(rep & (self.code == COMPARE)), work.buckets)
        at = self.at = np.flatnonzero(work.windows(units, f, self.code == SPREAD))
        hashes = units.window_hashes(at)
        self.ids = part.ids[np.searchsorted(units.firsts, at, side="right") - 1]
        self.like = representatives((hashes,), self.ids, units.same(at, at))
        self.windows = sent_items(hashes, np.flatnonzero(self.like == np.arange(len(at))), work.buckets)

    def rows(self, slice_id: int) -> pa.RecordBatch:
        a, text = self.f.anchors, self.units.text
        buckets, kinds, blobs = [], [], []
        for kind, sent, first, last, ids in ((CONTEXTS, self.contexts, a.first, a.last, self.f.ids), (WINDOWS, self.windows, self.at, self.at, self.ids)):
            for bucket, x, y in _by_bucket(sent):
                own = sent.item[x:y]
                begin, size = self.units.context_bytes(first[own], last[own])
                buckets.append(bucket)
                kinds.append(kind)
                blobs.append(len(own).to_bytes(4, "little") + zstandard.compress(planes(ids[own], 8) + planes(size, 8) + text[ranges(begin, size)].tobytes(), 1))
        return sent_rows(slice_id, buckets, kinds, blobs)

    def repeats(self, told: dict[tuple[int, int], bytes]) -> np.ndarray:
        """Which of the slice's windows stand in a document with a smaller id."""
        a, f = self.f.anchors, self.f
        repeat = self.work.windows(self.units, f, f.above)
        for bucket, x, y in _by_bucket(self.contexts):
            blob = told.get((CONTEXTS, bucket))
            if blob:
                own, body = self.contexts.item[x:y], np.frombuffer(zstandard.decompress(blob), np.uint8)
                code, size = body[: len(own)], a.last[own] - a.first[own] + 1
                repeat[ranges(a.first[own[code == ALL]], size[code == ALL])] = True
                place = ranges(a.first[own[code == SOME]], size[code == SOME])
                # places are of different anchors, whose windows may be the same ones
                repeat[place[np.unpackbits(body[len(own) :], count=len(place)).astype(bool)]] = True
        single = np.zeros(len(self.at), dtype=bool)
        for bucket, x, y in _by_bucket(self.windows):
            blob = told.get((WINDOWS, bucket))
            if blob:
                single[self.windows.item[x:y]] = np.frombuffer(zstandard.decompress(blob), np.uint8, y - x) == ALL
        repeat[self.at[single[self.like] | (self.ids > self.ids[self.like])]] = True
        # contexts of the same document that equal one that was sent
        copy = np.flatnonzero((f.like != np.arange(len(f.ids))) & ~f.above & (self.code == COMPARE))
        size = a.last[copy] - a.first[copy] + 1
        to, of = ranges(a.first[copy], size), ranges(a.first[f.like[copy]], size)
        repeat[to[repeat[of]]] = True
        return repeat


def first_verdict(docs: DataFrame, units: Callable[[], Units], spread_over: int = SPREAD_OVER) -> tuple[_Work, DataFrame, DataFrame, int]:
    """The tasks, packed slices, the first verdict on their anchors, and the number of partitions."""
    parts = materialize(pack_slices(docs), "slices")
    slices = parts.count()
    tasks = task_count(docs, slices)
    work = _Work(units, max(BUCKETS_A_TASK * tasks, slices), spread_over)
    told = materialize(dealt(parts.mapInArrow(work.send_anchors, SENT), tasks).mapInArrow(work.judge, TOLD), "verdict")
    return work, parts, told, tasks


def dedup(docs: DataFrame, units: Callable[[], Units], cut: Callable[[Units, Slice, np.ndarray], pa.RecordBatch], schema: str, spread_over: int = SPREAD_OVER) -> DataFrame:
    """What `cut` makes of each slice and the mask of its windows that stand in a document with a smaller id."""
    work, parts, told, tasks = first_verdict(docs, units, spread_over)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = work.units()
        for slice_id, part, said in told_slices(batches):
            own.load(part)
            yield _Asked(work, own, part, said).rows(slice_id)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = work.units().classes
        for run in runs_of_buckets(batches):
            verdicts = compare_contexts([r[3] for r in run], classes)
            found = [(slice_id, bucket + kind * _KIND, blob) for (bucket, slice_id, kind, _), blob in zip(run, verdicts, strict=True) if blob]
            if found:
                yield told_batch(found)

    second = materialize(dealt(told_rows(parts, told, tasks).mapInArrow(send, SENT), tasks).mapInArrow(judge, TOLD), "verdict")
    both = second.unionByName(told.withColumn("bucket", -1 - F.col("bucket")))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = work.units()
        for _, part, said in told_slices(batches):
            own.load(part)
            asked = _Asked(work, own, part, {-1 - b: x for b, x in said.items() if b < 0})
            yield cut(own, part, asked.repeats({divmod(b, _KIND): x for b, x in said.items() if b >= 0}))

    return told_rows(parts, both, tasks).mapInArrow(gather, schema)
