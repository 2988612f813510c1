"""SimHash near-duplicates by a self-join of binary tries.

A document's fingerprint has bit i set if over half of its shingles' XXH64 have.  Distinct
fingerprints are dealt out by each of their four 16-bit blocks: two that differ in three bits at
most agree in a block.  A task sorts the fingerprints of its groups, which makes every group a
binary trie over a sorted array, and walks pairs of nodes from the roots down: a node with itself,
or two nodes with the number of bits in which their prefixes differ.  A pair over the error budget
is dropped with all below it.  Links become the star of a component at once, so a task returns fewer
edges than it has fingerprints, however many pairs there are; stars meet in a components step.

A group of over `split_over` fingerprints is dealt out again by the four 12-bit parts of the other
48 bits (three errors spare one of them), which spreads it over tasks; the pairs stay complete.

Nulls: a null text has no words and fingerprint zero, which links like any other.  A null doc_id
gets a fingerprint and its component's smallest id (null if there is none).  Rows that repeat have
equal fingerprints.  An empty table gives an empty result.  Texts of any length are read whole, their
shingles hashed in runs of 65,536.  Ties: a bit that exactly half of the hashes have is 0; a component
is named by its smallest id.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import kernels as K
from lectern.llm.graphs import components, local_components
from lectern.plans.storage import materialize

SEED = 42
MAX_BITS = 3
FRONTIER = 1 << 20
LINKS = 1 << 22


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of UTF-8 bytes."""
    words = text.lower().split()  # of bytes: only ASCII letters and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    low, high = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, sums = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(low), 1 << 16):
        part = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(low[at : at + (1 << 16)], high[at : at + (1 << 16)], strict=True)), dtype=np.uint64)
        sums += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(sums * 2 > len(low), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])
        K.trim()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, fp long")


def trie_links(groups: np.ndarray, values: np.ndarray, budget: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (value, smallest linked value) that join what differs in `budget` bits at most within a group.

    values: unsigned 64-bit, distinct within a group.  The edges of a component form stars.
    """
    order = np.lexsort((values, groups))
    groups, values = groups[order], values[order]
    n = len(values)
    cuts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1], [True]))) if n else np.zeros(1, np.int64)
    lo, hi = cuts[:-1], cuts[1:]
    some = hi - lo > 1
    zero = np.zeros(int(some.sum()), dtype=np.int64)
    stack = [(0, lo[some], hi[some], lo[some], hi[some], zero)]
    ones: dict[int, np.ndarray] = {}
    left, right, links = [], [], 0

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal links, left, right
        left.append(a)
        right.append(b)
        links += len(a)
        if links > LINKS:  # shrink links to stars
            label = local_components(n, np.concatenate(left), np.concatenate(right))
            own = np.flatnonzero(label != np.arange(n))
            left, right, links = [own], [label[own]], 0

    while stack:
        level, al, ah, bl, bh, err = stack.pop()
        if len(al) > FRONTIER:
            half = len(al) // 2
            stack += [(level, *(x[k] for x in (al, ah, bl, bh, err))) for k in (slice(half), slice(half, None))]
            continue
        leaf = (ah - al == 1) & (bh - bl == 1)
        if leaf.any():
            a, b = al[leaf], bl[leaf]
            near = (a != b) & (np.bitwise_count(values[a] ^ values[b]) <= budget)
            keep(a[near], b[near])
            al, ah, bl, bh, err = (x[~leaf] for x in (al, ah, bl, bh, err))
        if not len(al) or level == 64:
            continue
        if level not in ones:
            ones[level] = np.concatenate(([0], np.cumsum((values >> np.uint64(63 - level)) & np.uint64(1)).astype(np.int64)))
        c = ones[level]
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
        same = al == bl  # nodes of a level are equal or apart
        cross = ~same
        pairs = [
            (al, am, bl, bm, err),
            (am, ah, bm, bh, err),
            (al, am, bm, bh, err + 1),
            tuple(x[cross] for x in (am, ah, bl, bm, err + 1)),
        ]
        al, ah, bl, bh, err = (np.concatenate(x) for x in zip(*pairs, strict=True))
        good = (al < ah) & (bl < bh) & (err <= budget) & ~((al == bl) & (ah - al == 1))
        stack.append((level + 1, *(x[good] for x in (al, ah, bl, bh, err))))
    if not left:
        return values[:0], values[:0]
    label = local_components(n, np.concatenate(left), np.concatenate(right))
    own = np.flatnonzero(label != np.arange(n))
    return values[own], values[label[own]]


#: Fingerprints that a task walks at once; groups are never cut.
RUN = 1 << 20


def _trie_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of group; a few groups are walked at a time."""

    def links(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        groups, values = (np.concatenate(x) for x in zip(*parts, strict=True))
        a, b = trie_links(groups, values.view(np.uint64))
        for at in range(0, len(a), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + (1 << 18)].view(np.int64)), pa.array(b[at : at + (1 << 18)].view(np.int64))], names=["u", "v"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        groups, values = batch.column("grp").to_numpy(), batch.column("fp").to_numpy()
        if size + len(groups) > RUN and len(groups):
            cut = int(np.searchsorted(groups, groups[-1]))  # the last group may go on
            if cut or (held and held[-1][0][-1] != groups[0]):
                yield from links([*held, (groups[:cut], values[:cut])])
                held, size, groups, values = [], 0, groups[cut:], values[cut:]
        held.append((groups, values))
        size += len(groups)
    if size:
        yield from links(held)
    held.clear()
    K.trim()


def _parts(value, width: int, shifts: list[int], tag) -> F.Column:
    """An array of group numbers: the part's number, its bits, and what stands in tag."""
    mask = (1 << width) - 1
    return F.array(*((tag * len(shifts) + k) * (1 << width) + F.shiftrightunsigned(value, s).bitwiseAND(F.lit(mask)) for k, s in enumerate(shifts)))


def link_fingerprints(distinct: DataFrame, split_over: int = 100_000) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that connect what links directly or by others."""
    fp = F.col("fp")
    keyed = distinct.select("fp", F.explode(_parts(fp, 16, [0, 16, 32, 48], F.lit(0).cast("long"))).alias("grp"))
    large = materialize(keyed.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split_over).select("grp"), "simhash-large")
    if not large.isEmpty():
        marked = keyed.join(large.withColumn("is_large", F.lit(True)), "grp", "left")
        keyed = marked.where("is_large IS NULL").select("fp", "grp")
        for block in range(4):
            # the other 48 bits, moved together, in parts of 12
            low = fp.bitwiseAND(F.lit((1 << (16 * block)) - 1)) if block else F.lit(0).cast("long")
            high = F.shiftleft(F.shiftrightunsigned(fp, 16 * block + 16), 16 * block) if block < 3 else F.lit(0).cast("long")
            rest = low.bitwiseOR(high)
            own = marked.where(F.col("is_large") & (F.shiftrightunsigned(F.col("grp"), 16) == block))
            keyed = keyed.unionByName(own.select("fp", F.explode(_parts(rest, 12, [0, 12, 24, 36], F.col("grp") + (1 << 18))).alias("grp")))
    return keyed.repartition("grp").sortWithinPartitions("grp").mapInArrow(_trie_task, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    marked = materialize(fingerprints(docs, shingle), "simhash")
    least = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    stars = components(link_fingerprints(least.select("fp")))
    named = least.join(stars.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("v", "fp"))
    roots = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-roots")
    ids = materialize(named.join(roots, "root").select("fp", "component_id"), "simhash-ids")
    out = marked.join(ids, "fp", "left")  # rows of one fingerprint, however many, are split by the adaptive skew join
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate components of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
