"""Positions, running sums and last values over ordered rows, without a task for each key.

Rows are dealt by ranges of (key, order), so a key with half of all rows lies in many partitions. Each task
works through its partition in order and writes what it found with the rows, so that nothing depends on how
the written files are read again. What partitions end with, a row for each key that several of them hold, is
carried forward by one small window and added.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.plans.storage import materialize

def _worked(rows: DataFrame, by: list[str], order: list[str], partitions: int | None, work: Callable, kind: T.DataType) -> DataFrame:
    """rows, written, with _part, _at (place in the partition) and _own: what work(key changes, batch, state) gives for each batch of a partition, in order."""
    columns = [F.col(c) for c in [*by, *order]]
    dealt = rows.repartitionByRange(partitions, *columns) if partitions else rows.repartitionByRange(*columns)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, at, part = None, None, 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own, state = work(_first_of_key(batch, by, key), batch, state)
            key = tuple(batch.column(b)[-1].as_py() for b in by)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), own], names=[*batch.schema.names, "_part", "_at", "_own"])
            at += n

    fields = [*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType()), T.StructField("_own", kind)]
    return materialize(dealt.sortWithinPartitions(*columns).mapInArrow(task, T.StructType(fields)), "ordered")


def running(rows: DataFrame, by: list[str], order: list[str], value: Column | None = None, out: str = "position", partitions: int | None = None) -> DataFrame:
    """rows with the sum of value over the rows before each of its key (by columns, none for all rows); without a value their number.

    order tells rows of a key apart: among equal ones the order isn't defined. value is a whole number, null counts as 0.
    """
    rows = rows.withColumn("_value", F.coalesce(value.cast("long"), F.lit(0)) if value is not None else F.lit(1).cast("long"))
    done = _worked(rows, by, order, partitions, _running, T.LongType())
    sums = done.groupBy(*by, "_part").agg(F.sum("_value").alias("_sum"))
    wide = _same(sums, _wide(done, by), by, "left_semi") if by else sums
    before = F.sum("_sum").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = wide.select(*by, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    joined = _same(done, carried, [*by, "_part"], "left")
    return joined.withColumn(out, F.col("_own") + F.coalesce("_before", F.lit(0))).drop("_value", "_own", "_before", "_part", "_at")


def _wide(done: DataFrame, by: list[str]) -> DataFrame:
    """Keys that several partitions hold: the others need no carry."""
    return done.groupBy(*by).agg(F.min("_part").alias("_first"), F.max("_part").alias("_last")).where("_first < _last").select(*by)


def _same(left: DataFrame, right: DataFrame, by: list[str], how: str) -> DataFrame:
    """A join in which null keys meet; right is small: a row for each partition, or for each key that several hold."""
    names = {b: f"_r{k}" for k, b in enumerate(by)}
    right = right.withColumnsRenamed(names)
    on = [left[b].eqNullSafe(right[n]) for b, n in names.items()]
    return left.join(right, on, how).drop(*names.values())


def _first_of_key(batch: pa.RecordBatch, by: list[str], key: tuple | None) -> np.ndarray:
    """Whether each row begins a key, given the last row's key before the batch."""
    new = np.zeros(batch.num_rows, dtype=bool)
    for b in by:
        codes = batch.column(b).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    new[0] = key is None or key != tuple(batch.column(b)[0].as_py() for b in by)
    return new


def _running(new: np.ndarray, batch: pa.RecordBatch, total: int | None) -> tuple[pa.Array, int]:
    """The sum of the rows before each of its key; total is that of the key the batch before ended with."""
    values = batch.column("_value").to_numpy()
    before = np.cumsum(values) - values
    starts = np.flatnonzero(new)
    which = np.searchsorted(starts, np.arange(len(values)), side="right") - 1
    base = np.full(len(values), -(total or 0))  # the key that goes on counts from what it had
    base[which >= 0] = before[starts[which[which >= 0]]]
    own = before - base
    return pa.array(own), int(own[-1] + values[-1])


def last_value(rows: DataFrame, by: list[str], order: list[str], value: str, out: str, partitions: int | None = None) -> DataFrame:
    """rows with the last value of their key that isn't null, up to and with each row."""
    done = _worked(rows, by, order, partitions, _filled(value), rows.schema[value].dataType)
    # what each partition ends a key with; carried over the partitions of keys that lie in several
    ends = _same(done.groupBy(*by, "_part").agg(F.max_by("_own", "_at").alias("_end")), _wide(done, by), by, "left_semi")
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    joined = _same(done, ends.select(*by, "_part", before.alias("_before")), [*by, "_part"], "left")
    return joined.withColumn(out, F.coalesce("_own", "_before")).drop("_own", "_before", "_part", "_at")


def _filled(value: str) -> Callable:
    def work(new: np.ndarray, batch: pa.RecordBatch, held) -> tuple[pa.Array, object]:
        """The last value of each row's key in the partition that isn't null; held is that of the key the batch before ended with."""
        column, places = batch.column(value), np.arange(batch.num_rows)
        valid = pc.is_valid(column).to_numpy(zero_copy_only=False)
        last = np.maximum.accumulate(np.where(valid, places, -1))
        start = np.maximum.accumulate(np.where(new, places, -1))  # -1: the key began before the batch
        own = column.take(pa.array(np.where((last >= 0) & (last >= start), last, 0), mask=(last < 0) | (last < start)))
        if held is not None:
            own = pc.if_else(pa.array((start < 0) & (last < 0)), pa.scalar(held, own.type), own)
        return own, own[-1].as_py()

    return work
