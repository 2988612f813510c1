"""Intermediate tables in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir`` when the cluster names one.  Where it is unset (tests, a
notebook on one machine) and the session runs on this machine alone, a fresh temporary folder is made;
on a cluster an unset folder is an error, since executors would write to their own disks.  Tables
written here survive the loss of any executor and cut the lineage of long plans.  `tables_of`,
`materialize_alone` and `release` delete what a piece of work has done with: a piece of work owns the
tables that are written within it, by its own thread, and deletes no others, so pieces of work in several
threads don't touch each other's.  Tables that no piece of work deletes go when the driver ends.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: All tables that there are, by path.
_MADE: dict[str, SparkSession] = {}
#: The paths that the innermost open piece of work has written.
_OWN: ContextVar[list[str] | None] = ContextVar("lectern_tables", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI; a temporary one only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="lectern-")
    return _LOCAL[app]


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has used."""
    path = f"{shared_dir(spark)}/lectern/{tag}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    own = _OWN.get()
    if own is not None:
        own.append(path)
    return path


#: Options for rows of long arrays: a batch of the reader holds a row group's rows at most, and the writer looks at the size after a few rows.
LONG_ROWS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 8}


def materialize(df: DataFrame, tag: str, partition_by: list[str] | None = None, options: dict | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and return a frame that reads it."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    writer = df.write.options(compression="zstd", **options or {})
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def merged(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left joined to right, never by a broadcast: for two sides that both grow with the input.

    Spark judges a written table by its compressed bytes, and arrays that are exploded by what they were made of. Of
    values that repeat, a megabyte can be hundreds in memory, which a broadcast would bring to the driver.
    """
    return left.join(right.hint("merge"), on, how)


def materialize_alone(build: Callable[[], DataFrame], tag: str) -> DataFrame:
    """Write what build gives, then delete all tables that were written to make it."""
    outer = _OWN.get()
    with tables_of():
        out = materialize(build(), tag)
        _OWN.get().remove(out._written_at)
    if outer is not None:
        outer.append(out._written_at)
    return out


def release(*frames: DataFrame) -> None:
    """Delete the tables behind frames that `materialize` gave; nothing may read them afterwards."""
    for frame in frames:
        path = getattr(frame, "_written_at", None)
        if path is not None:
            delete_path(frame.sparkSession, path)
            _MADE.pop(path, None)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder through Hadoop's file system; nothing happens if it is absent."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def tables_of() -> Iterator[None]:
    """Deletes at its end the tables that were written within it; nothing may read them afterwards."""
    own: list[str] = []
    token = _OWN.set(own)
    try:
        yield
    finally:
        _OWN.reset(token)
        _delete(own)


def _delete(paths: list[str]) -> None:
    for path in reversed(paths):
        spark = _MADE.pop(path, None)
        if spark is None:  # released already
            continue
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may have gone first, or this session; go on with the others
            continue


@atexit.register
def _sweep() -> None:
    _delete(list(_MADE))
