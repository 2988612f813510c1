"""What a session needs before Python operators run."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers of this session import the package from where the driver has it.

    On a cluster the package is installed on the executors or sent with --py-files; the path does no harm there.
    """
    environment = spark.sparkContext.environment
    paths = [x for x in environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if x]
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    return spark


#: Inputs below this estimate are dealt out to all cores before heavy row-wise work.
SMALL_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """df dealt out evenly if it is small: a small Parquet file is one row group, hence one task.

    Larger inputs, and streams, stay as they are: their files make enough tasks, and a shuffle of texts would cost more.
    """
    spark = df.sparkSession
    if df.isStreaming or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL_BYTES:
        return df
    return df.repartition(spark.sparkContext.defaultParallelism)
