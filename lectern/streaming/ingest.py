"""Streaming ingest, an extension: documents that arrive as files are chunked and appended exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.config import DEFAULT, Settings
from lectern.operators.chunking import chunks


def stream_documents(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of Parquet files of documents (kb_id, text, ...)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(stream: DataFrame, out: str, checkpoint: str, cfg: Settings = DEFAULT):
    """Start a query that chunks arriving documents (stateless, so it needs no watermark) into a Parquet table."""
    return chunks(stream, cfg).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
