"""Vectors of texts, kept by content: a text is encoded once for each model, wherever it stands.

A table holds (hash of the text, vector) for one model, as folders of Parquet named by a manifest
(`snapshots`). `learn` encodes the distinct texts that an anti-join finds missing and appends them;
`embedded` joins vectors to rows. Chunks, questions and sentences share a table, so a second index over the
same texts, a second action, and a sentence that many documents repeat encode nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.snapshots import ATTEMPTS, Snapshots
from lectern.plans.storage import materialize, release
from lectern.providers import Embedder

#: Folders beyond which a table is written anew as one.
MOST_FOLDERS = 24
_KIND = "hash binary, vector array<double>"


class VectorTable:
    """The vectors of one model at a path; `model` names it, `make` makes it on a worker."""

    def __init__(self, spark: SparkSession, path: str, model: str, make: Callable[[], Embedder]) -> None:
        self.spark, self.make = spark, make
        self.at = Snapshots(spark, f"{path.rstrip('/')}/{model}")

    @staticmethod
    def key(text: Column) -> Column:
        return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))

    def vectors(self, manifest: dict | None = None) -> DataFrame:
        """hash, vector; each hash once, though writers at the same time may have added a text each."""
        manifest = self.at.latest()[1] if manifest is None else manifest
        paths = [f"{self.at.place}/{f}" for f in manifest.get("folders", [])]
        rows = self.spark.read.schema(_KIND).parquet(*paths) if paths else self.spark.createDataFrame([], _KIND)
        return rows.groupBy("hash").agg(F.first("vector").alias("vector")) if len(paths) > 1 else rows

    def learn(self, texts: DataFrame) -> int:
        """Encode the texts (column text; null is empty) that the table lacks; returns how many these were."""
        asked = texts.select(self.key(F.col("text")).alias("hash"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["hash"])
        new = materialize(asked.join(self.vectors().select("hash"), "hash", "left_anti"), "new-texts")
        n = new.count()
        if n:
            folder, make = self.at.new_folder(), self.make

            def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                model = make()
                for batch in batches:
                    yield pd.DataFrame({"hash": batch["hash"], "vector": list(model.encode(batch["text"]))})

            tasks = max(1, min(n, self.spark.sparkContext.defaultParallelism * 2)) if n < 1 << 20 else None
            dealt = new.repartition(tasks) if tasks else new
            dealt.mapInPandas(encode, _KIND).write.parquet(f"{self.at.place}/{folder}")
            self._append(folder)
        release(new)
        return n

    def _append(self, folder: str) -> None:
        for _ in range(ATTEMPTS):
            number, manifest = self.at.latest()
            folders = [*manifest.get("folders", []), folder]
            if len(folders) > MOST_FOLDERS:
                whole = self.at.new_folder()
                self.vectors({"folders": folders}).write.parquet(f"{self.at.place}/{whole}")
                folders = [whole]
            if self.at.publish(number + 1, {"folders": folders}):
                return
        raise RuntimeError("other writers publish all the time")

    def embedded(self, rows: DataFrame, text: str, out: str) -> DataFrame:
        """rows with the vectors of a column of texts; what is missing is encoded first. rows is read twice."""
        self.learn(rows.select(F.col(text).alias("text")))
        keyed = rows.withColumn("_hash", self.key(F.col(text)))
        return keyed.join(self.vectors().select(F.col("hash").alias("_hash"), F.col("vector").alias(out)), "_hash", "left").drop("_hash")
