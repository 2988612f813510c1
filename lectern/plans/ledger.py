"""A ledger of model calls: a prompt is paid for once.

Answers are kept by model and prompt (`snapshots` make additions whole). `ask` takes the distinct prompts
that have no answer, numbers them, and calls the model in rounds of `in_flight` tasks with `calls_per_task`
prompts each, so that no more than `in_flight` requests are open at a time. A round writes its answers where
they are made, without a shuffle behind the calls: what finished tasks have written outlives their
executors, and a lost one costs the calls of its unfinished tasks only. Each round is published before the
next begins, so a driver that dies loses one round. Actions on the result read the ledger and call nothing.

An empty answer (a failed call) is kept as such, and asked again by the next `ask` unless `retry_failed` is
off. Null prompts get no answer. With `spark.speculation` a slow call may be made twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.ordered import running
from lectern.plans.snapshots import ATTEMPTS, Snapshots
from lectern.plans.storage import materialize, release
from lectern.providers import Generator

#: Folders beyond which a ledger is written anew as one.
MOST_FOLDERS = 64
_KIND = "key string, answer string"


class Ledger:
    """The answers of one model at a path; `model` names it and its settings, `make` makes its client on a worker."""

    def __init__(self, spark: SparkSession, path: str, model: str, make: Callable[[], Generator], in_flight: int = 32, calls_per_task: int = 8, retry_failed: bool = True) -> None:
        if in_flight < 1 or calls_per_task < 1:
            raise ValueError("in_flight and calls_per_task must be positive")
        self.spark, self.make, self.in_flight, self.calls_per_task, self.retry_failed = spark, make, in_flight, calls_per_task, retry_failed
        self.at = Snapshots(spark, f"{path.rstrip('/')}/{model}")

    @staticmethod
    def key(prompt: Column) -> Column:
        return F.sha2(prompt, 256)

    def answers(self, manifest: dict | None = None) -> DataFrame:
        """key, answer: of several answers to a prompt (writers at the same time, failed calls) the greatest text."""
        manifest = self.at.latest()[1] if manifest is None else manifest
        paths = [f"{self.at.place}/{f}" for f in manifest.get("folders", [])]
        rows = self.spark.read.schema(_KIND).parquet(*paths) if paths else self.spark.createDataFrame([], _KIND)
        return rows.groupBy("key").agg(F.max("answer").alias("answer"))

    def ask(self, prompts: DataFrame) -> int:
        """Get answers to the prompts (column prompt) that have none; returns the number of calls that succeeded or failed."""
        wanted = prompts.where("prompt IS NOT NULL").select(self.key(F.col("prompt")).alias("key"), "prompt").dropDuplicates(["key"])
        known = self.answers().where(F.col("answer") != "") if self.retry_failed else self.answers()
        new = materialize(running(wanted.join(known, "key", "left_anti"), [], ["key"], out="number"), "to-ask")
        n, per_round = new.count(), self.in_flight * self.calls_per_task
        for first in range(0, n, per_round):
            some = new.where(F.col("number").between(first, first + per_round - 1))
            tasks = -(-min(per_round, n - first) // self.calls_per_task)
            folder = self.at.new_folder()
            some.repartitionByRange(tasks, "number").mapInPandas(_call(self.make), _KIND).write.parquet(f"{self.at.place}/{folder}")
            self._append(folder)
        release(new)
        return n

    def _append(self, folder: str) -> None:
        for _ in range(ATTEMPTS):
            number, manifest = self.at.latest()
            folders = [*manifest.get("folders", []), folder]
            if len(folders) > MOST_FOLDERS:
                whole = self.at.new_folder()
                self.answers({"folders": folders}).write.parquet(f"{self.at.place}/{whole}")
                folders = [whole]
            if self.at.publish(number + 1, {"folders": folders}):
                return
        raise RuntimeError("other writers publish all the time")

    def answered(self, rows: DataFrame, prompt: str, out: str) -> DataFrame:
        """rows with the answers to a column of prompts ('' where there is none); what is missing is asked first."""
        self.ask(rows.select(F.col(prompt).alias("prompt")))
        keyed = rows.withColumn("_key", self.key(F.col(prompt)))
        known = self.answers().select(F.col("key").alias("_key"), F.col("answer").alias(out))
        return keyed.join(known, "_key", "left").drop("_key").withColumn(out, F.coalesce(out, F.lit("")))


def _call(make: Callable[[], Generator]):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            for at in range(len(batch)):
                one = batch.iloc[at : at + 1]
                yield pd.DataFrame({"key": one["key"], "answer": [a or "" for a in model.generate(list(one["prompt"]))]})

    return work
