"""The registry as a stream of events: keyed state, changed by whole versions, a batch counted once.

State is one row for each document name (its last deletion, the numbers of the upserts after it, the latest
of them) and one for each workspace (the event that chose the active document, and its place then). A
batch is merged into it and published as a version that names the batch (`snapshots`), so a batch that comes
again after a failure changes nothing, and readers see whole batches.

Documents are the same whatever way events are split into batches, and in any order. The active place needs
batches that follow each other by seq, as a log's do; within a batch any order will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import registry
from lectern.operators.ordered import running
from lectern.plans.snapshots import ATTEMPTS, Snapshots
from lectern.plans.storage import tables_of

_DOCUMENT = "struct<seq:long,kb_id:string,chunk_count:int,text_hash:string>"


class RegistryStream:
    """The registry at a path; by names the columns of a workspace (string), none for a single one."""

    def __init__(self, spark: SparkSession, path: str, by: list[str] | None = None) -> None:
        self.spark, self.by, self.at = spark, by or [], Snapshots(spark, path)
        self.columns = [*self.by, "source_name"]

    def _part(self, manifest: dict, name: str, schema: str) -> DataFrame:
        keys = "".join(f"{b} string, " for b in self.by)
        if not manifest:
            return self.spark.createDataFrame([], keys + schema)
        return self.spark.read.schema(keys + schema).parquet(f"{self.at.place}/{manifest['folders'][0]}/{name}")

    def _documents(self, manifest: dict) -> DataFrame:
        return self._part(manifest, "documents", f"source_name string, gone long, seqs array<long>, last {_DOCUMENT}")

    def _chosen(self, manifest: dict) -> DataFrame:
        return self._part(manifest, "chosen", "set_at long, place long")

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Take a batch of events (seq, op, source_name, kb_id, chunk_count, text_hash, and by columns) in; once."""
        for _ in range(ATTEMPTS):
            number, manifest = self.at.latest()
            if manifest.get("batch", -1) >= batch_id:
                return  # it came before
            folder = self.at.new_folder()
            with tables_of():
                self._write(batch, manifest, folder)
            if self.at.publish(number + 1, {"batch": batch_id, "folders": [folder]}):
                self.at.expire(keep=3)
                return
        raise RuntimeError("other writers publish all the time")

    def _write(self, batch: DataFrame, manifest: dict, folder: str) -> None:
        old, before = self._documents(manifest), self._chosen(manifest)
        document = F.struct("seq", "kb_id", F.col("chunk_count").cast("int").alias("chunk_count"), "text_hash")
        upsert = F.col("op") == "upsert"
        new = batch.groupBy(*self.columns).agg(
            F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("gone"), F.collect_set(F.when(upsert, F.col("seq"))).alias("seqs"), F.max(F.when(upsert, document)).alias("last")
        )
        # both sides have one row for a name
        both = old.unionByName(new).groupBy(*self.columns).agg(F.max("gone").alias("gone"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("seqs")))).alias("seqs"), F.max("last").alias("last"))
        after = F.filter("seqs", lambda s: F.col("gone").isNull() | (s > F.col("gone")))
        both.withColumn("seqs", after).withColumn("last", F.when(F.size("seqs") > 0, F.col("last"))).write.parquet(f"{self.at.place}/{folder}/documents")
        # what was there before the batch stands for its events: the first upsert of each document, and the last
        first = old.where(F.size("seqs") > 0)
        events = first.select(*self.columns, F.explode(F.array_distinct(F.array(F.element_at("seqs", 1), "last.seq"))).alias("seq"), "last.kb_id", "last.chunk_count", "last.text_hash", F.lit("upsert").alias("op"))
        every = batch.select(*self.columns, "seq", "kb_id", F.col("chunk_count").cast("int").alias("chunk_count"), "text_hash", "op").unionByName(events)
        found = before.withColumn("known", F.lit(1)).unionByName(registry.settings(every, self.by).withColumn("known", F.lit(0)))
        # of the same event the place that was found at its time
        best = F.max(F.struct("set_at", "known", "place")).alias("best")
        kept = (found.groupBy(*self.by).agg(best) if self.by else found.agg(best).where("best IS NOT NULL")).select(*self.by, "best.set_at", "best.place")
        kept.write.parquet(f"{self.at.place}/{folder}/chosen")

    def current(self) -> DataFrame:
        """The documents there are, as `registry.current` gives them."""
        _, manifest = self.at.latest()
        live = self._documents(manifest).where(F.size("seqs") > 0).withColumn("since", F.element_at("seqs", 1))
        placed = running(live, self.by, ["since"])
        return placed.select(*self.columns, "last.kb_id", "last.chunk_count", "last.text_hash", F.col("position").cast("int").alias("position"))

    def active(self) -> DataFrame:
        """The active documents, as `registry.active` gives them."""
        return registry.active_of(self.current(), self._chosen(self.at.latest()[1]), self.by)

    def start(self, stream: DataFrame, checkpoint: str):
        """Start a query that takes in what is there and ends."""
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
