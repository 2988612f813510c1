"""The bounded sample of labelled documents that classifiers learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.plans.storage import materialize


def held_out(doc_id="doc_id") -> F.Column:
    """Whether a document is kept from learning: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int) -> DataFrame:
    """doc_id, text and y (0 or 1) of labelled documents outside the held-out part, in the order of a hash of their id.

    Bounded by three documented parameters of the callers' Training: at most `most` documents, none of over
    a sixteenth of `most_bytes`, and `most_bytes` of text together.  Labels that contradict each other
    count as 1; of rows that repeat an id one text is taken, chosen by its hash.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), f"sample-{label}")
    text = F.coalesce("text", F.lit(""))
    # at most `most` rows of two numbers: a bounded broadcast
    found = docs.select("doc_id", text.alias("text")).where(F.octet_length("text") <= most_bytes // 16).join(F.broadcast(chosen), "doc_id")
    one = materialize(found.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")), f"sample-{label}")
    # a window over sizes of at most `most` documents
    before = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    few = materialize(one.select("doc_id", before.alias("total")).where(F.col("total") <= most_bytes).select("doc_id"), f"sample-{label}")
    return one.join(F.broadcast(few), "doc_id", "left_semi").select("doc_id", "text", "y")
