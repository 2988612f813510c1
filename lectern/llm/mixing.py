"""Mixing sources to target weights by capped water-filling.

Sources get shares of a word budget in proportion to their weights; a source whose share passes
`max_epochs` times its own size stops there and the excess goes to the others by weight until none
is above its cap.  The level is found in closed form: with sources in order of cap / weight, the
first one whose cap the remaining budget per remaining weight does not reach ends the clamped part.

A source whose target is r times its size takes every document floor(r) times (whole repetitions)
and, in a seeded order, further documents until the rest of the target is used up; the document on
the border gives its first words only (a fractional repetition), so that each source's taken words
equal its target rounded.  The order is cut into 4,096 slots by hash: slot sums find the border slot
and only its documents are sorted, so no source, however large, is sorted in one task.

Nulls: a null text has size 0; a null source is a source of its own that comes last.  Rows that
repeat are documents of their own.  An empty table gives an empty result.  Columns of the input
named like an output column are dropped from the result; of the text only its size is read, other columns
aren't.  Texts of any length count whole.  Ties: documents at equal places of the seeded order follow each
other by hash, id and size; rows that are equal in all of these may take each other's part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.plans.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SEED = "mix-1"


def sized(docs: DataFrame, seed: str = SEED, key: str = "doc_id") -> DataFrame:
    """doc_id, source, size in words, and the seeded place in the order, from a hash of column key: slot and key."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), key.alias("key")).withColumn("slot", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))


def targets(totals: DataFrame, share: float = 1.5, max_epochs: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Water-filling over one row per source (source, source_size): adds the double column target.

    One row per source passes through a single window; documents never do.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double")
    named = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    left = budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    free = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = named.withColumn("level", left / free)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    # levels never fall while sources are clamped, so the first that fits is the least that fits
    first = F.first(fits, ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(first.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), first * F.col("weight")))
    return levels.withColumn("target", target).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, share: float = 1.5, max_epochs: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED, key: str = "doc_id") -> DataFrame:
    """doc_id, source, size, source_size, target, whole (repetitions), part (words of a further one), taken."""
    base = materialize(sized(docs, seed, key), "mix-sized")
    slots = materialize(base.groupBy("source", "slot").agg(F.sum("size").alias("slot_size")), "mix-slots")
    plan = targets(slots.groupBy("source").agg(F.sum("slot_size").alias("source_size")), share, max_epochs, weights)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    in_order = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    reached = slots.withColumn("before", F.coalesce(F.sum("slot_size").over(in_order), F.lit(0)))
    border = (
        reached.alias("s")
        .join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("before") < F.col("rest")) & (F.col("before") + F.col("slot_size") >= F.col("rest")))
        .select(F.col("p.source").alias("b_source"), F.col("slot").alias("b_slot"), (F.col("rest") - F.col("before")).alias("b_left"))
    )
    cut = materialize(
        plan.join(border, F.col("source").eqNullSafe(F.col("b_source")), "left").select(
            F.col("source").alias("p_source"), "source_size", "target", "whole", F.coalesce("b_slot", F.lit(-1)).alias("b_slot"), F.coalesce("b_left", F.lit(0)).alias("b_left")
        ),
        "mix-plan",
    )
    placed = base.join(cut, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    plain = placed.where(F.col("slot") != F.col("b_slot")).withColumn("part", F.when(F.col("slot") < F.col("b_slot"), F.col("size")).otherwise(F.lit(0)))
    rows = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.where(F.col("slot") == F.col("b_slot")).withColumn("so_far", F.coalesce(F.sum("size").over(rows), F.lit(0)))
    edge = edge.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("b_left") - F.col("so_far")))).drop("so_far")
    out = plain.unionByName(edge).withColumn("part", F.col("part").cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "whole", "part", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """The contract's mix of all documents: 150 % of all words, at most two epochs of a source."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
slotted AS (SELECT *, ('0x' || substr(key, 1, 3))::INT AS slot FROM sized),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         source_size::DOUBLE * 2 AS cap FROM totals),
levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5 - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighted WINDOW w AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fit AS (SELECT (SELECT level FROM levels WHERE level * weight <= cap ORDER BY cap / weight, source ASC NULLS LAST LIMIT 1) AS level),
plan AS (
  SELECT l.source, source_size, CASE WHEN f.level IS NULL THEN cap ELSE least(cap, f.level * weight) END AS target FROM levels l, fit f),
quota AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM plan),
rests AS (SELECT *, round(target - whole * source_size)::BIGINT AS rest FROM quota),
placed AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, r.whole, r.rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM slotted s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM placed
"""
