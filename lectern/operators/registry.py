"""The collection of indexed documents, and its messages, as append-only event rows.

A registry is what its events add up to: events (seq, op, source_name, kb_id, chunk_count, text_hash),
op 'upsert', 'delete' or 'select'. The latest event of a name wins; a name keeps the place it first took since it
was last absent. Everything is an aggregate by name, so any number of events scales.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.ordered import running
from lectern.plans.storage import merged


def _live(events: DataFrame, by: list[str]) -> DataFrame:
    """by columns, source_name, last (the latest upsert), since (the first one after the last delete) of the documents there are."""
    row = F.struct("seq", "kb_id", "chunk_count", "text_hash")
    last_delete = F.max(F.when(F.col("op") == "delete", F.col("seq"))).over(Window.partitionBy(*by, "source_name"))
    live = events.withColumn("_gone", last_delete).where((F.col("op") == "upsert") & (F.col("_gone").isNull() | (F.col("seq") > F.col("_gone"))))
    return live.groupBy(*by, "source_name").agg(F.max(row).alias("last"), F.min("seq").alias("since"))


def current(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by columns, source_name, kb_id, chunk_count, text_hash, position (from 0) of the documents there are.

    Positions are counted by ranges of (by, since), so neither a large workspace nor the lack of any is one task's work.
    Events whose name is null make a document of no name; repeated events change nothing; no events give no rows.
    """
    by = by or []
    placed = running(_live(events, by), by, ["since"])
    return placed.select(*by, "source_name", "last.kb_id", "last.chunk_count", "last.text_hash", F.col("position").cast("int").alias("position"))


def settings(events: DataFrame, by: list[str]) -> DataFrame:
    """by columns, set_at, place: the last event that chose the active document, and that document's position then.

    Upserts choose theirs; so does an event of op 'select' whose document is there at its time.
    """
    own = Window.partitionBy(*by, "source_name").orderBy("seq")
    before = F.last(F.when(F.col("op").isin("upsert", "delete"), F.col("op")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    chosen = events.withColumn("_before", before).where((F.col("op") == "upsert") | ((F.col("op") == "select") & (F.col("_before") == "upsert")))
    last = chosen.groupBy(*by).agg(F.max(F.struct("seq", "source_name")).alias("_set"))
    last = last.select(*by, F.col("_set.seq").alias("set_at"), F.col("_set.source_name").alias("_name"))
    then = _live(_with(events, last, by).where(F.col("seq") <= F.col("set_at")).select(*events.columns), by)
    mine = _with(then, last, by).where(F.col("source_name").eqNullSafe(F.col("_name"))).select(*by, "set_at", F.col("since").alias("_mine"))
    return _with(then, mine, by).groupBy(*by, "set_at").agg(F.count(F.when(F.col("since") < F.col("_mine"), 1)).alias("place"))


def _with(rows: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """rows with what other, one row for each workspace, has for theirs; other is a single row where there are no workspaces."""
    return rows.join(other, by) if by else rows.crossJoin(other)


def active(events: DataFrame, by: list[str], chosen: DataFrame | None = None) -> DataFrame:
    """by columns, source_name, kb_id, position of the active document of each workspace that has documents.

    The active place is a number: it is set by the last upsert or selection, stays when an earlier document
    goes, and moves to the last one when it would lie past the end. Since only deletions follow that event,
    the place now is the lesser of the place then and the last place.
    """
    now = current(events, by)
    return active_of(now, settings(events, by) if chosen is None else chosen, by)


def active_of(now: DataFrame, chosen: DataFrame, by: list[str]) -> DataFrame:
    """The same from current documents and `settings`."""
    last = now.groupBy(*by).agg(F.max("position").alias("_last"))
    place = _with(last, chosen, by).select(*by, F.least("_last", "place").cast("int").alias("position"))
    return now.join(place, [*by, "position"]).select(*by, "source_name", "kb_id", "position")


def live_messages(events: DataFrame, messages: DataFrame, by: list[str]) -> DataFrame:
    """messages (by columns, source_name, seq, ...) that their document still has: an upsert begins an empty history, a deletion ends it."""
    since = _live(events, by).select(*by, "source_name", F.col("last.seq").alias("_last"))
    return messages.join(since, [*by, "source_name"]).where(F.col("seq") > F.col("_last")).drop("_last")


def upsert(events: DataFrame, rows: DataFrame) -> DataFrame:
    """events with rows (source_name, kb_id, chunk_count, text_hash, seq) put in."""
    return events.unionByName(rows.withColumn("op", F.lit("upsert")).select(*events.columns))


def delete_at(documents: DataFrame, position: int, active: int) -> tuple[DataFrame, int]:
    """documents (with position) without the one at a place, and the new active place; out of range changes nothing."""
    n = documents.count()
    if not 0 <= position < n:
        return documents, active
    rest = documents.where(F.col("position") != position)
    moved = rest.withColumn("position", F.when(F.col("position") > position, F.col("position") - 1).otherwise(F.col("position")))
    return moved, max(0, min(active, n - 2))


def active_document(documents: DataFrame, position: int) -> DataFrame:
    """The document at a place; no row when there is none."""
    return documents.where(F.col("position") == position)


def append_turn(messages: DataFrame, answers: DataFrame, turns: DataFrame) -> DataFrame:
    """messages with a user row and an assistant row for each answer (kb_id, q_id, question, answer_text, attr_text, extras).

    turns: kb_id, next_turn. Questions of a collection follow each other by q_id; plain text only.
    """
    order = F.row_number().over(Window.partitionBy("kb_id").orderBy("q_id")) - 1
    numbered = merged(answers, turns, ["kb_id"], "left").withColumn("turn", F.coalesce("next_turn", F.lit(0)) + 2 * order)
    none = F.lit(None).cast("string")
    extras = F.lit(None).cast(answers.schema["extras"].dataType)
    user = numbered.select("kb_id", "turn", F.lit("user").alias("role"), F.col("question").alias("content"), none.alias("answer_text"), none.alias("attr_text"), extras.alias("extras"))
    reply = numbered.select("kb_id", (F.col("turn") + 1).alias("turn"), F.lit("assistant").alias("role"), none.alias("content"), "answer_text", "attr_text", "extras")
    return messages.unionByName(user).unionByName(reply)
