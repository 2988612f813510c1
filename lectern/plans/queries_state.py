"""Registered queries of what is kept between runs: ledger, vectors, registry; and of inputs that the other queries' tables lack."""

from __future__ import annotations

import hashlib
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.config import SMALL
from lectern.functions import gates
from lectern.functions import text as T
from lectern.operators import answer, chunking, registry, retrieve
from lectern.operators.vector_lists import Lists
from lectern.plans import queries_index as Q
from lectern.plans.ledger import Ledger
from lectern.plans.queries_text import _TURNS, DEDUP, SENTENCES, _read, _text, _turns
from lectern.plans.storage import materialize, new_path, release
from lectern.plans.vector_table import VectorTable
from lectern.providers import FunctionGenerator, HashingEmbedder
from lectern.streaming.registry import RegistryStream


def _digest(prompt: str) -> str:
    """A model that SQL can follow."""
    return "answer " + hashlib.md5(prompt.encode()).hexdigest()


def ledger_answers(spark, d):
    """Every assistant turn's prompt answered through a ledger; how many calls the first asking made, and the second."""
    rows = materialize(_turns(spark, d).select("conv_id", "turn", gates.local_prompt("evidence", "text").alias("prompt")), "prompts")
    ledger = Ledger(spark, new_path(spark, "ledger"), "digest", partial(FunctionGenerator, _digest), in_flight=64, calls_per_task=512)
    first, again = ledger.ask(rows.select("prompt")), ledger.ask(rows.select("prompt"))
    return ledger.answered(rows, "prompt", "answer").select("conv_id", "turn", "answer", F.lit(first).cast("long").alias("first_calls"), F.lit(again).cast("long").alias("again_calls"))


def vectors_once(spark, d):
    """Sentences of every document by a table of vectors; how many texts were encoded for documents of even ids, for all, and for all once more."""
    rows = materialize(_read(spark, d, "documents").select("doc_id", F.explode(T.split_sentences("text")).alias("text")), "sentences")
    table = VectorTable(spark, new_path(spark, "vectors"), "hashing", HashingEmbedder)
    counts = [table.learn(rows.where(cond).select("text")) for cond in ("doc_id % 2 = 0", "true", "true")]
    found = table.embedded(rows, "text", "vector")
    per = found.groupBy("doc_id").agg(F.count("vector").alias("n_vectors"), F.countDistinct("text").alias("n_texts"))
    return per.select("*", *(F.lit(n).cast("long").alias(f"encoded_{k}") for k, n in enumerate(counts)))


def _events(spark, d) -> DataFrame:
    """Upserts, selections and deletions; the last twenty of each thousand are deletions."""
    e = _read(spark, d, "events")
    op = F.when((F.col("event_id") % 1000 >= 980) | (F.col("event_id") % 7 == 3), "delete").when(F.col("event_id") % 11 == 5, "select").otherwise("upsert")
    return e.select(
        F.concat("event_type", (F.col("user_id") % 7).cast("string")).alias("workspace"), F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("source_name"),
        F.md5(F.col("event_id").cast("string").cast("binary")).alias("kb_id"), (F.col("event_id") % 9 + 2).cast("int").alias("chunk_count"), F.lit("h").alias("text_hash"),
    )


def _with_active(now: DataFrame, active: DataFrame) -> DataFrame:
    marks = active.select("workspace", "position", F.lit(True).alias("active"))
    return now.join(marks, ["workspace", "position"], "left").select("workspace", "source_name", "kb_id", "chunk_count", F.col("position").cast("long").alias("position"), F.coalesce("active", F.lit(False)).alias("active"))


def registry_documents(spark, d):
    """Documents of every workspace, in place, and which is active."""
    events = materialize(_events(spark, d), "events")
    return _with_active(registry.current(events, ["workspace"]), registry.active(events, ["workspace"]))


def registry_stream(spark, d):
    """The same from a stream of the events in four batches, restarted after each."""
    events = _events(spark, d)
    source, state, mark = (new_path(spark, f"registry-{x}") for x in ("events", "state", "mark"))
    most = events.agg(F.max("seq")).first()[0]
    at = RegistryStream(spark, state, ["workspace"])
    if most is not None:
        for k in range(4):
            events.where(F.col("seq").between(k * (most + 1) // 4, (k + 1) * (most + 1) // 4 - 1)).write.mode("append").parquet(source)
            at.start(spark.readStream.schema(events.schema).parquet(source), mark).awaitTermination()
    return _with_active(at.current(), at.active())


def registry_messages(spark, d):
    """Messages (one for each event, three places later) that their document still has."""
    events = _events(spark, d)
    messages = events.select("workspace", "source_name", (F.col("seq") + 3).alias("seq"))
    return registry.live_messages(events, messages, ["workspace"])


def registry_numbers(spark, d):
    """All documents of all workspaces numbered as one collection: positions without a workspace."""
    return registry.current(_events(spark, d)).select("source_name", "kb_id", F.col("position").cast("long").alias("position"))


def _formula_documents(spark, d) -> DataFrame:
    """Documents with display formulas at the start of sentences and inside them."""
    text = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(". \\[ a = b \\] ")), F.lit(", "), F.lit(" \\[ c \\], "))
    return Q._documents(spark, d).withColumn("text", text)


def answers_with_formulas(spark, d):
    """Answers, supporting passages and markup over documents with formulas."""
    asks = Q._asks(spark, d)
    chunks = materialize(chunking.chunks(_formula_documents(spark, d), SMALL), "chunks")
    index = retrieve.build_index(chunks, SMALL, asks=asks)
    release(chunks)  # all parts of the index are written
    found = answer.answers(retrieve.rerank(retrieve.hybrid(index, asks, SMALL), SMALL), SMALL).where("relevant")
    return found.select("q_id", "kb_id", "answer_text", "focused", "answer_html", "evidence", F.size("extras").alias("n_extras"))


def repeated_asks(spark, d):
    """Every question given twice: ranks are those of one."""
    asks = Q._asks(spark, d)
    found = retrieve.hybrid(Q._index(spark, d, asks), asks.unionByName(asks), SMALL)
    return found.select("q_id", "kb_id", "chunk_idx", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def short_documents(spark, d):
    """Documents cut to their first characters, a tenth of them null: each has a row and, where it is too short, the message."""
    docs = Q._documents(spark, d, False).withColumn("text", F.when(F.col("kb_id") % 10 > 0, F.substring("text", F.lit(1), (F.col("kb_id") % 97 * 20).cast("int"))))
    return chunking.indexable(docs, chunking.chunks(docs, SMALL), SMALL)


def lists_topk(spark, d):
    """The five nearest of all vectors to each vector whose id is divisible by 50, by lists with bounds."""
    e = _read(spark, d, "embeddings").select("vec_id", "embedding")
    q = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_embedding"))
    return Lists.fit(e).search(q, 5, probes=4, exact=True).select("q_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


QUERIES = {f.__name__: f for f in (
    lists_topk, ledger_answers, vectors_once, registry_documents, registry_stream, registry_messages, registry_numbers, answers_with_formulas, repeated_asks, short_documents,
)}


_EVENTS_SQL = """WITH e AS (
  SELECT event_type || (user_id % 7) AS workspace, event_id AS seq, user_id::VARCHAR AS source_name, (event_id % 9 + 2)::INT AS chunk_count,
         CASE WHEN event_id % 1000 >= 980 OR event_id % 7 = 3 THEN 'delete' WHEN event_id % 11 = 5 THEN 'select' ELSE 'upsert' END AS op FROM events)"""
_NOW_SQL = """gone AS (SELECT {by}source_name, max(seq) AS gone FROM e WHERE op = 'delete' GROUP BY ALL),
last_ AS (
  SELECT {by}source_name, max(seq) AS seq, min(seq) AS since FROM e LEFT JOIN gone USING ({by}source_name) WHERE op = 'upsert' AND (gone IS NULL OR seq > gone) GROUP BY ALL),
now_ AS (SELECT *, row_number() OVER ({part}ORDER BY since) - 1 AS position FROM last_)"""
_ACTIVE_SQL = f"""{_EVENTS_SQL},
{_NOW_SQL.format(by='workspace, ', part='PARTITION BY workspace ')},
seen AS (
  SELECT *, last_value(CASE WHEN op <> 'select' THEN op END IGNORE NULLS) OVER (PARTITION BY workspace, source_name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
chosen AS (SELECT workspace, max(seq) AS set_at, arg_max(source_name, seq) AS name FROM seen WHERE op = 'upsert' OR (op = 'select' AND before = 'upsert') GROUP BY workspace),
gone_then AS (SELECT workspace, source_name, max(seq) AS gone FROM e JOIN chosen USING (workspace) WHERE op = 'delete' AND seq <= set_at GROUP BY ALL),
then_ AS (
  SELECT workspace, source_name, min(seq) AS since FROM e JOIN chosen USING (workspace) LEFT JOIN gone_then USING (workspace, source_name)
  WHERE op = 'upsert' AND seq <= set_at AND (gone IS NULL OR seq > gone) GROUP BY ALL),
place AS (
  SELECT t.workspace, count(*) FILTER (WHERE t.since < m.since) AS place FROM then_ t JOIN (SELECT workspace, since FROM then_ JOIN chosen USING (workspace) WHERE source_name = name) m USING (workspace) GROUP BY ALL)
SELECT workspace, source_name, md5(seq::VARCHAR) AS kb_id, (seq % 9 + 2)::INT AS chunk_count, position, coalesce(position = least(place, max(position) OVER (PARTITION BY workspace)), false) AS active
FROM now_ LEFT JOIN place USING (workspace)"""
_PROMPT_SQL = f"{_text(gates.LOCAL_PROMPT)} || text || chr(10) || chr(10) || 'QUESTION:' || chr(10) || evidence || chr(10) || chr(10) || 'ANSWER:'"
_SENTENCE_SQL = f"s AS (SELECT doc_id, unnest({SENTENCES.format('text')}) AS t FROM documents)"
_FORMULAS = r"documents AS (SELECT doc_id, source, replace(replace(text, '. ', '. \[ a = b \] '), ', ', ' \[ c \], ') AS text FROM main.documents)"

ORACLES = {
    "lists_topk": Q.ORACLES["dense_topk"],
    "ledger_answers": f"WITH {_TURNS}, p AS (SELECT conv_id, turn, {_PROMPT_SQL} AS prompt FROM turns) SELECT conv_id, turn, 'answer ' || md5(prompt) AS answer, (SELECT count(DISTINCT prompt) FROM p) AS first_calls, 0::BIGINT AS again_calls FROM p",
    "vectors_once": f"""WITH {_SENTENCE_SQL}, n AS (SELECT count(DISTINCT t) FILTER (WHERE doc_id % 2 = 0) AS a, count(DISTINCT t) AS b FROM s)
SELECT doc_id, count(*) AS n_vectors, count(DISTINCT t) AS n_texts, any_value(a) AS encoded_0, any_value(b - a) AS encoded_1, 0::BIGINT AS encoded_2 FROM s, n GROUP BY doc_id""",
    "registry_documents": _ACTIVE_SQL,
    "registry_stream": _ACTIVE_SQL,
    "registry_messages": f"{_EVENTS_SQL}, {_NOW_SQL.format(by='workspace, ', part='PARTITION BY workspace ')} SELECT workspace, source_name, m.seq + 3 AS seq FROM e m JOIN now_ n USING (workspace, source_name) WHERE m.seq + 3 > n.seq",
    "registry_numbers": f"{_EVENTS_SQL}, {_NOW_SQL.format(by='', part='')} SELECT source_name, md5(seq::VARCHAR) AS kb_id, position FROM now_",
    "answers_with_formulas": Q._with(_FORMULAS, *Q._TO_ANSWER, Q._EVIDENCE, Q._EXTRAS) + f"""SELECT q_id, kb_id, body AS answer_text, focused, '<div class="msg-label">grounded answer</div><p>' || {Q._ESC.format("'Grounded answer: ' || body")} || CASE WHEN focused <> '' AND focused <> body THEN '</p><p>' || {Q._ESC.format("'Supporting passage: ' || focused")} ELSE '' END || '</p><span class="match-pill ' || css || '">' || label || '</span>' AS answer_html,
coalesce(evidence, '') AS evidence, (SELECT count(*) FROM extras_ e WHERE e.q_id = a.q_id AND e.kb_id = a.kb_id)::INT AS n_extras FROM answered a LEFT JOIN packs USING (q_id, kb_id) WHERE relevant""",
    "repeated_asks": Q._with(*Q._TO_HYBRID) + "SELECT q_id, kb_id, chunk_idx, round(score, 6) AS score, rank FROM hybrid",
    "short_documents": Q._with("documents AS (SELECT doc_id, CASE WHEN doc_id % 10 > 0 THEN substr(text, 1, (doc_id % 97 * 20)::INT) ELSE '' END AS text FROM main.documents)", Q._SMALL) + "SELECT doc_id AS kb_id, count(c.kb_id) AS n_chunks, CASE WHEN count(c.kb_id) < 2 THEN 'Not enough text to index. Try a longer document.' ELSE '' END AS err FROM documents LEFT JOIN chunks0 c ON c.kb_id = doc_id GROUP BY doc_id",
}
