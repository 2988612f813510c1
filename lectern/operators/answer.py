"""From reranked chunks to answers: sentences, MMR, evidence, supporting passage, extras, markup.

Sentences stay arrays in the rows of their chunks, are embedded there, and gathered in one row for each
question; every later step is a native expression on that row, so answering adds one shuffle to retrieval,
whose candidates are written first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.config import DEFAULT, Settings
from lectern.functions import gates
from lectern.functions import text as T
from lectern.operators import vectors
from lectern.operators.retrieve import PAIR, default_embedder
from lectern.plans.ledger import Ledger
from lectern.plans.storage import materialize, new_path
from lectern.plans.vector_table import VectorTable
from lectern.providers import Embedder, Generator

#: Fixed value: the reply to a question that nothing answers.
NOTHING = "Nothing relevant found. Try rephrasing using keywords from the document."
#: Fixed value: sentences of the best chunk that stand in for a supporting passage.
FALLBACK_SENTENCES = 3


def gathered(reranked: DataFrame, cfg: Settings = DEFAULT, embedder: Callable[[], Embedder] | None = None, table: VectorTable | None = None) -> DataFrame:
    """One row per question and collection: question, and tops, an array in order of rank.

    tops: rank, chunk_idx, chunk, score, attr, sents (all sentences in order: si, sent, noise, clean, rel, emb, raw_rel).
    rel and emb are those of the sentence without a leading formula, raw_rel is that of the sentence as it stands.
    """
    cut = F.transform(T.split_sentences("chunk"), lambda s, i: F.struct(i.alias("si"), s.alias("sent"), T.is_noise_sentence(s).alias("noise")))
    cut = F.transform(cut, lambda s: F.struct(s["si"].alias("si"), s["sent"].alias("sent"), s["noise"].alias("noise"), F.when(~s["noise"], T.strip_leading_latex(s["sent"])).alias("clean")))
    rows = reranked.select(*PAIR, "question", "q_embedding", "rank", "chunk_idx", "chunk", "score", T.attribution("section", "page").alias("attr"))
    rows = materialize(rows, "candidates").withColumn("cut", cut)  # else each stage of retrieval plans all that follows anew, at the driver
    own = F.transform("cut", lambda s: F.coalesce(s["clean"], F.lit("")))
    other = F.transform("cut", lambda s: F.when(~s["noise"] & (s["clean"] != s["sent"]), s["sent"]))  # few
    if table is None:
        # one call for both, since each call is a Python worker of its own in every task
        both = vectors.embed_each(F.concat(own, other), embedder or default_embedder(cfg))
        rows = rows.withColumn("both", both).withColumns({"own": F.slice("both", F.lit(1), F.size("cut")), "other": F.slice("both", F.size("cut") + 1, F.size("cut"))})
    else:
        rows = _by_content(rows.withColumns({"own": own, "other": other}), table)
    sents = F.transform("cut", lambda s, i: F.struct(
        s["si"].alias("si"), s["sent"].alias("sent"), s["noise"].alias("noise"), s["clean"].alias("clean"), vectors.dot(F.get("own", i), "q_embedding").alias("rel"), F.get("own", i).alias("emb"),
        F.when(F.get("other", i).isNull(), vectors.dot(F.get("own", i), "q_embedding")).otherwise(vectors.dot(F.get("other", i), "q_embedding")).alias("raw_rel"),
    ))
    tops = F.struct("rank", "chunk_idx", "chunk", "score", "attr", sents.alias("sents"))
    return rows.groupBy(*PAIR, "question").agg(F.sort_array(F.collect_list(tops)).alias("tops"))


def _by_content(rows: DataFrame, table: VectorTable) -> DataFrame:
    """rows with own and other as vectors: their texts go to the table, each once, and vectors come back by place."""
    rows = materialize(rows, "cut")
    place = [*PAIR, "rank"]
    long = rows.select(*place, F.posexplode(F.transform("own", lambda x, i: F.struct(x.alias("own"), F.get("other", i).alias("other")))).alias("si", "t"))
    long = long.select(*place, F.explode(F.array(F.struct(F.lit(0).alias("kind"), "si", F.col("t.own").alias("text")), F.struct(F.lit(1).alias("kind"), "si", F.col("t.other").alias("text")))).alias("t")).select(*place, "t.*").where("text IS NOT NULL")
    found = table.embedded(long, "text", "emb").groupBy(*place).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("kind", "si").alias("k"), "emb"))).alias("found"))
    got = lambda kind: F.transform("cut", lambda s: F.element_at("found", F.struct(F.lit(kind).alias("kind"), s["si"].alias("si"))))
    return rows.drop("own", "other").join(found, place, "left").withColumns({"own": got(0), "other": got(1)}).drop("found")


def sentence_pool(tops: Column | str, cfg: Settings = DEFAULT) -> Column:
    """Sentences of the first chunks that aren't noise: ci, si, clean, chars, rel, emb."""
    first = F.slice(T.as_column(tops), 1, cfg.mmr_chunks)
    return F.flatten(F.transform(first, lambda t, ci: F.transform(
        F.filter(t["sents"], lambda s: ~s["noise"] & (s["clean"] != "")),
        lambda s: F.struct(ci.alias("ci"), s["si"].alias("si"), s["clean"].alias("clean"), F.length(s["clean"]).alias("chars"), s["rel"].alias("rel"), s["emb"].alias("emb")),
    )))


def _good(top: Column) -> Column:
    return F.filter(top["sents"], lambda s: ~s["noise"])


def _best(sents: Column, n: int) -> Column:
    """The n most relevant sentences, best first; the first of equals is better."""
    order = F.transform(sents, lambda s: F.struct((-F.round(s["raw_rel"], 9)).alias("k"), s["si"].alias("si"), s["sent"].alias("sent")))
    return F.slice(F.sort_array(order), 1, n)


def evidence_pack(tops: Column | str, cfg: Settings = DEFAULT) -> Column:
    """Lines `[place] sentence` of the best sentences, until one would pass the budget."""
    few = F.filter(F.slice(T.as_column(tops), 1, cfg.evidence_chunks), lambda t: t["score"] >= cfg.min_score)
    def lines_of(t: Column) -> Column:
        attr = F.when(t["attr"] != "", t["attr"]).otherwise(F.concat(F.lit("Chunk: "), t["chunk_idx"].cast("string")))
        texts = F.filter(F.transform(_best(_good(t), cfg.evidence_sentences), lambda s: T.remove_latex(s["sent"])), lambda s: s != "")
        return F.transform(texts, lambda s: F.concat(F.lit("["), attr, F.lit("] "), s))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("total"), F.lit(False).alias("full"))
    add = lambda a, line: F.when(
        ~a["full"] & (a["total"] + F.length(line) + 1 <= cfg.evidence_chars),
        F.struct(F.concat(a["out"], F.array(line)).alias("out"), (a["total"] + F.length(line) + 1).alias("total"), F.lit(False).alias("full")),
    ).otherwise(F.struct(a["out"].alias("out"), a["total"].alias("total"), F.lit(True).alias("full")))
    return F.aggregate(F.flatten(F.transform(few, lines_of)), start, add, lambda a: F.array_join(a["out"], "\n"))


def context_pack(tops: Column | str, max_chunks: int = 4, max_chars: int = 1800, min_score: float = 0.01) -> Column:
    """Whole chunks behind their places, the last one cut to the budget."""
    few = F.filter(F.slice(T.as_column(tops), 1, max_chunks), lambda t: t["score"] >= min_score)
    pieces = F.transform(few, lambda t: F.concat(F.when(t["attr"] != "", F.concat(F.lit("["), t["attr"], F.lit("] "))).otherwise(F.lit("")), T.normalize_ws(t["chunk"])))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("total"))
    add = lambda a, p: T.let(F.substring(p, F.lit(1), F.lit(max_chars) - a["total"]), lambda cut: F.when(
        a["total"] < max_chars, F.struct(F.concat(a["out"], F.array(cut)).alias("out"), (a["total"] + F.length(cut)).alias("total"))
    ).otherwise(a))
    return T.strip(F.aggregate(pieces, start, add, lambda a: F.array_join(a["out"], "\n\n")))


def extras(tops: Column | str, cfg: Settings = DEFAULT) -> Column:
    """array<struct<snippet, score>>: the best three sentences of each further chunk, in reading order, equal chunks once."""
    rest = F.filter(F.slice(T.as_column(tops), 2, cfg.rerank_k), lambda t: t["score"] >= cfg.min_score)
    keyed = F.transform(rest, lambda t, i: F.struct(F.lower(T.normalize_ws(F.substring(t["chunk"], 1, 200))).alias("key"), t.alias("top")))
    new = lambda rows: F.filter(rows, lambda r, i: F.array_position(F.transform(rows, lambda x: x["key"]), r["key"]) == i + 1)

    def snippet(t: Column) -> Column:
        good = _good(t)
        best = F.sort_array(F.transform(_best(good, 3), lambda s: F.struct(s["si"].alias("si"), s["sent"].alias("sent"))))
        return F.struct(T.remove_latex(F.array_join(F.transform(best, lambda s: s["sent"]), " ")).alias("snippet"), t["score"].alias("score"))

    return F.filter(F.transform(T.let(keyed, new), lambda r: snippet(r["top"])), lambda e: e["snippet"] != "")


def answers(reranked: DataFrame, cfg: Settings = DEFAULT, embedder: Callable[[], Embedder] | None = None, generator: Callable[[], Generator] | None = None, table: VectorTable | None = None, ledger: Ledger | None = None) -> DataFrame:
    """Per question and collection: answer_html, answer_text, score, extras, attr_text, and what they were made of.

    More columns: picked (sentences), sup_ci and sup_si (chunk and sentences of the most picks), focused, evidence, label.
    """
    rows = gathered(reranked, cfg, embedder, table)
    rows = rows.withColumn("pool", sentence_pool("tops", cfg))
    rows = rows.withColumn("chosen", vectors.mmr("pool", cfg.mmr_k, cfg.mmr_min_rel, cfg.mmr_lambda, cfg.mmr_max_chars))
    rows = rows.withColumn("picks", F.transform("chosen", lambda i: F.get(F.col("pool"), i))).withColumn("top", F.get("tops", 0))
    rows = rows.withColumn("score", F.col("top.score")).withColumn("attr_text", F.col("top.attr")).withColumn("relevant", F.col("score") >= cfg.min_score)
    first = F.get(_good(F.col("top")), 0)["clean"]
    fallback = F.when(F.coalesce(first, F.lit("")) != "", F.array(first)).otherwise(F.array().cast("array<string>"))
    has = F.size("picks") > 0
    rows = rows.withColumn("picked", F.when(has, F.transform("picks", lambda p: p["clean"])).otherwise(fallback))
    votes = F.transform(F.array_distinct(F.transform("picks", lambda p: p["ci"])), lambda c: F.struct(F.size(F.filter(F.col("picks"), lambda p: p["ci"] == c)).alias("n"), (-c).alias("ci")))
    rows = rows.withColumn("sup_ci", F.when(has, -F.array_max(votes)["ci"]).otherwise(F.lit(0)).cast("int"))
    rows = rows.withColumn("sup_si", F.when(has, F.transform(F.filter("picks", lambda p: p["ci"] == F.col("sup_ci")), lambda p: p["si"])))
    near = F.filter(F.get("tops", F.col("sup_ci"))["sents"], lambda s: F.exists(F.col("sup_si"), lambda i: F.abs(i - s["si"]) <= 1))
    around = T.remove_latex(T.strip_leading_latex(F.array_join(F.transform(near, lambda s: s["sent"]), " ")))
    cleaned = F.filter(F.transform(_good(F.col("top")), lambda s: s["clean"]), lambda c: c != "")
    instead = F.array_join(F.when(F.size("picked") > 0, F.col("picked")).otherwise(F.slice(cleaned, 1, FALLBACK_SENTENCES)), " ")
    rows = rows.withColumn("focused", F.when(has, around).otherwise(T.remove_latex(instead)))
    rows = rows.withColumn("evidence", evidence_pack("tops", cfg)).withColumn("extras", extras("tops", cfg))
    extractive = T.remove_latex(T.format_extractive("picked", "attr_text"))
    if (generator is None and ledger is None) or cfg.mode == "structured":
        rows = rows.withColumn("generated", F.lit(None).cast("string"))
    else:
        rows = _generated(rows, cfg, generator, ledger)
    made = F.col("generated").isNotNull()
    rows = rows.withColumn("answer_text", F.when(made, T.remove_latex("generated")).otherwise(extractive))
    rows = rows.withColumn("source_label", F.when(made, "generated answer").otherwise("grounded answer"))
    rows = rows.withColumn("match", T.match_label("score"))
    named = T.html_escape(F.concat(F.upper(F.substring("source_label", 1, 1)), F.substring("source_label", 2, 100), F.lit(": "), F.col("answer_text")))
    support = F.when((F.col("focused") != "") & (T.normalize_ws("focused") != T.normalize_ws("answer_text")), T.html_escape(F.concat(F.lit("Supporting passage: "), F.col("focused"))))
    html = F.concat(F.lit('<div class="msg-label">'), F.col("source_label"), F.lit("</div><p>"), F.concat_ws("</p><p>", named, support), F.lit('</p><span class="match-pill '), F.col("match.css_class"), F.lit('">'), F.col("match.label"), F.lit("</span>"))
    good = F.col("relevant")
    return rows.select(
        *PAIR, "question",
        F.when(good, html).otherwise(F.lit(f"<p>{NOTHING}</p>")).alias("answer_html"),
        F.when(good, F.col("answer_text")).otherwise(F.lit(NOTHING)).alias("answer_text"),
        F.when(good, F.col("score")).otherwise(F.lit(0.0)).alias("score"),
        F.when(good, F.col("extras")).otherwise(F.array().cast("array<struct<snippet:string,score:double>>")).alias("extras"),
        F.when(good, F.col("attr_text")).otherwise(F.lit("")).alias("attr_text"),
        "picked", "sup_ci", "sup_si", "focused", "evidence", F.col("match.label").alias("label"), "relevant",
    )


def _generated(rows: DataFrame, cfg: Settings, make: Callable[[], Generator], ledger: Ledger | None) -> DataFrame:
    """rows with generated: an answer that passed its gates, or null. Calls are made once, into a ledger, before anything reads them."""
    hosted = cfg.mode == "hosted"
    prompt = gates.hosted_prompt if hosted else gates.local_prompt
    gate = gates.hosted_answer if hosted else gates.local_answer
    rows = materialize(rows, "to-generate")
    ledger = ledger or Ledger(rows.sparkSession, new_path(rows.sparkSession, "ledger"), cfg.mode, make)
    raw = ledger.answered(rows.where("relevant").withColumn("_prompt", prompt("question", "evidence")), "_prompt", "_raw")
    made = raw.withColumn("generated", gate("_raw", "evidence")).drop("_raw", "_prompt")
    return made.unionByName(rows.where("NOT relevant").withColumn("generated", F.lit(None).cast("string")))
