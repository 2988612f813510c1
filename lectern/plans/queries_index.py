"""Registered queries of chunking, indexing, retrieval and answering.

Every document is a collection of its own (chunks of 100 words, overlap 10), and is asked one
benchmark question, by an equi-join on the question's number, so that work grows with the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.config import DEFAULT, SMALL
from lectern.functions import text as T
from lectern.operators import answer, chunking, registry, retrieve, tfidf, vectors
from lectern.plans import store
from lectern.plans.queries_text import DEDUP, NOISE, NORM, SENTENCES
from lectern.plans.storage import materialize, new_path, release
from lectern.providers import OverlapReranker


def _documents(spark: SparkSession, d: str, maps: bool = True) -> DataFrame:
    """Documents as collections. Every third chunk place from 1 on has a section entry, every second a page."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("kb_id"), "text", "source")
    if not maps:
        return docs
    section = F.map_from_entries(F.transform(F.sequence(F.lit(1), F.lit(31), F.lit(3)), lambda i: F.struct(i, F.concat(F.col("source"), F.lit(" part "), i.cast("string")))))
    page = F.map_from_entries(F.transform(F.sequence(F.lit(0), F.lit(30), F.lit(2)), lambda i: F.struct(i, (i + F.col("kb_id") % 5 + 1).cast("int"))))
    return docs.withColumn("section_map", section).withColumn("page_map", F.when(F.col("kb_id") % 2 == 0, page))


def _chunks(spark, d, maps: bool = True) -> DataFrame:
    return chunking.chunks(_documents(spark, d, maps), SMALL)


def _asks(spark, d) -> DataFrame:
    """q_id, kb_id, question: the benchmark item whose number is the collection's modulo the number of items."""
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("q_id"), F.col("text").alias("question"))
    n = items.count()
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("kb_id"), (F.col("doc_id") % n).alias("q_id")).join(items, "q_id").select("q_id", "kb_id", "question")


def _index(spark, d, asks: DataFrame | None = None) -> retrieve.Index:
    """The index of all documents' chunks; with asks for these questions alone."""
    chunks = materialize(_chunks(spark, d), "chunks")
    index = retrieve.build_index(chunks, SMALL, asks=asks)
    release(chunks)  # all parts of the index are written
    return index


def _hybrid(spark, d) -> DataFrame:
    asks = _asks(spark, d)
    return retrieve.hybrid(_index(spark, d, asks), asks, SMALL)


def _answers(spark, d) -> DataFrame:
    return answer.answers(retrieve.rerank(_hybrid(spark, d), SMALL), SMALL)


def chunk_docs_default(spark, d):
    return chunking.chunks(_documents(spark, d, False), DEFAULT).select("kb_id", "chunk_idx", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


def chunk_docs_small(spark, d):
    return _chunks(spark, d, False).select("kb_id", "chunk_idx", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


def indexable(spark, d):
    docs = _documents(spark, d, False)
    return chunking.indexable(docs, chunking.chunks(docs, SMALL), SMALL)


def attributed_chunks(spark, d):
    c = _chunks(spark, d)
    return c.select("kb_id", "chunk_idx", "section", "page", T.attribution("section", "page").alias("attr"), F.md5(F.col("embed_text").cast("binary")).alias("embed_md5"))


def asof_section(spark, d):
    """The join for maps of any size: chunk places against section rows."""
    places = _chunks(spark, d, False).select("kb_id", "chunk_idx")
    rows = _documents(spark, d).select("kb_id", F.explode("section_map").alias("para_idx", "section"))
    return chunking.as_of_join(places, rows, ["kb_id"], "chunk_idx", "para_idx", "section")


def tfidf_vocab(spark, d):
    v, _ = tfidf.index_terms(materialize(_chunks(spark, d), "chunks"), SMALL)
    return v.select("kb_id", "term", "df", "cf", F.round("idf", 6).alias("idf"))


def tfidf_weights(spark, d):
    _, w = tfidf.index_terms(materialize(_chunks(spark, d), "chunks"), SMALL)
    return w.select("kb_id", "chunk_idx", "term", F.round("weight", 6).alias("weight"))


def sparse_scores(spark, d):
    asks = _asks(spark, d)
    s = retrieve.sparse_scores(_index(spark, d, asks), asks)
    return s.select("q_id", "kb_id", "chunk_idx", F.round("sparse", 6).alias("sparse"))


def score_sentences(spark, d):
    """TF-IDF cosine of a question with every sentence of its collection's chunks."""
    c = materialize(_chunks(spark, d), "chunks")
    vocab, _ = tfidf.index_terms(c, SMALL)
    sents = c.select("kb_id", "chunk_idx", F.posexplode(T.split_sentences("chunk")).alias("si", "sent"))
    asked = materialize(tfidf.text_weights(_asks(spark, d), ["q_id", "kb_id"], "question", vocab), "ask-weights")
    place = ["kb_id", "chunk_idx", "si"]
    weighed = tfidf.text_weights(sents, place, "sent", vocab, only=asked)  # of a sentence's terms those that are asked for
    scored = tfidf.cosine(asked, weighed, ["q_id", "kb_id"], place)
    return scored.select("q_id", *place, F.round("cosine", 6).alias("cosine"))


def dense_topk(spark, d):
    """The five nearest of all vectors to each vector whose id is divisible by 50."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    q = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_embedding"))
    return vectors.dense_topk(e, q, 5).select("q_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


def mmr_select(spark, d):
    """MMR over pools of all vectors of each label and block of 200 ids; the first vector is the question."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").withColumn("block", F.floor(F.col("vec_id") / 200))
    pool = e.groupBy("label", "block").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("p"))
    first = F.get("p", 0)["embedding"]
    rows = F.transform("p", lambda x: F.struct(x["vec_id"].alias("vec_id"), F.round(vectors.dot(x["embedding"], first), 9).alias("rel"), x["embedding"].cast("array<double>").alias("emb"), (F.lit(150) + x["vec_id"] % 140).cast("int").alias("chars")))
    chosen = pool.withColumn("pool", rows).withColumn("chosen", vectors.mmr("pool", min_rel=-1.0))
    return chosen.select("label", "block", F.array_join(F.transform("chosen", lambda i: F.get(F.col("pool"), i)["vec_id"].cast("string")), ",").alias("chosen"))


def hybrid_topk(spark, d):
    return _hybrid(spark, d).select("q_id", "kb_id", "chunk_idx", F.round("dense", 6).alias("dense"), F.round("sparse", 6).alias("sparse"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


#: Words of an item's inside by which documents are found.
_KEY_WORDS = 6


def rerank_pairs(spark, d):
    """Candidates ranked anew by a pair scorer; their scores stay those of retrieval."""
    r = retrieve.rerank(_hybrid(spark, d), SMALL, OverlapReranker)
    return r.select("q_id", "kb_id", "chunk_idx", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _runs_of_words(n: int) -> Column:
    """The distinct runs of n words of an array w."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " ")))


def _holding(spark, d) -> DataFrame:
    """asks of every item to the documents whose text, with single spaces, contains it.

    A match may begin and end within a word, but all words between are whole: documents are found by up
    to six of these. Items of one or two words have none; this stated query set is held against all documents.
    """
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("q_id"), F.col("text").alias("question")).where("question IS NOT NULL")
    items = items.withColumn("w", T.words("question")).withColumn("length", F.least(F.size("w") - 2, F.lit(_KEY_WORDS)))
    keyed = items.where("length > 0").withColumn("key", F.array_join(F.slice("w", 2, F.col("length")), " "))
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("kb_id"), T.normalize_ws("text").alias("whole")).withColumn("w", F.split("whole", " "))
    holds = F.contains(F.col("whole"), T.normalize_ws("question"))
    found = docs.join(items.where("length <= 0"), holds).select("q_id", "kb_id", "question")
    for n in [r[0] for r in keyed.select("length").distinct().collect()]:  # six at most
        keys = docs.where(F.size("w") >= n).select("kb_id", F.explode(_runs_of_words(n)).alias("key"))
        near = keys.join(keyed.where(F.col("length") == n), "key").select("q_id", "kb_id", "question")
        found = found.unionByName(near.join(docs, "kb_id").where(holds).select("q_id", "kb_id", "question"))
    return found


def retrieval_recall(spark, d):
    """Per item: how many documents hold it word for word, and in how many one of the first five chunks has half of its words."""
    holds = materialize(_holding(spark, d), "holding")
    top = retrieve.hybrid(_index(spark, d, holds), holds, SMALL).where("rank <= 5")
    words = F.array_distinct(T.words("question"))
    share = F.size(F.array_intersect(words, T.words("chunk"))) / F.size(words)
    best = top.groupBy("q_id", "kb_id").agg(F.max(share).alias("share"))
    return holds.join(best, ["q_id", "kb_id"], "left").groupBy("q_id").agg(F.count(F.lit(1)).alias("n_holding"), F.count(F.when(F.col("share") >= 0.5, 1)).alias("n_found"))


def extractive_answer(spark, d):
    a = _answers(spark, d)
    return a.select("q_id", "kb_id", "answer_text", F.round("score", 6).alias("score"), "attr_text", "label")


def answer_html(spark, d):
    return _answers(spark, d).select("q_id", "kb_id", "answer_html")


def focused_passage(spark, d):
    return _answers(spark, d).where("relevant").select("q_id", "kb_id", "focused", "sup_ci")


def evidence_pack(spark, d):
    return _answers(spark, d).where("relevant").select("q_id", "kb_id", "evidence")


def extras(spark, d):
    e = _answers(spark, d).select("q_id", "kb_id", F.posexplode("extras").alias("n", "e"))
    return e.select("q_id", "kb_id", "n", "e.snippet", F.round("e.score", 6).alias("score"))


def context_pack(spark, d):
    rows = answer.gathered(retrieve.rerank(_hybrid(spark, d), SMALL))
    return rows.select("q_id", "kb_id", answer.context_pack("tops").alias("context"))


def message_history(spark, d):
    """Messages after one more question in every collection that has an answer."""
    done = materialize(_answers(spark, d).select("q_id", "kb_id", "question", "answer_text", "attr_text", "extras"), "answers")
    turns = done.select("kb_id").distinct().withColumn("next_turn", (F.col("kb_id") % 3 * 2).cast("int"))
    none = F.lit(None).cast("string")
    old = turns.where("next_turn > 0").select("kb_id", F.explode(F.sequence(F.lit(0), F.col("next_turn") - 1)).alias("turn")).select(
        "kb_id", "turn", F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("earlier").alias("content"), none.alias("answer_text"), none.alias("attr_text"), F.lit(None).cast(done.schema["extras"].dataType).alias("extras")
    )
    return registry.append_turn(old, done, turns).select("kb_id", "turn", "role", "content", "answer_text", "attr_text", F.size("extras").alias("n_extras"))


def _stored(spark, d) -> retrieve.Index:
    """An index that was stored in two parts, the second over some of the first, and read back."""
    index, path = _index(spark, d), new_path(spark, "index")
    store.save(index.where("kb_id % 3 <> 0"), path, SMALL, slots=8)
    store.save(index.where("kb_id % 3 <> 1"), path, SMALL, slots=8)
    return store.load(spark, path, SMALL)


def index_roundtrip(spark, d):
    """Postings of a stored index."""
    return _stored(spark, d).postings.select("kb_id", "chunk_idx", "term", F.round("weight", 6).alias("weight"))


def vocabulary_roundtrip(spark, d):
    """The vocabulary of a stored index, through its JSON export."""
    rows = store.vocabulary_json(_stored(spark, d)).select("kb_id", F.from_json("json", "terms array<struct<term:string,idf:double>>").alias("j"))
    return rows.select("kb_id", F.posexplode("j.terms").alias("number", "t")).select("kb_id", "number", "t.term", F.round("t.idf", 6).alias("idf"))


def missing_index(spark, d):
    index = _index(spark, d)
    stored = retrieve.Index(*(getattr(index, p).where("kb_id % 4 = 0") for p in store.PARTS))
    return store.missing(_documents(spark, d, False).select("kb_id"), stored)


QUERIES = {f.__name__: f for f in (
    chunk_docs_default, chunk_docs_small, indexable, attributed_chunks, asof_section, tfidf_vocab, tfidf_weights, sparse_scores, score_sentences, dense_topk, mmr_select, hybrid_topk,
    retrieval_recall, extractive_answer, answer_html, focused_passage, evidence_pack, extras, context_pack, message_history, rerank_pairs, index_roundtrip, vocabulary_roundtrip, missing_index,
)}


def _fold(size: int, overlap: int) -> str:
    """Chunks of deduplicated documents: one step of the recursion for each paragraph."""
    limit, stride = int(size * 1.5), size - overlap
    return rf"""{DEDUP},
paras AS (SELECT doc_id, list(list_filter(string_split_regex(line, '\s+'), lambda x: x <> '') ORDER BY pos) AS ps FROM deduped GROUP BY doc_id),
fold AS (
  SELECT doc_id, ps, 0 AS i, []::VARCHAR[] AS cur, []::VARCHAR[] AS out FROM paras
  UNION ALL
  SELECT doc_id, ps, i + 1, base[n * {stride} + 1:], list_concat(out, before, list_transform(range(0, n), lambda k: array_to_string(base[k * {stride} + 1:k * {stride} + {size}], ' '))) FROM (
    SELECT *, greatest(0, ceil((len(base) - {limit}) / {stride}))::INT AS n FROM (
      SELECT doc_id, ps, i, out, CASE WHEN len(cur) > 0 AND len(cur) + len(ps[i + 1]) > {size} THEN list_concat(cur[greatest(1, len(cur) - {overlap - 1}):], ps[i + 1]) ELSE list_concat(cur, ps[i + 1]) END AS base,
             CASE WHEN len(cur) > 0 AND len(cur) + len(ps[i + 1]) > {size} THEN [array_to_string(cur, ' ')] ELSE []::VARCHAR[] END AS before
      FROM fold WHERE i < len(ps)))),
folded AS (
  SELECT doc_id AS kb_id, list_filter(list_concat(out, CASE WHEN len(cur) > 0 THEN [array_to_string(cur, ' ')] ELSE []::VARCHAR[] END), lambda c: length(trim(c)) >= 20) AS cs FROM fold WHERE i = len(ps)),
chunks0 AS (SELECT kb_id, unnest(cs) AS chunk, (generate_subscripts(cs, 1) - 1)::INT AS chunk_idx FROM folded)"""


_ATTR = """chunks AS (
  SELECT *, CASE WHEN section <> '' THEN section || '. ' || chunk ELSE chunk END AS embed_text,
         concat_ws('  ·  ', CASE WHEN section <> '' THEN '§ ' || section END, CASE WHEN page IS NOT NULL THEN 'p. ' || page END) AS attr FROM (
    SELECT kb_id, chunk_idx, chunk, CASE WHEN chunk_idx >= 1 THEN source || ' part ' || least(31, (chunk_idx - 1) // 3 * 3 + 1) ELSE '' END AS section,
           CASE WHEN kb_id % 2 = 0 THEN (least(30, chunk_idx // 2 * 2) + kb_id % 5 + 1)::INT END AS page
    FROM chunks0 JOIN documents ON kb_id = doc_id))"""
#: Collections of one chunk aren't indexed.
_INDEXED = _ATTR[:-1] + "\n    WHERE kb_id IN (SELECT kb_id FROM chunks0 GROUP BY kb_id HAVING count(*) >= 2))"
_STOP = "[" + ", ".join(f"'{w}'" for w in tfidf.STOP_WORDS) + "]"
_TERMS = rf"(SELECT list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM (SELECT list_filter(regexp_extract_all(lower({{}}), '[\p{{{{L}}}}\p{{{{N}}}}_]{{{{2,}}}}'), lambda x: NOT list_contains({_STOP}, x)) AS t))".replace("{{{{", "{{").replace("}}}}", "}}")
_ASKS = """asks AS (SELECT item_id AS q_id, doc_id AS kb_id, b.text AS question FROM documents JOIN benchmark b ON doc_id % (SELECT count(*) FROM benchmark) = item_id)"""
_VOCAB = f"""per AS (SELECT kb_id, chunk_idx, term, count(*) AS n FROM (SELECT kb_id, chunk_idx, unnest({_TERMS.format('embed_text')}) AS term FROM chunks) GROUP BY ALL),
sizes AS (SELECT kb_id, count(*) AS n_chunks FROM chunks GROUP BY kb_id),
vocab AS (
  SELECT kb_id, term, df, cf, ln((1 + n_chunks) / (1 + df)) + 1 AS idf FROM (
    SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY cf DESC, term) AS r FROM (SELECT kb_id, term, count(*) AS df, sum(n)::BIGINT AS cf FROM per GROUP BY ALL)) JOIN sizes USING (kb_id) WHERE r <= 30000),
postings AS (SELECT kb_id, chunk_idx, term, w / sqrt(sum(w * w) OVER (PARTITION BY kb_id, chunk_idx)) AS weight FROM (SELECT kb_id, chunk_idx, term, (1 + ln(n)) * idf AS w FROM per JOIN vocab USING (kb_id, term)))"""
_QW = f"""asked AS (
  SELECT q_id, kb_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY q_id, kb_id)) AS weight FROM (
    SELECT q_id, kb_id, term, (1 + ln(n)) * idf AS w FROM (SELECT q_id, kb_id, term, count(*) AS n FROM (SELECT q_id, kb_id, unnest({_TERMS.format('question')}) AS term FROM asks) GROUP BY ALL) JOIN vocab USING (kb_id, term)))"""
_SPARSE = "sparse AS (SELECT q_id, kb_id, chunk_idx, sum(a.weight * p.weight) AS sparse FROM asked a JOIN postings p USING (kb_id, term) GROUP BY ALL)"


def _embedded(name: str, key: str, text: str, source: str) -> str:
    """Hashed unit vectors of texts as lists of 64 doubles."""
    return rf"""{name} AS (
  SELECT {key}, CASE WHEN norm > 0 THEN list_transform(v, lambda x: x / norm) ELSE v END AS emb FROM (
    SELECT {key}, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM (
      SELECT {key}, list(coalesce(s, 0)::DOUBLE ORDER BY b) AS v FROM (SELECT DISTINCT {key} FROM {source}) k CROSS JOIN (SELECT unnest(range(0, 64)) AS b) LEFT JOIN (
        SELECT {key}, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS b, sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END) AS s FROM (
          SELECT {key}, md5(unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}'))) AS h FROM {source}) GROUP BY ALL) USING ({key}, b)
      GROUP BY {key})))"""


_DENSE = _embedded("chunk_emb", "kb_id, chunk_idx", "embed_text", "chunks") + ",\n" + _embedded("ask_emb", "q_id, kb_id", "question", "asks")
_HYBRID = """pairs AS (
  SELECT a.q_id, a.kb_id, c.chunk_idx, list_inner_product(c.emb, a.emb) AS dense, coalesce(s.sparse, 0) AS sparse, count(*) OVER w AS n_chunks
  FROM ask_emb a JOIN chunk_emb c USING (kb_id) LEFT JOIN sparse s ON s.q_id = a.q_id AND s.kb_id = a.kb_id AND s.chunk_idx = c.chunk_idx WINDOW w AS (PARTITION BY a.q_id, a.kb_id)),
scored AS (
  SELECT *, 0.45::DOUBLE * CASE WHEN max(dense) OVER w - min(dense) OVER w < 1e-12 THEN 0 ELSE (dense - min(dense) OVER w) / (max(dense) OVER w - min(dense) OVER w) END
          + 0.55::DOUBLE * CASE WHEN max(sparse) OVER w - min(sparse) OVER w < 1e-12 THEN 0 ELSE (sparse - min(sparse) OVER w) / (max(sparse) OVER w - min(sparse) OVER w) END AS score
  FROM pairs WINDOW w AS (PARTITION BY q_id, kb_id)),
hybrid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id, kb_id ORDER BY round(score, 9) DESC, chunk_idx) AS rank FROM scored) WHERE rank <= least(40, greatest(20, n_chunks // 5)))"""
_N = NORM.format("s")
_LATEX = r"regexp_replace({}, '\\\[(?s:.*?)\\\]', '', 'g')"
def _lead(x: str) -> str:
    """A text without one display formula at its start."""
    return rf"trim(regexp_replace({x}, '^\s*\\\[(?s:.*?)\\\]', ''))"


def _no_latex(x: str) -> str:
    """A text without display formulas, with single spaces."""
    return NORM.format(_LATEX.format(x))


_SENTS = rf"""tops AS (SELECT h.q_id, h.kb_id, h.rank, h.chunk_idx, h.score, c.chunk, c.attr FROM hybrid h JOIN chunks c USING (kb_id, chunk_idx) WHERE rank <= 5),
sents0 AS (SELECT q_id, kb_id, rank, chunk_idx, score, attr, unnest(ss) AS sent, generate_subscripts(ss, 1) - 1 AS si FROM (SELECT *, {SENTENCES.format('chunk')} AS ss FROM tops)),
good0 AS (SELECT *, q_id || '/' || kb_id || '/' || rank || '/' || si AS id, {_lead('sent')} AS clean FROM sents0 WHERE NOT {NOISE.format('sent')}),
changed0 AS (SELECT * FROM good0 WHERE clean <> sent),
{_embedded("sent_emb", "id", "clean", "good0")},
{_embedded("raw_emb", "id", "sent", "changed0")},
good AS (
  SELECT g.*, e.emb, list_inner_product(e.emb, a.emb) AS rel, coalesce(list_inner_product(r.emb, a.emb), list_inner_product(e.emb, a.emb)) AS raw_rel
  FROM good0 g JOIN sent_emb e USING (id) JOIN ask_emb a ON a.q_id = g.q_id AND a.kb_id = g.kb_id LEFT JOIN raw_emb r ON r.id = g.id),
pool AS (SELECT * FROM good WHERE rank <= 3 AND clean <> '' AND round(rel, 9) >= 0.2),
pick1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id, kb_id ORDER BY round(0.72::DOUBLE * rel, 9) DESC, rank, si) AS r, length(clean) + 1 AS total FROM pool) WHERE r = 1),
pick2 AS (SELECT * FROM (
  SELECT p.*, row_number() OVER (PARTITION BY p.q_id, p.kb_id ORDER BY round(0.72::DOUBLE * p.rel - (1 - 0.72::DOUBLE) * list_inner_product(p.emb, a.emb), 9) DESC, p.rank, p.si) AS r, a.total AS before, a.emb AS emb1, a.id AS id1
  FROM pool p JOIN pick1 a USING (q_id, kb_id) WHERE p.id <> a.id AND a.total < 650) WHERE r = 1 AND before + 1 + length(clean) <= 650),
pick3 AS (SELECT * FROM (
  SELECT p.*, row_number() OVER (PARTITION BY p.q_id, p.kb_id ORDER BY round(0.72::DOUBLE * p.rel - (1 - 0.72::DOUBLE) * greatest(list_inner_product(p.emb, b.emb1), list_inner_product(p.emb, b.emb)), 9) DESC, p.rank, p.si) AS r, b.before + length(b.clean) + 1 AS before3
  FROM pool p JOIN pick2 b USING (q_id, kb_id) WHERE p.id NOT IN (b.id, b.id1) AND b.before + length(b.clean) + 1 < 650) WHERE r = 1 AND before3 + 1 + length(clean) <= 650),
picks AS (SELECT q_id, kb_id, rank, si, clean FROM pick1 UNION ALL SELECT q_id, kb_id, rank, si, clean FROM pick2 UNION ALL SELECT q_id, kb_id, rank, si, clean FROM pick3),
picked AS (SELECT q_id, kb_id, {_no_latex("string_agg(clean, ' ' ORDER BY rank, si)")} AS body FROM picks GROUP BY ALL),
fallback AS (SELECT q_id, kb_id, {_no_latex('clean')} AS body FROM good WHERE rank = 1 QUALIFY row_number() OVER (PARTITION BY q_id, kb_id ORDER BY si) = 1),
votes AS (SELECT q_id, kb_id, rank AS sup FROM (SELECT q_id, kb_id, rank, count(*) AS n FROM picks GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY q_id, kb_id ORDER BY n DESC, rank) = 1),
near AS (
  SELECT q_id, kb_id, sup, {_no_latex(_lead("string_agg(sent, ' ' ORDER BY si)"))} AS body FROM (
    SELECT DISTINCT s.q_id, s.kb_id, v.sup, s.si, s.sent FROM sents0 s JOIN votes v ON s.q_id = v.q_id AND s.kb_id = v.kb_id AND s.rank = v.sup
    JOIN picks p ON p.q_id = s.q_id AND p.kb_id = s.kb_id AND p.rank = v.sup AND abs(p.si - s.si) <= 1) GROUP BY ALL),
answered AS (
  SELECT t.q_id, t.kb_id, t.score, t.attr, score >= 0.01 AS relevant,
         CASE WHEN coalesce(p.body, f.body, '') = '' THEN 'I cannot determine this from the document.' ELSE coalesce(p.body, f.body) END
         || CASE WHEN t.attr <> '' THEN ' Evidence: (' || {NORM.format('t.attr')} || ')' ELSE '' END AS body,
         coalesce(n.body, f.body, '') AS focused, coalesce(n.sup - 1, 0)::INT AS sup_ci,
         CASE WHEN score >= 0.25 THEN 'strong match' WHEN score >= 0.08 THEN 'partial match' ELSE 'weak match' END AS label,
         CASE WHEN score >= 0.25 THEN 'match-high' WHEN score >= 0.08 THEN 'match-medium' ELSE 'match-low' END AS css
  FROM tops t LEFT JOIN picked p USING (q_id, kb_id) LEFT JOIN fallback f USING (q_id, kb_id) LEFT JOIN near n USING (q_id, kb_id) WHERE t.rank = 1)"""
_EVIDENCE = rf"""lines_ AS (
  SELECT q_id, kb_id, rank, r, '[' || CASE WHEN attr <> '' THEN attr ELSE 'Chunk: ' || chunk_idx END || '] ' || {_no_latex('sent')} AS line FROM (
    SELECT *, row_number() OVER (PARTITION BY q_id, kb_id, rank ORDER BY round(raw_rel, 9) DESC, si) AS r FROM good WHERE rank <= 4 AND score >= 0.01) WHERE r <= 2),
packed AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY q_id, kb_id ORDER BY rank, r ROWS UNBOUNDED PRECEDING) AS total FROM lines_),
packs AS (SELECT q_id, kb_id, string_agg(line, chr(10) ORDER BY rank, r) AS evidence FROM packed WHERE total <= 1400 GROUP BY ALL)"""
_EXTRAS = rf"""rest AS (
  SELECT q_id, kb_id, rank, score FROM (
    SELECT q_id, kb_id, rank, score, row_number() OVER (PARTITION BY q_id, kb_id, lower({NORM.format('substr(chunk, 1, 200)')}) ORDER BY rank) AS again FROM tops WHERE rank > 1 AND score >= 0.01) WHERE again = 1),
snippets AS (
  SELECT q_id, kb_id, rank, any_value(r.score) AS score, {_no_latex("string_agg(sent, ' ' ORDER BY si)")} AS snippet FROM (
    SELECT q_id, kb_id, rank, si, sent, row_number() OVER (PARTITION BY q_id, kb_id, rank ORDER BY round(raw_rel, 9) DESC, si) AS n FROM good) g JOIN rest r USING (q_id, kb_id, rank) WHERE n <= 3 GROUP BY ALL),
extras_ AS (SELECT q_id, kb_id, (row_number() OVER (PARTITION BY q_id, kb_id ORDER BY rank) - 1)::INT AS n, snippet, score FROM snippets)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


_SMALL = _fold(100, 10)
_TO_VOCAB = (_SMALL, _ATTR, _ASKS, _VOCAB)
_TO_INDEX = (_SMALL, _INDEXED, _ASKS, _VOCAB)
_TO_HYBRID = (*_TO_INDEX, _QW, _SPARSE, _DENSE, _HYBRID)
_TO_ANSWER = (*_TO_HYBRID, _SENTS)
_NOTHING = f"'{answer.NOTHING}'"
_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"

ORACLES = {
    "chunk_docs_default": _with(_fold(800, 30)) + "SELECT kb_id, chunk_idx, md5(chunk) AS chunk_md5 FROM chunks0",
    "chunk_docs_small": _with(_SMALL) + "SELECT kb_id, chunk_idx, md5(chunk) AS chunk_md5 FROM chunks0",
    "indexable": _with(_SMALL) + "SELECT doc_id AS kb_id, count(c.kb_id) AS n_chunks, CASE WHEN count(c.kb_id) < 2 THEN 'Not enough text to index. Try a longer document.' ELSE '' END AS err FROM documents LEFT JOIN chunks0 c ON c.kb_id = doc_id GROUP BY doc_id",
    "attributed_chunks": _with(_SMALL, _ATTR) + "SELECT kb_id, chunk_idx, section, page, attr, md5(embed_text) AS embed_md5 FROM chunks",
    "asof_section": _with(_SMALL, "entries AS (SELECT doc_id AS kb_id, i AS para_idx, source || ' part ' || i AS section FROM documents, range(1, 32, 3) t(i))") + "SELECT c.kb_id, c.chunk_idx, e.section FROM chunks0 c ASOF LEFT JOIN entries e ON c.kb_id = e.kb_id AND c.chunk_idx >= e.para_idx",
    "tfidf_vocab": _with(*_TO_VOCAB) + "SELECT kb_id, term, df, cf, round(idf, 6) AS idf FROM vocab",
    "tfidf_weights": _with(*_TO_VOCAB) + "SELECT kb_id, chunk_idx, term, round(weight, 6) AS weight FROM postings",
    "sparse_scores": _with(*_TO_INDEX, _QW, _SPARSE) + "SELECT q_id, kb_id, chunk_idx, round(sparse, 6) AS sparse FROM sparse",
    "score_sentences": _with(*_TO_VOCAB, _QW, f"ss AS (SELECT kb_id, chunk_idx, unnest(s) AS sent, (generate_subscripts(s, 1) - 1)::INT AS si FROM (SELECT kb_id, chunk_idx, {SENTENCES.format('chunk')} AS s FROM chunks))", f"sp AS (SELECT kb_id, chunk_idx, si, term, w / sqrt(sum(w * w) OVER (PARTITION BY kb_id, chunk_idx, si)) AS weight FROM (SELECT kb_id, chunk_idx, si, term, (1 + ln(n)) * idf AS w FROM (SELECT kb_id, chunk_idx, si, term, count(*) AS n FROM (SELECT kb_id, chunk_idx, si, unnest({_TERMS.format('sent')}) AS term FROM ss) GROUP BY ALL) JOIN vocab USING (kb_id, term)))") + "SELECT q_id, kb_id, chunk_idx, si, round(sum(a.weight * p.weight), 6) AS cosine FROM asked a JOIN sp p USING (kb_id, term) GROUP BY ALL",
    "dense_topk": "SELECT * FROM (SELECT q.vec_id AS q_id, e.vec_id, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) WHERE rank <= 5",
    "mmr_select": """WITH few AS (SELECT label, vec_id // 200 AS block, vec_id, embedding::DOUBLE[] AS e, 150 + vec_id % 140 AS chars FROM embeddings),
pool AS (SELECT f.*, round(list_inner_product(f.e, q.e), 9) AS rel FROM few f JOIN (SELECT label, block, arg_min(e, vec_id) AS e FROM few GROUP BY ALL) q USING (label, block)),
p1 AS (SELECT * FROM pool WHERE rel >= -1 QUALIFY row_number() OVER (PARTITION BY label, block ORDER BY round(0.72::DOUBLE * rel, 9) DESC, vec_id) = 1),
p2 AS (SELECT * FROM (SELECT p.*, a.e AS e1, a.vec_id AS id1, a.chars + 1 AS before, row_number() OVER (PARTITION BY p.label, p.block ORDER BY round(0.72::DOUBLE * p.rel - (1 - 0.72::DOUBLE) * list_inner_product(p.e, a.e), 9) DESC, p.vec_id) AS r FROM pool p JOIN p1 a USING (label, block) WHERE p.vec_id <> a.vec_id AND p.rel >= -1) WHERE r = 1 AND before + 1 + chars <= 650),
p3 AS (SELECT * FROM (SELECT p.*, b.before + b.chars + 1 AS before, row_number() OVER (PARTITION BY p.label, p.block ORDER BY round(0.72::DOUBLE * p.rel - (1 - 0.72::DOUBLE) * greatest(list_inner_product(p.e, b.e), list_inner_product(p.e, b.e1)), 9) DESC, p.vec_id) AS r FROM pool p JOIN p2 b USING (label, block) WHERE p.vec_id NOT IN (b.vec_id, b.id1) AND p.rel >= -1) WHERE r = 1 AND before + 1 + chars <= 650)
SELECT label, block, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS chosen FROM (SELECT label, block, vec_id FROM p1 UNION ALL SELECT label, block, vec_id FROM p2 UNION ALL SELECT label, block, vec_id FROM p3) GROUP BY ALL""",
    "hybrid_topk": _with(*_TO_HYBRID) + "SELECT q_id, kb_id, chunk_idx, round(dense, 6) + 0.0 AS dense, round(sparse, 6) AS sparse, round(score, 6) AS score, rank FROM hybrid",
    "retrieval_recall": _with(_SMALL, _INDEXED, rf"asks AS (SELECT item_id AS q_id, doc_id AS kb_id, b.text AS question FROM documents d JOIN benchmark b ON contains({NORM.format('d.text')}, {NORM.format('b.text')}))", _VOCAB, _QW, _SPARSE, _DENSE, _HYBRID, r"""best AS (
  SELECT q_id, kb_id, max(len(list_filter(w, lambda x: list_contains(cw, x))) / len(w)) AS share FROM (
    SELECT h.q_id, h.kb_id, list_distinct(list_filter(string_split_regex(s.question, '\s+'), lambda z: z <> '')) AS w, string_split(c.chunk, ' ') AS cw
    FROM hybrid h JOIN asks s USING (q_id, kb_id) JOIN chunks c ON c.kb_id = h.kb_id AND c.chunk_idx = h.chunk_idx WHERE rank <= 5) GROUP BY ALL)""") + "SELECT q_id, count(*) AS n_holding, count(*) FILTER (WHERE share >= 0.5) AS n_found FROM asks LEFT JOIN best USING (q_id, kb_id) GROUP BY q_id",
    "extractive_answer": _with(*_TO_ANSWER) + f"SELECT q_id, kb_id, CASE WHEN relevant THEN body ELSE {_NOTHING} END AS answer_text, round(CASE WHEN relevant THEN score ELSE 0 END, 6) AS score, CASE WHEN relevant THEN attr ELSE '' END AS attr_text, label FROM answered",
    "answer_html": _with(*_TO_ANSWER) + f"""SELECT q_id, kb_id, CASE WHEN relevant THEN '<div class="msg-label">grounded answer</div><p>' || {_ESC.format("'Grounded answer: ' || body")} || CASE WHEN focused <> '' AND focused <> body THEN '</p><p>' || {_ESC.format("'Supporting passage: ' || focused")} ELSE '' END || '</p><span class="match-pill ' || css || '">' || label || '</span>' ELSE '<p>' || {_NOTHING} || '</p>' END AS answer_html FROM answered""",
    "focused_passage": _with(*_TO_ANSWER) + "SELECT q_id, kb_id, focused, sup_ci FROM answered WHERE relevant",
    "evidence_pack": _with(*_TO_ANSWER, _EVIDENCE) + "SELECT q_id, kb_id, coalesce(evidence, '') AS evidence FROM answered LEFT JOIN packs USING (q_id, kb_id) WHERE relevant",
    "extras": _with(*_TO_ANSWER, _EXTRAS) + "SELECT q_id, kb_id, n, snippet, round(e.score, 6) AS score FROM extras_ e JOIN (SELECT q_id, kb_id FROM answered WHERE relevant) USING (q_id, kb_id)",
    "context_pack": _with(*_TO_HYBRID, f"""pieces AS (
  SELECT q_id, kb_id, rank, CASE WHEN attr <> '' THEN '[' || attr || '] ' ELSE '' END || {NORM.format('chunk')} AS piece FROM hybrid h JOIN chunks c USING (kb_id, chunk_idx) WHERE rank <= 4 AND score >= 0.01)""", "cut AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY q_id, kb_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pieces)") + """
SELECT q_id, kb_id, trim(coalesce(string_agg(substr(piece, 1, (1800 - before)::INT), chr(10) || chr(10) ORDER BY rank) FILTER (WHERE before < 1800), ''), ' ' || chr(10)) AS context
FROM (SELECT q_id, kb_id FROM hybrid WHERE rank = 1) LEFT JOIN cut USING (q_id, kb_id) GROUP BY q_id, kb_id""",
    "message_history": _with(*_TO_ANSWER, _EXTRAS, f"""given AS (SELECT q_id, kb_id, (kb_id % 3 * 2)::INT AS next, CASE WHEN relevant THEN body ELSE {_NOTHING} END AS answer_text, CASE WHEN relevant THEN attr ELSE '' END AS attr_text, relevant FROM answered)""") + """
SELECT kb_id, t::INT AS turn, CASE WHEN t % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, 'earlier' AS content, NULL::VARCHAR AS answer_text, NULL::VARCHAR AS attr_text, NULL::INT AS n_extras FROM given, range(0, 4) r(t) WHERE t < next
UNION ALL SELECT g.kb_id, next, 'user', question, NULL, NULL, NULL FROM given g JOIN asks a USING (q_id, kb_id)
UNION ALL SELECT kb_id, next + 1, 'assistant', NULL, answer_text, attr_text, CASE WHEN relevant THEN (SELECT count(*) FROM extras_ e WHERE e.q_id = g.q_id AND e.kb_id = g.kb_id) ELSE 0 END::INT FROM given g""",
    "index_roundtrip": _with(*_TO_INDEX) + "SELECT kb_id, chunk_idx, term, round(weight, 6) AS weight FROM postings",
    "vocabulary_roundtrip": _with(*_TO_INDEX) + "SELECT kb_id, (row_number() OVER (PARTITION BY kb_id ORDER BY term) - 1)::INT AS number, term, round(idf, 6) AS idf FROM vocab",
    "rerank_pairs": _with(*_TO_HYBRID, r"""paired AS (
  SELECT h.q_id, h.kb_id, h.chunk_idx, h.score, h.rank, len(list_filter(list_distinct(string_split_regex(trim(a.question), '\s+')), lambda x: list_contains(string_split(c.chunk, ' '), x))) AS pair
  FROM hybrid h JOIN chunks c ON c.kb_id = h.kb_id AND c.chunk_idx = h.chunk_idx JOIN asks a ON a.q_id = h.q_id AND a.kb_id = h.kb_id)""") + "SELECT * FROM (SELECT q_id, kb_id, chunk_idx, round(score, 6) AS score, row_number() OVER (PARTITION BY q_id, kb_id ORDER BY pair DESC, rank) AS rank FROM paired) WHERE rank <= 5",
    "missing_index": _with(_SMALL) + "SELECT doc_id AS kb_id FROM documents WHERE doc_id % 4 <> 0 OR doc_id NOT IN (SELECT kb_id FROM chunks0 GROUP BY kb_id HAVING count(*) >= 2)",
}
