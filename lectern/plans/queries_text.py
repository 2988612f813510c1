"""Registered queries of scalar functions, gates, sources and the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.config import DEFAULT
from lectern.functions import gates
from lectern.functions import text as T
from lectern.operators import chunking, registry
from lectern.sources import html, paste, pdf


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def normalize_ws(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.md5(T.normalize_ws("text").cast("binary")).alias("text_md5"), F.length(T.normalize_ws("text")).alias("n_chars"))


def as_text(spark, d):
    parts = F.array("source", F.lit(None).cast("string"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    return _read(spark, d, "documents").select("doc_id", T.as_text(parts, "array").alias("joined"), T.as_text("doc_id").alias("id_text"), T.as_text(F.when(F.col("doc_id") % 3 > 0, F.col("lang"))).alias("lang_text"))


def normalize_url(spark, d):
    bare = F.regexp_replace("url", "^https?://", "")
    given = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("  "), bare)).when(F.col("page_id") % 3 == 1, F.col("url")).otherwise(F.lit(" "))
    return _read(spark, d, "pages").select("page_id", T.normalize_url(given).alias("url"))


def split_sentences(spark, d):
    s = _read(spark, d, "documents").select("doc_id", T.split_sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "|").cast("binary")).alias("sentences_md5"))


def noise_sentences(spark, d):
    s = _read(spark, d, "documents").select("doc_id", T.split_sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.size(F.filter("s", T.is_noise_sentence)).alias("n_noise"))


def noise_and_latex(spark, d):
    made = F.concat(F.lit("\\[ x = "), F.col("text"), F.lit(" \\]"))
    text = F.when(F.col("item_id") % 4 == 0, made).when(F.col("item_id") % 4 == 1, F.concat(made, F.lit(" "), F.col("text"), F.lit(" \\[ y \\]"))).when(F.col("item_id") % 4 == 2, F.concat(F.col("text"), F.lit(" a − b"))).otherwise(F.col("text"))
    rows = _read(spark, d, "benchmark").select("item_id", text.alias("t"))
    return rows.select("item_id", T.is_noise_sentence("t").alias("noise"), T.strip_leading_latex("t").alias("no_lead"), T.remove_latex("t").alias("no_latex"))


def match_labels(spark, d):
    score = (F.col("event_id") % 40) / F.lit(100.0)
    return _read(spark, d, "events").select("event_id", T.match_label(score).alias("m")).select("event_id", "m.label", "m.css_class")


def clean_passage(spark, d):
    given = F.concat(F.lit("Note: "), F.col("text"), F.lit("\n\n a ∑ b\n\\[ z \\]8.9 Heading\nend"))
    return _read(spark, d, "documents").select("doc_id", T.clean_raw_passage("text").alias("passage"), F.md5(T.clean_raw_passage(given, 0).cast("binary")).alias("full_md5"))


def html_escape(spark, d):
    return _read(spark, d, "pages").select("page_id", F.md5(T.html_escape(F.concat(F.col("html"), F.lit("'\""))).cast("binary")).alias("escaped_md5"))


def short_labels(spark, d):
    return _read(spark, d, "pages").select("page_id", T.short_label("url").alias("label"), T.short_label("url", 40).alias("caption"))


def word_prefixes(spark, d):
    p = _read(spark, d, "benchmark").select("item_id", T.word_prefixes("text").alias("p"))
    return p.select("item_id", F.size("p").alias("n_steps"), F.md5(F.array_join("p", "|").cast("binary")).alias("steps_md5"))


def prompts(spark, d):
    b = _read(spark, d, "benchmark").select("item_id", F.reverse("text").alias("q"), F.col("text").alias("e"))
    return b.select("item_id", F.md5(gates.hosted_prompt("q", "e").cast("binary")).alias("hosted_md5"), F.md5(gates.local_prompt("q", "e").cast("binary")).alias("local_md5"))


def cache_keys(spark, d):
    return _read(spark, d, "documents").select("doc_id", T.text_hash("text").alias("text_hash"), T.cache_key("source", "text").alias("cache_key"))


def _turns(spark, d) -> DataFrame:
    """Assistant turns with the turn before as their evidence."""
    rows = _read(spark, d, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.select("conv_id", "turn", "role", "text", F.coalesce(before, F.lit("")).alias("evidence")).where("role = 'assistant'")


def overlap_gate(spark, d):
    r = F.round(gates.overlap_ratio("text", "evidence"), 6)
    return _turns(spark, d).select("conv_id", "turn", r.alias("ratio"), (r >= gates.HOSTED_OVERLAP).alias("hosted_ok"), (r >= gates.LOCAL_OVERLAP).alias("local_ok"))


def repetition_gate(spark, d):
    r = gates.repeat_share("text")
    return _turns(spark, d).select("conv_id", "turn", F.round(r, 6).alias("share"), (r <= gates.REPEAT_SHARE).alias("ok"))


def generation_gate(spark, d):
    raw = F.concat(F.lit("[INST] a\nb [/INST] "), F.col("text"), F.lit(" ;("))
    own = F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(F.col("evidence"))
    return _turns(spark, d).select("conv_id", "turn", gates.hosted_answer(raw, own).alias("hosted"), gates.local_answer("text", own).alias("local"))


def dedup_paragraphs(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.md5(chunking.dedup_paragraphs("text").cast("binary")).alias("text_md5"))


def dedup_paragraphs_long(spark, d):
    return chunking.dedup_long(_read(spark, d, "documents")).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def page_text(spark, d):
    loaded = html.load_pages(_read(spark, d, "pages"))
    return loaded.select("page_id", "url", "text", F.size("section_map").alias("n_sections"), "err")


def page_sections(spark, d):
    return html.sections(html.load_pages(_read(spark, d, "pages")))


def pasted_text(spark, d):
    rows = _read(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 5 == 0, F.lit(" \n ")).otherwise(F.concat(F.lit("\n "), F.col("text"), F.lit("  "))).alias("text"))
    return paste.pasted(rows)


def _as_pages(spark, d) -> DataFrame:
    """Documents as PDF-like pages: conversation turns are pages, every fourth one empty."""
    raw = F.when(F.col("turn") % 4 == 3, F.lit("")).otherwise(F.concat(F.lit("Heading "), F.col("role"), F.lit("\n"), F.col("text"), F.lit("\nsplit-\nword camelCase v2x")))
    block = F.array(F.struct(F.lit(5.04).alias("x0"), F.lit(10.01).alias("y0"), F.lit("right").alias("text")), F.struct(F.lit(1.0).alias("x0"), F.lit(10.04).alias("y0"), F.lit("left").alias("text")))
    return _read(spark, d, "conversations").select(F.col("conv_id"), (F.col("turn") + 1).cast("int").alias("page"), raw.alias("raw"), block.alias("blocks"), F.lit("").alias("err"))


def pdf_normalize_lines(spark, d):
    return _as_pages(spark, d).select("conv_id", "page", pdf.normalize_lines("raw").alias("text"))


def pdf_blocks(spark, d):
    boxes = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.struct(((F.col("event_id") * 7 * i) % 13 / F.lit(8.0)).alias("x0"), ((F.col("event_id") * i) % 3 / F.lit(16.0)).alias("y0"), F.when(i == 3, F.lit(" ")).otherwise(F.concat(F.lit("b"), i.cast("string"))).alias("text")))
    return _read(spark, d, "events").select("event_id", pdf.blocks_text(boxes).alias("text"))


def pdf_headings(spark, d):
    lines = pdf.paragraph_lines(pdf.page_texts(_as_pages(spark, d)), "conv_id")
    return pdf.section_entries(lines, "conv_id")


def pdf_page_map(spark, d):
    pages = pdf.page_texts(_as_pages(spark, d))
    return pdf.page_entries(pages, pdf.paragraph_lines(pages, "conv_id"), "conv_id")


def pdf_documents(spark, d):
    whole = pdf.assemble(pdf.page_texts(_as_pages(spark, d)), "conv_id")
    return whole.select("conv_id", "text", F.size("section_map").alias("n_sections"), F.size("page_map").alias("n_pages"), "err")


def pdf_size_guard(spark, d):
    files = _read(spark, d, "orders").select(F.col("o_orderkey").alias("path"), (F.lit(DEFAULT.pdf_max_bytes) + F.col("o_orderkey") % 3 - 1).alias("length"))
    return pdf.within_limit(files)


def _events(spark, d) -> DataFrame:
    """Registry events made of the event table: names come again and again, some are deleted."""
    e = _read(spark, d, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.when(F.col("event_id") % 7 == 3, F.lit("delete")).otherwise(F.lit("upsert")).alias("op"), F.col("user_id").cast("string").alias("source_name"),
        F.md5(F.col("event_id").cast("string").cast("binary")).alias("kb_id"), (F.col("event_id") % 9 + 2).cast("int").alias("chunk_count"), F.col("event_type").alias("text_hash"), F.col("event_type").alias("workspace"),
    )


def registry_upsert(spark, d):
    now = registry.current(_events(spark, d), ["workspace"])
    return now.select("workspace", "source_name", "kb_id", "chunk_count", F.col("position").cast("long").alias("position"))


def registry_delete(spark, d):
    nations = _read(spark, d, "nation").select(F.col("n_name").alias("source_name"), F.col("n_nationkey").cast("long").alias("position"))
    rest, active = registry.delete_at(nations, 7, 24)
    return rest.withColumn("active", F.lit(active).cast("long"))


def registry_active(spark, d):
    nations = _read(spark, d, "nation").select(F.col("n_name").alias("source_name"), F.col("n_nationkey").cast("long").alias("position"))
    return registry.active_document(nations, 3)


QUERIES = {f.__name__: f for f in (
    normalize_ws, as_text, normalize_url, split_sentences, noise_sentences, noise_and_latex, match_labels, clean_passage, html_escape, short_labels, word_prefixes, prompts, cache_keys,
    overlap_gate, repetition_gate, generation_gate, dedup_paragraphs, dedup_paragraphs_long, page_text, page_sections, pasted_text, pdf_normalize_lines, pdf_blocks, pdf_headings, pdf_page_map,
    pdf_documents, pdf_size_guard, registry_upsert, registry_delete, registry_active,
)}


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


NORM = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
SENTENCES = r"list_filter(string_split(regexp_replace(" + NORM + r", '([.!?]) ', '\1' || chr(30), 'g'), chr(30)), lambda s: s <> '')"
MATH = "'[∀-⋿℀-⅏⟀-⟯⦀-⧿⨀-⫿]'"
NOISE = rf"(length({{0}}) < 35 OR regexp_matches({{0}}, '^\\\[(?s:.*)\\\]$') OR regexp_matches({{0}}, {MATH}))"
_TURNS = """turns AS (
  SELECT * FROM (SELECT conv_id, turn, role, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS evidence FROM conversations) WHERE role = 'assistant')"""
_OVERLAP = "CASE WHEN len({a}) > 0 THEN len(list_filter({a}, lambda w: list_contains({e}, w))) / len({a}) ELSE 0.0 END"
_WORDS = "regexp_extract_all(lower({}), '[a-zA-Z]{{4,}}')"
_REPEAT = r"(SELECT CASE WHEN len(w) >= 4 THEN list_max(list_transform(list_distinct(w), lambda x: len(list_filter(w, lambda y: y = x)))) / len(w) ELSE 0.0 END FROM (SELECT list_filter(string_split_regex(lower({}), '\s+'), lambda z: z <> '') AS w))"
DEDUP = r"""lines AS (
  SELECT doc_id, line, pos, lower(regexp_replace(line, '\s+', ' ', 'g')) AS key FROM (
    SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE line <> ''),
deduped AS (
  SELECT doc_id, line, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS n FROM lines) WHERE n = 1 OR length(key) < 40)"""
_DEDUP_SQL = f"WITH {DEDUP} SELECT doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY pos), '')) AS text_md5 FROM documents LEFT JOIN deduped USING (doc_id) GROUP BY doc_id"
_PAGES = r"""pages_ AS (
  SELECT conv_id, (turn + 1)::INT AS page, CASE WHEN turn % 4 = 3 THEN '' ELSE 'Heading ' || role || chr(10) || text || chr(10) || 'split-' || chr(10) || 'word camelCase v2x' END AS raw FROM conversations),
joined AS (SELECT conv_id, page, regexp_replace(raw, '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g') AS raw FROM pages_),
norm_lines AS (
  SELECT conv_id, page, pos, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(line), '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Za-z])(\d)', '\1 \2', 'g'), '(\d)([A-Za-z])', '\1 \2', 'g'), '\s+', ' ', 'g')) AS line FROM (
    SELECT conv_id, page, unnest(string_split(raw, chr(10))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) AS pos FROM joined)),
norm AS (SELECT conv_id, page, trim(string_agg(line, chr(10) ORDER BY pos), ' ' || chr(10)) AS page_text FROM norm_lines GROUP BY conv_id, page),
page_texts AS (
  SELECT conv_id, page, CASE WHEN length(page_text) < 40 THEN '' ELSE page_text END AS page_text FROM norm),
para AS (
  SELECT conv_id, page, line, row_number() OVER (PARTITION BY conv_id ORDER BY page, pos) - 1 AS para_idx FROM (
    SELECT conv_id, page, trim(unnest(string_split(page_text, chr(10)))) AS line, generate_subscripts(string_split(page_text, chr(10)), 1) AS pos FROM page_texts) WHERE line <> ''),
heads AS (SELECT conv_id, para_idx, line AS section FROM para WHERE regexp_matches(line, '^(?:\d+[\d\.]*\s+)?[A-Z][^\n]{0,80}$') AND NOT line LIKE '%.' AND length(line) < 80),
starts AS (
  SELECT conv_id, para_idx, max(page) AS page FROM (
    SELECT p.conv_id, p.page, coalesce(sum(n) OVER (PARTITION BY p.conv_id ORDER BY p.page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS para_idx
    FROM page_texts p LEFT JOIN (SELECT conv_id, page, count(*) AS n FROM para GROUP BY ALL) c USING (conv_id, page)) GROUP BY conv_id, para_idx)"""

_S = SENTENCES.format("text")
_N = NORM.format("s")
_LATEX_T = r"CASE item_id % 4 WHEN 0 THEN '\[ x = ' || text || ' \]' WHEN 1 THEN '\[ x = ' || text || ' \] ' || text || ' \[ y \]' WHEN 2 THEN text || ' a − b' ELSE text END"
_NL = NORM.format("t")

ORACLES = {
    "normalize_ws": f"SELECT doc_id, md5({NORM.format('text')}) AS text_md5, length({NORM.format('text')})::INT AS n_chars FROM documents",
    "as_text": "SELECT doc_id, concat_ws(' ', source, CASE WHEN doc_id % 2 = 0 THEN lang END) AS joined, doc_id::VARCHAR AS id_text, CASE WHEN doc_id % 3 > 0 THEN lang ELSE '' END AS lang_text FROM documents",
    "normalize_url": """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://' || regexp_replace(url, '^https?://', '') WHEN 1 THEN CASE WHEN url LIKE 'http://%' OR url LIKE 'https://%' THEN url ELSE 'https://' || url END ELSE '' END AS url FROM pages""",
    "split_sentences": f"SELECT doc_id, len(s)::INT AS n_sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM (SELECT doc_id, {_S} AS s FROM documents)",
    "noise_sentences": f"SELECT doc_id, len(s)::INT AS n_sentences, len(list_filter(s, lambda x: {NOISE.format('x')}))::INT AS n_noise FROM (SELECT doc_id, {_S} AS s FROM documents)",
    "noise_and_latex": rf"""SELECT item_id, {NOISE.format(_NL)} AS noise, trim(regexp_replace(t, '^\s*\\\[(?s:.*?)\\\]', '')) AS no_lead, {NORM.format(r"regexp_replace(t, '\\\[(?s:.*?)\\\]', '', 'g')")} AS no_latex FROM (SELECT item_id, {_LATEX_T} AS t FROM benchmark)""",
    "match_labels": "SELECT event_id, CASE WHEN s >= 0.25 THEN 'strong match' WHEN s >= 0.08 THEN 'partial match' ELSE 'weak match' END AS label, CASE WHEN s >= 0.25 THEN 'match-high' WHEN s >= 0.08 THEN 'match-medium' ELSE 'match-low' END AS css_class FROM (SELECT event_id, (event_id % 40)::DOUBLE / 100.0::DOUBLE AS s FROM events)",
    "html_escape": """SELECT page_id, md5(replace(replace(replace(replace(replace(html || '''"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped_md5 FROM pages""",
    "short_labels": "SELECT page_id, CASE WHEN length(url) > 28 THEN substr(url, 1, 28) || '…' ELSE url END AS label, CASE WHEN length(url) > 40 THEN substr(url, 1, 40) || '…' ELSE url END AS caption FROM pages",
    "word_prefixes": r"SELECT item_id, len(w)::INT AS n_steps, md5(array_to_string(list_transform(range(1, len(w) + 1), lambda i: array_to_string(w[1:i], ' ')), '|')) AS steps_md5 FROM (SELECT item_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM benchmark)",
    "prompts": f"SELECT item_id, md5({_text(gates.HOSTED_PROMPT)} || text || chr(10) || chr(10) || 'QUESTION:' || chr(10) || reverse(text) || ' [/INST]') AS hosted_md5, md5({_text(gates.LOCAL_PROMPT)} || text || chr(10) || chr(10) || 'QUESTION:' || chr(10) || reverse(text) || chr(10) || chr(10) || 'ANSWER:') AS local_md5 FROM benchmark",
    "cache_keys": "SELECT doc_id, md5(text) AS text_hash, md5(source || ':' || md5(text)) AS cache_key FROM documents",
    "overlap_gate": f"WITH {_TURNS}, r AS (SELECT conv_id, turn, round({_OVERLAP.format(a='a', e='e')}, 6) AS ratio FROM (SELECT conv_id, turn, {_WORDS.format('text')} AS a, {_WORDS.format('evidence')} AS e FROM turns)) SELECT conv_id, turn, ratio, ratio >= 0.18 AS hosted_ok, ratio >= 0.12 AS local_ok FROM r",
    "repetition_gate": f"WITH {_TURNS}, r AS (SELECT conv_id, turn, {_REPEAT.format('text')} AS share FROM turns) SELECT conv_id, turn, round(share, 6) AS share, share <= 0.4 AS ok FROM r",
    "generation_gate": rf"""WITH {_TURNS}, given AS (
  SELECT conv_id, turn, trim(text) AS a, trim(regexp_replace(trim(text) || ' ;(', '[, ;(]+$', '')) AS b, CASE WHEN turn % 3 = 0 THEN text ELSE evidence END AS own FROM turns)
SELECT conv_id, turn,
  CASE WHEN length(a || ' ;(') > 5 AND {_REPEAT.format("a || ' ;('")} <= 0.4 AND {_OVERLAP.format(a=_WORDS.format('b'), e=_WORDS.format('own'))} >= 0.18 THEN b END AS hosted,
  CASE WHEN length(a) >= 10 AND {_OVERLAP.format(a=_WORDS.format('a'), e=_WORDS.format('own'))} >= 0.12 THEN a END AS local FROM given""",
    "dedup_paragraphs": _DEDUP_SQL,
    "dedup_paragraphs_long": _DEDUP_SQL,
    "pasted_text": "SELECT 'Pasted text' AS source_name, trim(text) AS text FROM benchmark WHERE item_id % 5 <> 0",
    "pdf_normalize_lines": f"WITH {_PAGES} SELECT conv_id, page, page_text AS text FROM norm",
    "pdf_blocks": """WITH b AS (
  SELECT event_id, i, (event_id * 7 * i) % 13 / 8.0::DOUBLE AS x0, (event_id * i) % 3 / 16.0::DOUBLE AS y0 FROM events, range(1, 5) t(i) WHERE i <> 3)
SELECT event_id, string_agg('b' || i, chr(10) ORDER BY round(y0, 1), round(x0, 1), 'b' || i) AS text FROM b GROUP BY event_id""",
    "pdf_headings": f"WITH {_PAGES} SELECT conv_id, para_idx::INT AS para_idx, section FROM heads",
    "pdf_page_map": f"WITH {_PAGES} SELECT conv_id, para_idx::INT AS para_idx, page FROM starts",
    "pdf_documents": f"""WITH {_PAGES}, whole AS (SELECT conv_id, trim(coalesce(string_agg(page_text, chr(10) || chr(10) ORDER BY page) FILTER (WHERE page_text <> ''), ''), ' ' || chr(10)) AS text FROM page_texts GROUP BY conv_id)
SELECT conv_id, text, CASE WHEN text = '' THEN 0 ELSE (SELECT count(*) FROM heads h WHERE h.conv_id = w.conv_id) END::INT AS n_sections, CASE WHEN text = '' THEN 0 ELSE (SELECT count(*) FROM starts s WHERE s.conv_id = w.conv_id) END::INT AS n_pages,
  CASE WHEN text = '' THEN {_text(pdf.NO_TEXT)} ELSE '' END AS err FROM whole w""",
    "pdf_size_guard": "SELECT o_orderkey AS path, 52428800 + o_orderkey % 3 - 1 AS length, CASE WHEN 52428800 + o_orderkey % 3 - 1 > 52428800 THEN 'PDF exceeds the 50 MB size limit. Please use a smaller file.' ELSE '' END AS err FROM orders",
    "registry_upsert": """WITH e AS (SELECT event_id AS seq, event_id % 7 = 3 AS gone, user_id::VARCHAR AS source_name, event_type AS workspace FROM events),
d AS (SELECT workspace, source_name, max(seq) AS gone_at FROM e WHERE gone GROUP BY ALL),
live AS (SELECT e.* FROM e LEFT JOIN d USING (workspace, source_name) WHERE NOT gone AND (gone_at IS NULL OR seq > gone_at)),
last AS (SELECT workspace, source_name, max(seq) AS seq, min(seq) AS since FROM live GROUP BY ALL)
SELECT workspace, source_name, md5(seq::VARCHAR) AS kb_id, (seq % 9 + 2)::INT AS chunk_count, row_number() OVER (PARTITION BY workspace ORDER BY since) - 1 AS position FROM last""",
    "registry_delete": "SELECT n_name AS source_name, CASE WHEN n_nationkey > 7 THEN n_nationkey - 1 ELSE n_nationkey END::BIGINT AS position, 23::BIGINT AS active FROM nation WHERE n_nationkey <> 7",
    "registry_active": "SELECT n_name AS source_name, n_nationkey::BIGINT AS position FROM nation WHERE n_nationkey = 3",
}
