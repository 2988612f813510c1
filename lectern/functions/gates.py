"""Gates that a generated answer has to pass, and the prompts, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import as_column, let, strip, words

#: Least overlap with the evidence, least length, most repetition.
HOSTED_OVERLAP, LOCAL_OVERLAP = 0.18, 0.12
HOSTED_LONGER_THAN, LOCAL_LEAST = 5, 10
REPEAT_WORDS, REPEAT_SHARE = 4, 0.40


def content_words(x: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(as_column(x), F.lit(""))), F.lit("([a-zA-Z]{4,})"))


def overlap_ratio(answer: Column | str, evidence: Column | str) -> Column:
    """Share of the answer's words of four letters or more that stand in the evidence."""
    share = lambda a, known: F.when(F.size(a) > 0, F.size(F.filter(a, lambda w: F.array_contains(known, w))) / F.size(a)).otherwise(F.lit(0.0))
    return let(F.array_distinct(content_words(evidence)), lambda known: let(content_words(answer), lambda a: share(a, known)))


def repeat_share(answer: Column | str) -> Column:
    """Share of the most frequent word, 0 for answers of fewer than four words."""
    low = F.sort_array(F.transform(words(answer), F.lower))
    # in sorted order the longest run of a word gives its count
    runs = lambda w: F.aggregate(
        w, F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most")),
        lambda a, x: let(F.when(x == a["last"], a["run"] + 1).otherwise(F.lit(1)), lambda r: F.struct(x.alias("last"), r.alias("run"), F.greatest(a["most"], r).alias("most"))),
        lambda a: a["most"],
    )
    return let(low, lambda w: F.when(F.size(w) >= REPEAT_WORDS, runs(w) / F.size(w)).otherwise(F.lit(0.0)))


def without_prompt(answer: Column | str) -> Column:
    return strip(F.regexp_replace(strip(F.coalesce(as_column(answer), F.lit(""))), r"(?s)\[INST\].*?\[/INST\]", ""))


def trimmed_end(answer: Column | str) -> Column:
    return strip(F.regexp_replace(as_column(answer), r"[, ;(]+$", ""))


def hosted_answer(answer: Column | str, evidence: Column | str) -> Column:
    """The cleaned answer, or null where a gate refuses it: length, repetition, then overlap."""
    clean = without_prompt(answer)
    return let(clean, lambda a: F.when((F.length(a) > HOSTED_LONGER_THAN) & (repeat_share(a) <= REPEAT_SHARE) & (overlap_ratio(trimmed_end(a), evidence) >= HOSTED_OVERLAP), trimmed_end(a)))


def local_answer(answer: Column | str, evidence: Column | str) -> Column:
    clean = strip(F.coalesce(as_column(answer), F.lit("")))
    return F.when((F.length(clean) >= LOCAL_LEAST) & (overlap_ratio(clean, evidence) >= LOCAL_OVERLAP), clean)


#: The wording that models were tuned to.
HOSTED_PROMPT = (
    "[INST] You are a careful assistant. Answer the QUESTION using ONLY the EVIDENCE below.\n"
    'If the evidence is insufficient, say: "I cannot determine this from the document."\n\n'
    "Rules:\n- Write a direct answer first (1 to 3 sentences).\n"
    '- Then add "Details" as bullet points if helpful.\n'
    "- Every factual claim must include a citation in parentheses using the evidence tag,\n"
    "  for example: (§ Methods · p. 3) or (Chunk: 12).\n"
    "- Do not invent citations. Do not use outside knowledge.\n\nEVIDENCE:\n"
)
LOCAL_PROMPT = (
    "You are a careful assistant. Use ONLY the evidence. Cite every claim using the bracket tags.\n"
    'If insufficient, say: "I cannot determine this from the document."\n\nEVIDENCE:\n'
)


def hosted_prompt(question: Column | str, evidence: Column | str) -> Column:
    return F.concat(F.lit(HOSTED_PROMPT), as_column(evidence), F.lit("\n\nQUESTION:\n"), as_column(question), F.lit(" [/INST]"))


def local_prompt(question: Column | str, evidence: Column | str) -> Column:
    return F.concat(F.lit(LOCAL_PROMPT), as_column(evidence), F.lit("\n\nQUESTION:\n"), as_column(question), F.lit("\n\nANSWER:"))
