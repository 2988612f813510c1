"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a frame with
the columns of documents; the last returns what it read back from its token files.

Nulls: a null text fails the quality rules.  A null doc_id is a document like any other; in the
near-duplicate stage, where one document of each group stays, it stays only if no other of its group has
an id.  Rows that repeat the id that stays leave one row.  Empty tables pass through all stages.  Columns
of documents beyond those that a stage changes are kept as they are, whatever their names.  Texts of any
length are worked on whole.  Ties: of a group the smallest id stays, and of equal ids the row that was
read first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import fm_index, mixing, quality_rules, simhash, token_files
from lectern.plans.session import ready
from lectern.plans.storage import materialize, materialize_alone, new_path, release


def _row_numbers(docs: DataFrame, tag: str) -> DataFrame:
    """docs, written, with a number for each row in _row."""
    return materialize(docs.withColumn("_row", F.monotonically_increasing_id()), tag)


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in a struct _rest, where their names can't clash."""
    others = [F.col(f"`{c}`").alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others or [F.lit(0).alias("none")]).alias("_rest"))


def _unpacked(rows: DataFrame, docs: DataFrame, text=None) -> DataFrame:
    """The columns of docs from rows with doc_id, text and _rest; with another text, if given, and n_chars to fit."""
    out = []
    for field in docs.schema.fields:
        if field.name == "doc_id":
            value = F.col("doc_id")
        elif field.name == "text":
            value = F.col("text") if text is None else text
        elif field.name == "n_chars" and text is not None:
            value = F.length(text).cast(field.dataType)
        else:
            value = F.col("_rest").getField(field.name)
        out.append(value.alias(field.name))
    return rows.select(*out)


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that failed."""
    kept = quality_rules.quality_rules(_packed(docs), want_text=True, carry=["_rest"]).where("kept")
    return _unpacked(kept, docs, F.col("clean_text"))


def near_duplicate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component one document: that with the smallest id."""
    numbered = _row_numbers(_packed(docs), "pipeline-rows")
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")
    groups = simhash.near_duplicates(numbered.select(key.alias("doc_id"), "text"))
    stays = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id._row").alias("_row"))
    return _unpacked(numbered.join(stays, "_row", "left_semi"), docs)


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of benchmark items."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = fm_index.removal_spans(fm_index.decontaminate(_packed(docs), bench, carry=["_rest"]))
    return _unpacked(found, docs, F.col("clean_text"))


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole ones, and the first words of a part."""
    numbered = _row_numbers(_packed(docs), "pipeline-rows")
    source = F.col("_rest.source") if "source" in docs.columns else F.lit(None).cast("string")
    taken = mixing.mix(numbered.select(F.struct("doc_id", "_row").alias("doc_id"), source.alias("source"), "text"), key="doc_id.doc_id")
    both = numbered.join(taken.select(F.col("doc_id._row").alias("_row"), "size", "whole", "part"), "_row")
    part = F.when(F.col("part") > 0, F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>"))
    copies = both.withColumn("_whole", F.explode(F.concat(F.array_repeat(F.lit(True), F.col("whole").cast("int")), part)))
    words = F.slice(F.regexp_extract_all("text", F.lit(f"({mixing.WORD})")), 1, F.col("part").cast("int"))
    text = F.when(F.col("_whole") | (F.col("part") >= F.col("size")), F.col("text")).otherwise(F.array_join(words, " "))
    return _unpacked(copies, docs, text)


def token_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all texts, read back: doc_id, start, n_tokens, ids_crc32."""
    path = new_path(spark, "pipeline-tokens")
    token_files.write_token_files(docs, path)
    return token_files.read_token_files(spark, path)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_files", token_stage),
]

#: XXH64 and byte-level BPE aren't in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read by the next."""
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(before)  # written by the stage before; the documents' own table isn't ours
    return STAGES[-1][1](spark, docs, sf_dir)
