"""Documents to chunks with attribution: ordered dedup, the chunk fold, as-of maps. All native.

The fold is one `aggregate` over a document's paragraphs. Its inner loop, which cuts windows off a
running chunk that has grown past 1.5 times the size, has a closed form: with L words, limit and
stride, max(0, ceil((L - limit) / stride)) windows leave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.config import DEFAULT, Settings
from lectern.functions import text as T
from lectern.operators.ordered import last_value
from lectern.plans.session import spread


def dedup_paragraphs(x: Column | str, least: int = 40) -> Column:
    """Lines, stripped and not blank; of lines of `least` characters or more that are equal but for case and spaces, the first."""
    kept = F.filter(F.transform(T.lines(F.coalesce(T.as_column(x), F.lit(""))), T.strip), lambda s: s != "")
    keyed = F.sort_array(F.transform(kept, lambda s, i: F.struct(F.lower(T.normalize_ws(s)).alias("key"), i.alias("at"), s.alias("line"))))
    # in order of (key, place) a line repeats if the one before has its key
    new = lambda rows: F.filter(rows, lambda r, i: (F.length(r["key"]) < least) | (i == 0) | (F.get(rows, i - 1)["key"] != r["key"]))
    back = F.sort_array(F.transform(T.let(keyed, new), lambda r: F.struct(r["at"].alias("at"), r["line"].alias("line"))))
    return F.array_join(F.transform(back, lambda r: r["line"]), "\n")


def dedup_long(docs: DataFrame, key: str = "doc_id", least: int = 40) -> DataFrame:
    """The same dedup for documents of any number of lines, as a shuffle by document and line."""
    rows = docs.select(key, F.posexplode(T.lines(F.coalesce("text", F.lit("")))).alias("pos", "raw")).withColumn("line", T.strip("raw")).where("line <> ''")
    rows = rows.withColumn("norm", F.lower(T.normalize_ws("line")))
    first = F.row_number().over(Window.partitionBy(key, "norm").orderBy("pos"))
    kept = rows.withColumn("n", first).where((F.length("norm") < least) | (F.col("n") == 1))
    joined = kept.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("rows"))
    joined = joined.select(key, F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"))
    return docs.select(key).join(joined, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


def chunk_array(x: Column | str, cfg: Settings = DEFAULT) -> Column:
    """The chunks of a text as an array of strings.

    A running chunk is always a range of the document's words (what it keeps of the chunk before are the
    words just before it), so the fold runs over word counts and gives ranges, which are cut out at the end.
    """
    size, overlap, limit, stride = cfg.chunk_size, cfg.overlap, cfg.limit, cfg.stride
    paras = F.filter(F.transform(F.split(F.coalesce(T.as_column(x), F.lit("")), "\n"), T.normalize_ws), lambda p: p != "")
    pair = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    none = F.array().cast("array<struct<a:int,b:int>>")

    def step(acc: Column, para: Column) -> Column:
        a, b, out = acc["a"], acc["b"], acc["out"]

        def grow(n: Column) -> Column:
            full = (b > a) & (b - a + n > size)
            start, end = F.when(full, F.greatest(a, b - overlap)).otherwise(a), b + n

            def cut(windows: Column) -> Column:
                made = F.concat(
                    out, F.when(full, F.array(pair(a, b))).otherwise(none),
                    F.when(windows > 0, F.transform(F.sequence(F.lit(0), windows - 1), lambda k: pair(start + k * stride, start + k * stride + size))).otherwise(none),
                )
                return F.struct((start + windows * stride).cast("int").alias("a"), end.alias("b"), F.when(full | (windows > 0), made).otherwise(out).alias("out"))

            return T.let(F.greatest(F.lit(0), F.ceil((end - start - limit) / stride).cast("int")), cut)

        return T.let(F.size(F.split(para, " ")), grow)

    finish = lambda acc: F.when(acc["b"] > acc["a"], F.concat(acc["out"], F.array(pair(acc["a"], acc["b"])))).otherwise(acc["out"])
    ranges = lambda ps: F.aggregate(ps, F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), none.alias("out")), step, finish)
    cut_out = lambda ps: T.let(F.split(F.array_join(ps, " "), " "), lambda w: F.transform(ranges(ps), lambda r: F.array_join(F.slice(w, r["a"] + 1, r["b"] - r["a"]), " ")))
    return F.filter(T.let(paras, cut_out), lambda c: F.length(c) >= cfg.min_chunk_chars)


def as_of(entries: Column | str, at: Column | str) -> Column:
    """The map's value at the greatest key that isn't beyond `at`; null without one."""
    m, at = T.as_column(entries), T.as_column(at)
    key = F.array_max(F.filter(F.map_keys(m), lambda k: k <= at))
    return F.when(key.isNotNull(), F.element_at(m, key))


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], at: str, key: str, value: str) -> DataFrame:
    """The same for maps of any size, given as rows (by, key, value): both sides in one order, the last value carried on.

    Ranges of (by, key) are worked through apart (`ordered.last_value`), so a collection with half of all rows is
    spread over tasks. Null values are passed over; rows of left without a key before them get null.
    """
    width = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in by]
    rows = left.withColumns({"_key": F.col(at).cast("long"), "_side": F.lit(1), "_value": F.lit(None).cast(right.schema[value].dataType)})
    other = right.select(*by, *width, F.col(key).cast("long").alias("_key"), F.lit(0).alias("_side"), F.col(value).alias("_value"))
    both = last_value(rows.unionByName(other), by, ["_key", "_side"], "_value", value)
    return both.where("_side = 1").drop("_key", "_side", "_value")


def chunks(docs: DataFrame, cfg: Settings = DEFAULT, kb: str = "kb_id") -> DataFrame:
    """kb_id, chunk_idx, chunk, section, page, embed_text of documents (kb_id, text, and section_map, page_map if there are).

    Null and empty texts, and those whose chunks are all too short, give no rows; `indexable` has a message for them.
    Rows are independent of each other: documents that repeat an id give chunks of equal names, which `indexable` tells.
    Attribution probes the maps, which are keyed by paragraph, with the chunk's index; this is how the
    engine has always read them.
    """
    # an inner explode would infer a filter that computes the chunks again
    made = spread(docs).withColumn("_chunks", chunk_array(dedup_paragraphs("text", cfg.dedup_min_chars), cfg))
    maps = [c for c in ("section_map", "page_map") if c in docs.columns]
    made = made.select(kb, *maps, F.posexplode_outer("_chunks").alias("chunk_idx", "chunk")).where("chunk_idx IS NOT NULL")
    section = F.coalesce(as_of("section_map", "chunk_idx"), F.lit("")) if "section_map" in maps else F.lit("")
    page = as_of("page_map", "chunk_idx") if "page_map" in maps else F.lit(None).cast("int")
    return made.select(kb, "chunk_idx", "chunk", section.alias("section"), page.alias("page")).withColumn("embed_text", T.embed_text("section", "chunk"))


#: Fixed value: what is said of a document that is too short.
TOO_SHORT = "Not enough text to index. Try a longer document."
REPEATED = "The collection's id is given more than once."


def indexable(docs: DataFrame, chunked: DataFrame, cfg: Settings = DEFAULT, kb: str = "kb_id") -> DataFrame:
    """n_chunks of each collection of docs, those without any chunk included, and err where it can't be indexed.

    A null or empty text has no chunks. Chunks of two documents under one id can't be told apart: such a collection isn't indexed either.
    """
    ids = docs.groupBy(kb).agg(F.count(F.lit(1)).alias("_given"))
    counts = chunked.groupBy(kb).agg(F.count(F.lit(1)).alias("n_chunks"))
    found = ids.join(counts, ids[kb].eqNullSafe(counts[kb]), "left").select(ids[kb], F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"), "_given")
    err = F.when(F.col("_given") > 1, REPEATED).when(F.col("n_chunks") < cfg.min_chunks, TOO_SHORT).otherwise("")
    return found.select(kb, "n_chunks", err.alias("err"))


def rejected(chunked: DataFrame, cfg: Settings = DEFAULT, kb: str = "kb_id") -> DataFrame:
    """kb of the collections with chunks that can't be indexed: too few, or under an id that is given twice."""
    counts = chunked.groupBy(kb).agg(F.count(F.lit(1)).alias("n"), F.max("chunk_idx").alias("last"))
    return counts.where((F.col("n") < cfg.min_chunks) | (F.col("n") > F.col("last") + 1)).select(kb)
