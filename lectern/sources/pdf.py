"""PDF files to text with page and section maps: size guard, text or block extraction, OCR, assembly.

Parsing and OCR are providers; everything after them is native and works on rows of pages.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from lectern.config import DEFAULT, Settings
from lectern.functions import text as T
from lectern.providers import PageParser

#: Messages about files.
NO_TEXT = "PDF parsed but no usable text found. It appears to be scanned/image-only and OCR is not available. Install pytesseract and Pillow to enable OCR support."
OCR_NOTE = " (OCR used for some pages)"
NO_PARSER = "No PDF parser is installed."


@pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which has no native function."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalize_lines(x: Column | str, compose: bool = True) -> Column:
    """Joined hyphenation, stripped lines, spaces where case or digits change, blank lines kept."""
    x = F.coalesce(T.as_column(x), F.lit(""))
    x = F.replace(nfkc(x) if compose else x, F.lit(" "), F.lit(" "))
    x = F.regexp_replace(x, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    def line(s: Column) -> Column:
        s = F.regexp_replace(s, "([a-z])([A-Z])", "$1 $2")
        s = F.regexp_replace(s, r"([A-Za-z])(\p{Nd})", "$1 $2")
        return T.normalize_ws(F.regexp_replace(s, r"(\p{Nd})([A-Za-z])", "$1 $2"))

    return T.strip(F.array_join(F.transform(F.transform(T.lines(x), T.strip), line), "\n"))


def blocks_text(blocks: Column | str) -> Column:
    """Blocks (x0, y0, text) in reading order: by height, then from the left, both to a tenth."""
    rows = F.transform(T.as_column(blocks), lambda b: F.struct(F.round(b["y0"], 1).alias("y"), F.round(b["x0"], 1).alias("x"), T.strip(F.coalesce(b["text"], F.lit(""))).alias("text")))
    return F.array_join(F.transform(F.array_sort(F.filter(rows, lambda r: r["text"] != "")), lambda r: r["text"]), "\n")


def within_limit(files: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """files (path, length, content) with err for those over the limit; their content isn't needed after this."""
    message = f"PDF exceeds the {cfg.pdf_max_bytes // (1024 * 1024)} MB size limit. Please use a smaller file."
    return files.withColumn("err", F.when(F.col("length") > cfg.pdf_max_bytes, F.lit(message)).otherwise(F.lit("")))


def installed_parser() -> Callable[[], PageParser] | None:
    """The adapter to an installed PDF library, if there is one."""
    from lectern.providers import MuPdfPages

    return MuPdfPages if MuPdfPages.available() else None


def parse_pages(files: DataFrame, parser: Callable[[], PageParser] | None, scanned: int = 0) -> DataFrame:
    """path, page, raw, blocks, ocr, err: a row per page, or one row (page null) with the error of a file.

    A parser that can read images (`ocr(content, page)`) is asked for pages with fewer than `scanned` characters.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = parser() if parser else None
        block = pa.list_(pa.struct([("x0", pa.float64()), ("y0", pa.float64()), ("text", pa.string())]))
        for batch in batches:
            for path, content, err in zip(batch.column("path").to_pylist(), batch.column("content"), batch.column("err").to_pylist(), strict=True):
                rows = []
                if not err and reader is None:
                    err = NO_PARSER
                if not err:
                    try:
                        data, look = content.as_py(), getattr(reader, "ocr", None)
                        for n, (raw, blocks) in enumerate(reader.pages(data), 1):
                            thin = max(len(raw.strip()), len("\n".join(t.strip() for _, _, t in blocks))) < scanned
                            rows.append((path, n, raw, [{"x0": x, "y0": y, "text": t} for x, y, t in blocks], look(data, n) if look and thin else "", ""))
                    except Exception as e:  # noqa: BLE001 - errors are data
                        rows, err = [], f"PDF parse error: {e}"
                rows = rows or [(path, None, "", [], "", err or NO_TEXT)]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), block, pa.string(), pa.string()), strict=True)], names=["path", "page", "raw", "blocks", "ocr", "err"])

    lean = files.select("path", F.when(F.col("err") == "", F.col("content")).alias("content"), "err")
    return lean.mapInArrow(work, "path string, page int, raw string, blocks array<struct<x0:double,y0:double,text:string>>, ocr string, err string")


def page_texts(pages: DataFrame, ocr: Column | None = None, cfg: Settings = DEFAULT, compose: bool = True) -> DataFrame:
    """pages with page_text and ocr_used: the text stream, the blocks where they give more, then OCR; else ''."""
    out = pages.withColumn("_raw", normalize_lines("raw", compose)).withColumn("_alt", normalize_lines(blocks_text("blocks"), compose))
    thin = lambda c: T.looks_scanned(c, cfg.scanned_chars)
    out = out.withColumn("_raw", F.when(thin("_raw") & (F.length("_alt") > F.length("_raw")), F.col("_alt")).otherwise(F.col("_raw")))
    read = F.coalesce(ocr, F.lit("")) if ocr is not None else F.lit("")
    out = out.withColumn("_ocr", F.when(thin("_raw"), read)).withColumn("ocr_used", F.coalesce(T.strip("_ocr") != "", F.lit(False)))
    return out.withColumn("page_text", F.when(~thin("_raw"), F.col("_raw")).when(F.col("ocr_used"), normalize_lines("_ocr", compose)).otherwise(F.lit(""))).drop("_raw", "_alt", "_ocr")


def paragraph_lines(pages: DataFrame, key: str = "path") -> DataFrame:
    """key, page, line, para_idx of the non-blank lines of page_text; numbering runs on over pages."""
    rows = pages.select(key, "page", F.posexplode(T.lines("page_text")).alias("pos", "raw_line")).withColumn("line", T.strip("raw_line")).where("line <> ''")
    at = F.row_number().over(Window.partitionBy(key).orderBy("page", "pos")) - 1
    return rows.select(key, "page", "line", at.alias("para_idx"))


def section_entries(lines: DataFrame, key: str = "path") -> DataFrame:
    """key, para_idx, section of the lines that are headings."""
    return lines.where(T.is_heading("line")).select(key, "para_idx", F.col("line").alias("section"))


def page_entries(pages: DataFrame, lines: DataFrame, key: str = "path") -> DataFrame:
    """key, para_idx, page: where each page starts; of pages that start at one place (the empty ones) the last."""
    per = lines.groupBy(key, "page").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(key).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    starts = pages.select(key, "page").join(per, [key, "page"], "left").withColumn("para_idx", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int"))
    return starts.groupBy(key, "para_idx").agg(F.max("page").alias("page"))


def assemble(pages: DataFrame, key: str = "path") -> DataFrame:
    """key, text, section_map, page_map, err of a document's pages (page_text, ocr_used, err)."""
    good = pages.where(F.col("page").isNotNull())
    lines = paragraph_lines(good, key)
    as_map = lambda df, v: df.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("para_idx", v)))).alias(f"{v}_map"))
    row = F.struct("page", "page_text")
    whole = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("page_text") != "", row))).alias("rows"), F.max(F.coalesce("ocr_used", F.lit(False))).alias("ocr_used"), F.max("err").alias("failed"))
    whole = whole.withColumn("text", T.strip(F.array_join(F.transform("rows", lambda r: r["page_text"]), "\n\n")))
    both = whole.join(as_map(section_entries(lines, key), "section"), key, "left").join(as_map(page_entries(good, lines, key), "page"), key, "left")
    err = F.when(F.col("failed") != "", F.col("failed")).when(F.col("text") == "", F.lit(NO_TEXT)).when(F.col("ocr_used"), F.lit(OCR_NOTE)).otherwise(F.lit(""))
    empty = F.col("text") == ""
    keep = lambda c, kind: F.when(empty | F.col(c).isNull(), F.create_map().cast(kind)).otherwise(F.col(c))
    return both.select(key, "text", keep("section_map", "map<int,string>").alias("section_map"), keep("page_map", "map<int,int>").alias("page_map"), err.alias("err"))


def load_pdfs(spark, path: str, parser: Callable[[], PageParser] | None = None, ocr: Callable[[DataFrame], Column] | None = None, cfg: Settings = DEFAULT) -> DataFrame:
    """path, text, section_map, page_map, err of the PDF files under a path.

    The limit is a filter on the files' lengths, which the source applies before it reads contents.
    """
    files = spark.read.format("binaryFile").load(path)
    read = within_limit(files.where(F.col("length") <= cfg.pdf_max_bytes).select("path", "length", "content"), cfg)
    refused = within_limit(files.where(F.col("length") > cfg.pdf_max_bytes).select("path", "length"), cfg)
    pages = parse_pages(read, parser if parser is not None else installed_parser(), scanned=cfg.scanned_chars if ocr is None else 0)
    done = assemble(page_texts(pages, ocr(pages) if ocr else F.col("ocr"), cfg))
    empty = [F.create_map().cast(kind).alias(name) for name, kind in (("section_map", "map<int,string>"), ("page_map", "map<int,int>"))]
    return done.unionByName(refused.select("path", F.lit("").alias("text"), *empty, "err"))
