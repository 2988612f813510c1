"""Pasted text as a source: one name, so each paste takes the place of the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import strip

NAME = "Pasted text"


def pasted(rows: DataFrame, text: str = "text") -> DataFrame:
    """source_name and text of pasted texts that aren't blank."""
    return rows.select(F.lit(NAME).alias("source_name"), strip(F.coalesce(F.col(text), F.lit(""))).alias("text")).where("text <> ''")
