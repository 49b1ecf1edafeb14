"""Which pages need a model, and runs of pages of one kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Symbols whose number tells a page of formulas, and the thresholds.
SYMBOLS = "√∑∫∞≤≥≠≈±×÷πλμαβγθωφΔΩ"
STROKES, MATH, FRACTIONS = 40, 8, 2


def is_complex(text: Column, scan: Column, has_table: Column, strokes: Column) -> Column:
    """Whether a page is more than plain text: a scan, a table, many strokes, many symbols, fractions or flattened powers of ten."""
    italics = F.regexp_count(text, F.lit(r"[\x{1D400}-\x{1D7FF}]"))
    symbols = F.regexp_count(text, F.lit(f"[{SYMBOLS}]"))
    functions = text.rlike(r"\b(cos|sin|tan|cot|log|ln|sqrt)\b") | F.contains(text, F.lit("√"))
    fractions = F.regexp_count(text, F.lit("[0-9πλμαβγθωφ] */ *[0-9πλμαβγθωφ]"))
    powers = text.rlike("[.,xX×·] *10 *-?[0-9]")
    return scan | has_table | (strokes > STROKES) | (symbols + italics >= MATH) | (functions & (italics >= 2)) | (fractions >= FRACTIONS) | powers


def page_ranges(pages: DataFrame, key: str) -> DataFrame:
    """Runs of consecutive pages (key, idx, hard) of one kind: kind C or S, first_page, last_page, n."""
    island = F.col("idx") - F.row_number().over(Window.partitionBy(key, "hard").orderBy("idx"))
    runs = pages.withColumn("island", island).groupBy(key, "hard", "island").agg(F.min("idx").alias("first_page"), F.max("idx").alias("last_page"), F.count("*").alias("n"))
    return runs.select(key, F.when(F.col("hard"), "C").otherwise("S").alias("kind"), "first_page", "last_page", "n")
