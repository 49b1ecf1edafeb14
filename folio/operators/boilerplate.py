"""Repeated short lines, effective text and scan rules over pages: (doc, page, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LINE_MAX, PAGE_FRACTION, SAMPLE = 80, 0.80, 24
TEXT_MAX, RAW_MAX, COVER_MIN, STROKES_MIN, EMPTY_MAX = 200, 800, 0.70, 40, 20
GRID = 32
DIGITAL = 0.80
CHUNK, LARGE, SECONDS = 50, 80, 10


def sampled(pages: DataFrame, sample: int | None = SAMPLE) -> DataFrame:
    """At most `sample` evenly spaced pages of each doc; pages must be numbered from 0 in `page`."""
    if sample is None:
        return pages
    counts = pages.groupBy("doc").agg(F.count("*").alias("n"))
    p, n = F.col("page"), F.col("n")
    # Page p is floor(i * n / sample) for some i exactly if the next multiple of n / sample from p on is below p + 1.
    picked = (n <= sample) | (F.floor(F.ceil(p * F.lit(float(sample)) / n) * n / F.lit(float(sample))) == p)
    return pages.join(counts, "doc").filter(picked).drop("n")


def boilerplate(pages: DataFrame, fraction: float = PAGE_FRACTION, sample: int | None = None) -> DataFrame:
    """doc, norm, n_pages, need: short lines on at least max(2, round(fraction * pages)) pages, and page numbers.

    A page is one row, so its lines are made distinct before they are exploded, without a shuffle; the counts are
    combined before theirs, so a line on every page of a large doc is one row a task. Page totals read no text.
    """
    chosen = sampled(pages, sample)
    totals = chosen.groupBy("doc").agg(F.count("*").alias("pages"))
    norms = F.array_distinct(F.filter(F.transform(T.lines(F.col("text")), T.norm_line), lambda x: (x != "") & (F.length(x) <= LINE_MAX)))
    counts = chosen.select("doc", F.explode(norms).alias("norm")).groupBy("doc", "norm").agg(F.count("*").alias("n_pages"))
    need = F.greatest(F.lit(2), F.bround(F.col("pages") * F.lit(fraction)).cast("int"))
    return counts.join(totals, "doc").withColumn("need", need).filter((F.col("n_pages") >= F.col("need")) | T.is_page_number(F.col("norm"))).select("doc", "norm", "n_pages", "need")


def effective_text(pages: DataFrame, boiler: DataFrame) -> DataFrame:
    """doc, page, raw and effective: a page's text, and without empty, boilerplate and page-number lines, in order.

    A doc has few repeated lines (at most its lines a page over the fraction), so they come to its pages as an array,
    and each text is filtered where it is: one scan and one join on doc, in which no line moves by itself.
    """
    repeated = boiler.filter(~T.is_page_number(F.col("norm"))).groupBy("doc").agg(F.collect_set("norm").alias("repeated"))
    none = F.array().cast("array<string>")

    def keep(line: Column) -> Column:
        norm = T.norm_line(line)
        return (norm != "") & ~T.is_page_number(norm) & ~F.array_contains(F.coalesce("repeated", none), norm)

    kept = F.transform(F.filter(T.lines(F.col("text")), keep), T.strip)
    out = pages.join(repeated, "doc", "left")
    return out.select("doc", "page", T.strip(F.coalesce("text", F.lit(""))).alias("raw"), T.strip(F.array_join(kept, "\n")).alias("effective"))


def is_scan(raw: Column, effective: Column, cover: Column, images: Column, strokes: Column) -> Column:
    """Whether a page is a scan: enough text says no, then an image over most of the page says yes, then images or many
    strokes on a page without text."""
    return (
        F.when((F.length(effective) >= TEXT_MAX) | (F.length(raw) >= RAW_MAX), False)
        .when(cover >= COVER_MIN, True)
        .otherwise((F.length(effective) <= EMPTY_MAX) & ((images > 0) | (strokes >= STROKES_MIN)))
    )


def coverage(boxes: DataFrame, sizes: DataFrame, grid: int = GRID) -> DataFrame:
    """doc, page, cover: the part of a page under boxes, on the centres of a grid; a single large box counts by area.

    boxes: doc, page, x0, y0, x1, y1; sizes: doc, page, width, height. A box yields the cells it covers, so the
    work follows the boxes and not all cells of all pages.
    """
    b = boxes.join(sizes, ["doc", "page"])
    share = F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")) * F.greatest(F.lit(0.0), F.col("y1") - F.col("y0")) / (F.col("width") * F.col("height"))
    big = b.groupBy("doc", "page").agg(F.max(share).alias("big"))

    def cells(low: str, high: str, size: str) -> Column:
        first = F.greatest(F.lit(0), F.ceil(F.col(low) * grid / F.col(size) - 0.5)).cast("int")
        last = F.least(F.lit(grid - 1), F.floor(F.col(high) * grid / F.col(size) - 0.5)).cast("int")
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    hit = b.select("doc", "page", F.explode(cells("x0", "x1", "width")).alias("gx"), "y0", "y1", "height").select("doc", "page", "gx", F.explode(cells("y0", "y1", "height")).alias("gy"))
    hits = hit.distinct().groupBy("doc", "page").agg(F.count("*").alias("hits"))
    cover = F.when(F.col("big") >= COVER_MIN, F.least("big", F.lit(1.0))).otherwise(F.coalesce("hits", F.lit(0)) / F.lit(float(grid * grid)))
    return sizes.join(big, ["doc", "page"], "left").join(hits, ["doc", "page"], "left").select("doc", "page", F.coalesce(cover, F.lit(0.0)).alias("cover"))


def summary(pages: DataFrame, boiler: DataFrame, shown: int = 12) -> DataFrame:
    """A row for each doc of pages (doc, page, scan): pages, checked, pages_with_text, coverage, is_digital, is_scan_doc,
    scan_pages and the first boilerplate lines."""
    sums = pages.groupBy("doc").agg(F.count("*").alias("pages"), F.count_if(~F.col("scan")).alias("pages_with_text"), F.array_sort(F.collect_list(F.when(F.col("scan"), F.col("page")))).alias("scan_pages"))
    first = boiler.select("doc", "norm").distinct().withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy("norm"))).filter(F.col("place") <= shown)
    lines = first.groupBy("doc").agg(F.array_sort(F.collect_list("norm")).alias("boilerplate"))
    return sums.join(lines, "doc", "left").select(
        "doc", "pages", F.col("pages").alias("checked"), "pages_with_text", F.round(F.col("pages_with_text") / F.col("pages"), 3).alias("coverage"),
        (F.col("pages_with_text") / F.col("pages") >= DIGITAL).alias("is_digital"), (F.col("pages_with_text") == 0).alias("is_scan_doc"),
        "scan_pages", F.coalesce("boilerplate", F.array().cast("array<string>")).alias("boilerplate"),
    )


def size_check(pages: DataFrame) -> DataFrame:
    """doc, pages, scan_pages, large, est_min and ranges of up to CHUNK pages, numbered from 1, in order of `page`."""
    chunk = F.floor((F.row_number().over(_by_page()) - 1) / CHUNK)
    parts = pages.withColumn("chunk", chunk).groupBy("doc", "chunk").agg(F.min("page").alias("lo"), F.max("page").alias("hi"), F.count("*").alias("n"), F.count_if("scan").alias("s"))
    label = F.when(F.col("n") > 1, F.concat_ws("-", (F.col("lo") + 1).cast("string"), (F.col("hi") + 1).cast("string"))).otherwise((F.col("lo") + 1).cast("string"))
    ranges = F.transform(F.array_sort(F.collect_list(F.struct("chunk", label.alias("label")))), lambda x: x["label"])
    sums = parts.groupBy("doc").agg(F.sum("n").alias("pages"), F.sum("s").alias("scan_pages"), F.array_join(ranges, ",").alias("ranges"))
    return sums.select("doc", "pages", "scan_pages", (F.col("scan_pages") > LARGE).alias("large"), F.greatest(F.lit(1), F.bround(F.col("scan_pages") * SECONDS / 60).cast("int")).alias("est_min"), "ranges")


def _by_page():
    return Window.partitionBy("doc").orderBy("page")
