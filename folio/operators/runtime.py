"""The conversion runtime as relations: job states, the page cache, solving rounds and clean-up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINAL = ("done", "error")


def latest_status(events: DataFrame) -> DataFrame:
    """job, file, status, message: the last event (seq) of each file of each job."""
    return events.groupBy("job", "file").agg(F.max_by(F.struct("status", "message"), "seq").alias("s")).select("job", "file", "s.status", "s.message")


def finished_jobs(status: DataFrame) -> DataFrame:
    """job, n_files, n_done, all_done."""
    final = F.col("status").isin(*FINAL)
    return status.groupBy("job").agg(F.count("*").alias("n_files"), F.count_if(final).alias("n_done"), F.bool_and(final).alias("all_done"))


def cache_key(content: Column, *parts: Column) -> Column:
    """20 hex digits that change with the content, the model, the prompts or the version."""
    return F.substring(F.sha1(F.concat(content, *[F.coalesce(p, F.lit("")) for p in parts])), 1, 20)


def with_cache(pages: DataFrame, cache: DataFrame, read: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Pages (key, page) read from the cache (key, page, text) or by read(), which gives key, page, text, ok; and the cache with
    what was read well. Failed pages are never kept."""
    known = pages.join(cache, ["key", "page"])
    new = read(pages.join(cache, ["key", "page"], "left_anti"))
    grown = cache.unionByName(new.filter("ok").select("key", "page", "text"))
    return known.select("key", "page", "text", F.lit(True).alias("ok")).unionByName(new), grown


def evict(entries: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Entries (key, used_at) used within `days`."""
    return entries.filter(F.col("used_at") >= now - F.make_dt_interval(F.lit(days)))


def expired(files: DataFrame, now: Column, days: Column) -> DataFrame:
    """Files (path, modified) older than `days` days."""
    return files.filter(F.col("modified") < now - F.make_dt_interval(days))


def converted(pages: DataFrame, readers: list[str]) -> DataFrame:
    """doc, markdown, failed: page texts joined in order with page marks, each page's the first of its readings that isn't
    empty; pages without one are listed and get a note."""
    text = F.coalesce(*[F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit("")) for c in readers])
    note = F.concat(F.lit("> ⚠️ **[Trang "), (F.col("page") + 1).cast("string"), F.lit("]**"))
    part = F.concat(F.lit("<!-- p2w:page="), (F.col("page") + 1).cast("string"), F.lit(" -->\n"), F.coalesce(text, note))
    ordered = F.array_sort(F.collect_list(F.struct("page", part.alias("part"))))
    failed = F.array_sort(F.collect_list(F.when(text.isNull(), F.col("page") + 1)))
    return pages.groupBy("doc").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n\n").alias("markdown"), failed.alias("failed"))


def solved(questions: DataFrame, text: DataFrame, vision: DataFrame) -> DataFrame:
    """questions (doc, question_id) with `solution`: that from the picture, else from the text, else a placeholder."""
    out = questions.join(text.withColumnRenamed("solution", "t"), ["doc", "question_id"], "left").join(vision.withColumnRenamed("solution", "v"), ["doc", "question_id"], "left")
    return out.withColumn("solution", F.coalesce("v", "t", F.lit("(chưa có lời giải)"))).drop("t", "v")


def prompts(questions: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """doc, prompt: questions (doc, gnum, label, text, options, sub_items) with global numbers; `only` (doc, gnum) limits what is
    printed and not how it is numbered. A section's label stands before its first question."""
    from pyspark.sql import Window

    rows = questions if only is None else questions.join(only, ["doc", "gnum"], "left_semi")
    new = ~F.col("label").eqNullSafe(F.lag("label").over(Window.partitionBy("doc").orderBy("gnum")))
    head = F.when(new & (F.coalesce("label", F.lit("")) != ""), F.concat(F.lit("\n== "), F.col("label"), F.lit(" ==\n"))).otherwise("")
    options = F.when(F.size("options") > 0, F.concat(F.lit("\n  "), F.array_join("options", "  "))).otherwise("")
    subs = F.when(F.size("sub_items") > 0, F.concat(F.lit("\n  "), F.array_join("sub_items", "\n  "))).otherwise("")
    block = F.concat(head, F.lit("\n[CÂU "), F.col("gnum").cast("string"), F.lit("]\n"), F.coalesce("text", F.lit("")), options, subs)
    parts = rows.withColumn("block", block).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("gnum", "block"))).alias("p"))
    return parts.select("doc", F.array_join(F.transform("p", lambda x: x["block"]), "\n").alias("prompt"))
