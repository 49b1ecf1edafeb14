"""What models reply, as rows: a page's Markdown and figures, a document's questions; and tables put in place of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exam as E
from ..functions import text as T
from . import geometry as G
from . import reconcile as R
from . import tables as B

PAGE = "struct<markdown:string,figures:array<struct<id:string,bbox:array<double>,box_2d:array<double>,caption:string,anchor_text:string>>>"


def page_replies(replies: DataFrame) -> DataFrame:
    """doc, page, markdown, figures of replies (doc, page, raw, width, height, y_off, y_span): figures with their box in percent
    of the whole page and whether they are placed. A placeholder of a figure whose box is sound and larger than 30 pixels
    becomes an image tag, any other a note with the caption."""
    parsed = replies.withColumn("reply", F.from_json(R.salvaged(F.col("raw")), PAGE))
    md = F.coalesce("reply.markdown", T.strip_fence(F.col("raw")))
    figures = F.coalesce("reply.figures", F.array().cast("array<struct<id:string,bbox:array<double>,box_2d:array<double>,caption:string,anchor_text:string>>"))

    def entry(f: Column) -> Column:
        b = F.coalesce(G.thousandth_box(f["box_2d"]), F.when(f["box_2d"].isNull(), G.percent_box(f["bbox"])))
        large = ((b["x1"] - b["x0"]) / 100 * F.col("width") > 30) & ((b["y1"] - b["y0"]) / 100 * F.col("height") > 30)
        holder = F.concat(F.lit("{{FIGURE_"), f["id"], F.lit("}}"))
        whole = F.struct(b["x0"].alias("x0"), (F.col("y_off") * 100 + b["y0"] * F.col("y_span")).alias("y0"), b["x1"].alias("x1"), (F.col("y_off") * 100 + b["y1"] * F.col("y_span")).alias("y1"))
        return F.struct(
            f["id"].alias("id"), F.when(b.isNotNull(), whole).alias("box"), F.coalesce(large & F.contains(F.col("md"), holder), F.lit(False)).alias("placed"),
            F.trim(F.coalesce(f["caption"], F.lit(""))).alias("caption"), F.trim(F.coalesce(f["anchor_text"], F.lit(""))).alias("anchor_text"),
        )

    rows = parsed.withColumn("md", md).withColumn("figures", F.transform(figures, entry))

    def put(text: Column, f: Column) -> Column:
        holder = F.concat(F.lit("{{FIGURE_"), f["id"], F.lit("}}"))
        tag = F.concat(F.lit("\n\n!["), F.when(f["caption"] == "", F.concat(F.lit("Hình "), f["id"])).otherwise(f["caption"]), F.lit("](figures/p"), (F.col("page") + 1).cast("string"), F.lit("_fig"), f["id"], F.lit(".png)\n\n"))
        note = F.when(f["caption"] == "", "\n\n*[Hình trong trang gốc]*\n\n").otherwise(F.concat(F.lit("\n\n*[Hình: "), f["caption"], F.lit("]*\n\n")))
        return F.replace(text, holder, F.when(f["placed"], tag).otherwise(note))

    placed = F.aggregate("figures", F.coalesce("md", F.lit("")), put)
    return rows.select("doc", "page", T.strip(F.regexp_replace(placed, r"\{\{FIGURE_[0-9]+\}\}", "\n\n*[Hình trong trang gốc]*\n\n")).alias("markdown"), "figures")


def tables_as_images(lines: DataFrame, refs: DataFrame) -> DataFrame:
    """lines (doc, pos, line) with the k-th table of a document replaced by the k-th ref (doc, k from 1, file; no file: keep as
    text). True-false tables become lines, empty grids go, and tables beyond the refs stay."""
    is_row = F.col("line").rlike(r"^\s*\|.*\|\s*$")
    change = ~(is_row & F.lag(is_row, 1, False).over(Window.partitionBy("doc").orderBy("pos")))
    rows = lines.withColumn("row", is_row).withColumn("block", F.sum(change.cast("int")).over(Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    blocks = rows.groupBy("doc", "block", "row").agg(F.min("pos").alias("at"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("lines"))
    cells = B.block_cells(F.col("lines"))
    table = F.col("row") & (F.size("lines") >= 2)
    empty = table & (F.size(cells) >= 12) & (F.size(F.filter(cells, lambda c: c != "")) <= 0.25 * F.size(cells))
    blocks = blocks.withColumn("empty", empty).withColumn("counts", table & ~empty)
    numbered = blocks.withColumn("k", F.sum(F.col("counts").cast("int")).over(Window.partitionBy("doc").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    met = numbered.join(refs.withColumn("known", F.lit(True)), ["doc", "k"], "left")
    kept = F.filter(F.transform("lines", B.pipe_cells), lambda r: ~F.replace(F.get(r, F.lit(0)), F.lit(" ")).rlike("^:?-{2,}:?$"))
    as_text = (F.col("known").isNotNull() & F.col("file").isNull()) | B.is_true_false_rows(kept)
    spaced = F.concat(F.array(F.lit("")), F.flatten(F.transform(B.true_false_lines(F.col("lines")), lambda x: F.array(x, F.lit("")))))
    image = F.array(F.lit(""), F.concat(F.lit("![Bảng]("), F.col("file"), F.lit(")")), F.lit(""))
    out = F.when(F.col("empty"), F.array().cast("array<string>")).when(~F.col("counts"), F.col("lines")).when(as_text, spaced).when(F.col("known").isNotNull(), image).otherwise(F.col("lines"))
    parts = met.select("doc", "at", out.alias("lines"))
    return parts.select("doc", "at", F.posexplode("lines").alias("i", "line")).select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("at", "i")).alias("pos"), "line")


def model_questions(questions: DataFrame, pool: DataFrame) -> DataFrame:
    """Questions of a model's reply with images of the plain reading: doc, sec, q, number, text, options, images, option_images.

    questions: doc, sec, q, type, number, text, options, options_are_figures; pool: doc, ord, type, number, q, files. An image is
    looked up by type and number, else by a number that is unique in the pool, else by type and place. As many
    images as options, where the model says the options are figures, go one to each. Images of tables go where the
    text has the table. What no question took goes to the document's last.
    """
    saved = E.rescued(T.strip(F.coalesce("text", F.lit(""))), F.col("options"))
    rows = questions.withColumn("saved", saved).withColumn("text", F.col("saved.text")).withColumn("options", F.col("saved.options")).drop("saved").filter("text <> '' OR size(options) > 0")
    last = lambda keys, p, name: p.groupBy(*keys).agg(F.max_by("files", "ord").alias(name))
    unique = pool.join(pool.groupBy("doc", "number").count().filter("count = 1").drop("count"), ["doc", "number"], "left_semi")
    met = rows.join(last(["doc", "type", "number"], pool, "a"), ["doc", "type", "number"], "left").join(last(["doc", "number"], unique, "b"), ["doc", "number"], "left").join(last(["doc", "type", "q"], pool, "c"), ["doc", "type", "q"], "left")
    none = F.array().cast("array<string>")
    met = met.withColumn("images", F.coalesce("a", "b", "c", none))
    one_each = F.coalesce("options_are_figures", F.lit(False)) & (F.size("images") > 0) & (F.size("images") == F.size("options"))
    met = met.withColumn("option_images", F.when(one_each, F.transform("images", lambda x: F.array(x))).otherwise(F.transform("options", lambda _: none))).withColumn("images", F.when(one_each, none).otherwise(F.col("images")))
    has_table = F.col("text").rlike(r"(?m)^\s*\|.*\|\s*$")
    met = met.withColumn("taken", F.concat("images", F.flatten("option_images"))).withColumn("images", F.when(has_table, F.filter("images", lambda x: ~x.rlike(r"_tbl[0-9]+\.png$"))).otherwise(F.col("images")))
    used = met.select("doc", F.explode("taken").alias("file")).distinct()
    left = pool.select("doc", "ord", F.posexplode("files").alias("k", "file")).groupBy("doc", "file").agg(F.min(F.struct("ord", "k")).alias("at")).join(used, ["doc", "file"], "left_anti")
    rest = left.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "file"))), lambda x: x["file"]).alias("rest"))
    is_last = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("sec"), F.desc("q"))) == 1
    out = met.withColumn("is_last", is_last).join(rest, "doc", "left").withColumn("images", F.when(F.col("is_last"), F.concat("images", F.coalesce("rest", none))).otherwise(F.col("images")))
    return out.select("doc", "sec", "q", "type", "number", "text", "options", "images", "option_images")
