"""Lines to sections, questions, options and sub-items, with window functions instead of a line loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import exam as E
from ..functions import text as T
from . import documents as D

ITEMS = "doc string, pos int, text string, images array<string>, option_cells array<struct<letter:string,text:string,images:array<string>>>"


def _texts(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def classified(items: DataFrame) -> DataFrame:
    """items (ITEMS) with what each line is by itself: table, header, question or other; blank lines with images stay."""
    line = T.strip(F.coalesce("text", F.lit("")))
    rows = items.withColumn("line", line).withColumn("cells", F.coalesce("option_cells", F.array().cast("array<struct<letter:string,text:string,images:array<string>>>"))).withColumn("images", _texts("images"))
    kind = E.section_type(F.col("line"))
    rows = rows.withColumn("is_table", F.size("cells") > 0).withColumn("kind", F.when(~F.col("is_table") & (F.length("line") < E.HEADER_MAX), kind))
    rows = rows.withColumn("is_header", F.col("kind").isNotNull()).withColumn("is_question", ~F.col("is_table") & ~F.col("is_header") & E.is_question(F.col("line")))
    return rows.filter("is_table OR line <> '' OR size(images) > 0")


def placed(rows: DataFrame) -> DataFrame:
    """classified() rows with their section (0: before any header), its type, and the question in it (0: none open).

    A table of options opens a question if none is open. A question without text, options and images is dropped and
    does not reach over a header.
    """
    by_doc = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sec", F.sum(F.col("is_header").cast("int")).over(by_doc)).withColumn("sec_type", F.coalesce(F.last("kind", True).over(by_doc), F.lit(S.OTHER)))
    by_sec = Window.partitionBy("doc", "sec").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("doc", "sec").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max((F.col("is_question") | F.col("is_table")).cast("int")).over(before), F.lit(0)) == 1
    rows = rows.withColumn("opens", F.col("is_question") | (F.col("is_table") & ~seen))
    return rows.withColumn("q", F.sum(F.col("opens").cast("int")).over(by_sec))


def roles(rows: DataFrame) -> DataFrame:
    """placed() rows with `role`: header, table, question, image, option, sub, more or intro."""
    options = E.option_texts(F.col("line"))
    is_sub = F.col("line").rlike(E.SUB_ITEM) & F.col("sec_type").isin(S.TRUE_FALSE, S.OTHER)
    role = (
        F.when(F.col("is_header"), "header")
        .when(F.col("is_table"), "table")
        .when(F.col("is_question"), "question")
        .when(F.col("line") == "", "image")
        .when(F.col("q") == 0, "intro")
        .when(options.isNotNull(), "option")
        .when(is_sub, "sub")
        .otherwise("more")
    )
    return rows.withColumn("role", role).withColumn("parts", F.when(F.col("role") == "option", options))


def image_targets(rows: DataFrame) -> DataFrame:
    """doc, sec, q, images: where each image goes. Images before a question wait for the next question of the document,
    whatever its section; those after the last go to the last; each question's are in order."""
    later = Window.partitionBy("doc").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    all_rows = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = F.when(F.col("is_question"), F.struct("sec", "q"))
    own_list = (F.col("role") == "table") | ((F.col("role") == "option") & ((F.size("parts") == F.size("images")) | (F.size("parts") == 1)))
    target = F.when((F.col("q") > 0) & ~F.col("is_header"), F.struct("sec", "q")).otherwise(F.coalesce(F.last(here, True).over(later), F.last(F.when(F.col("q") > 0, F.struct("sec", "q")), True).over(all_rows)))
    loose = rows.withColumn("target", target).filter((F.size("images") > 0) & ~own_list & F.col("target").isNotNull())
    ordered = F.array_sort(F.collect_list(F.struct("pos", "images")))
    return loose.groupBy("doc", F.col("target.sec").alias("sec"), F.col("target.q").alias("q")).agg(F.flatten(F.transform(ordered, lambda x: x["images"])).alias("images"))


def parse(items: DataFrame) -> DataFrame:
    """doc, sec, q, type, label, number, text, options, sub_items, images, option_images: the questions of each document."""
    rows = roles(placed(classified(items)))
    cell = F.transform("cells", lambda c: F.struct(F.regexp_replace(F.concat(c["letter"], F.lit(". "), E.clean_option(c["text"])), r"\s+$", "").alias("text"), F.coalesce(c["images"], F.array().cast("array<string>")).alias("images")))
    one_each = F.size("parts") == F.size("images")
    part = F.transform("parts", lambda p, i: F.struct(p.alias("text"), F.when(one_each, F.slice("images", i + 1, 1)).when(F.size("parts") == 1, F.col("images")).otherwise(F.array().cast("array<string>")).alias("images")))
    step = F.struct(
        "pos",
        F.when(F.col("role") == "question", E.question_text(F.col("line"))).when(F.col("role") == "more", F.col("line")).alias("text"),
        F.when(F.col("role") == "table", cell).when(F.col("role") == "option", part).alias("options"),
        F.when(F.col("role") == "sub", F.concat(F.regexp_extract("line", E.SUB_ITEM, 1), F.lit(". "), T.strip(F.regexp_extract("line", E.SUB_ITEM, 2)))).alias("sub"),
        F.when(F.col("role") == "question", E.question_number(F.col("line"))).alias("number"),
    )
    labels = Window.partitionBy("doc", "sec").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("label", F.coalesce(F.first(F.when(F.col("is_header"), F.col("line")), True).over(labels), F.lit("")))
    grouped = rows.filter("q > 0 AND role <> 'header'").groupBy("doc", "sec", "q").agg(F.first("sec_type").alias("type"), F.first("label").alias("label"), F.array_sort(F.collect_list(step)).alias("steps"))
    # A table row of a text goes on a new line, and so does what follows one; other lines are joined by a blank.
    joined = F.aggregate(
        "steps", F.lit(""),
        lambda acc, s: F.when(s["text"].isNull(), acc).when(acc == "", s["text"]).otherwise(F.concat(acc, F.when(s["text"].startswith("|") | acc.rlike(r"\|\s*$"), "\n").otherwise(" "), s["text"])),
    )
    options = F.flatten(F.transform(F.filter("steps", lambda s: s["options"].isNotNull()), lambda s: s["options"]))
    subs = F.filter(F.transform("steps", lambda s: s["sub"]), lambda x: x.isNotNull())
    number = F.coalesce(F.get(F.filter(F.transform("steps", lambda s: s["number"]), lambda x: x.isNotNull()), F.lit(0)), F.lit(1))
    out = grouped.select("doc", "sec", "q", "type", "label", number.alias("number"), joined.alias("text"), options.alias("opts"), subs.alias("sub_items"))
    out = out.withColumn("saved", E.rescued(F.col("text"), F.transform("opts", lambda o: o["text"]))).join(image_targets(rows), ["doc", "sec", "q"], "left")
    lists = F.when(F.size("saved.options") == F.size("opts"), F.transform("opts", lambda o: o["images"])).otherwise(F.transform("saved.options", lambda _: F.array().cast("array<string>")))
    out = out.select("doc", "sec", "q", "type", "label", "number", F.col("saved.text").alias("text"), F.col("saved.options").alias("options"), "sub_items", _texts("images").alias("images"), lists.alias("option_images"))
    return out.filter("text <> '' OR size(options) > 0 OR size(images) > 0 OR exists(option_images, x -> size(x) > 0)")


def intros(items: DataFrame) -> DataFrame:
    """doc, sec, type, label, intro: the sections, with the lines before their first question joined by blanks."""
    rows = roles(placed(classified(items)))
    line = F.struct("pos", F.when(F.col("role") == "intro", F.col("line")).alias("line"), F.when(F.col("is_header"), F.col("line")).alias("label"))
    grouped = rows.groupBy("doc", "sec").agg(F.first("sec_type").alias("type"), F.array_sort(F.collect_list(line)).alias("steps"), F.max("q").alias("n"))
    return grouped.select(
        "doc", "sec", "type", F.coalesce(F.get(F.filter(F.transform("steps", lambda s: s["label"]), lambda x: x.isNotNull()), F.lit(0)), F.lit("")).alias("label"),
        F.array_join(F.transform("steps", lambda s: s["line"]), " ").alias("intro"), "n",
    )


def parsed_documents(items: DataFrame) -> DataFrame:
    """doc, doc_type, sections: the tree. Sections without questions and intro are dropped; a document without any gets
    one that holds its first 50 items."""
    q = parse(items)
    listed = F.array_sort(F.collect_list(F.struct("q", "number", "text", "options", "sub_items", "images", "option_images")))
    by_sec = q.groupBy("doc", "sec").agg(listed.alias("questions"))
    empty = F.array().cast(q.groupBy("doc").agg(listed.alias("x")).schema["x"].dataType)
    secs = intros(items).drop("n").join(by_sec, ["doc", "sec"], "left").withColumn("questions", F.coalesce("questions", empty)).filter("size(questions) > 0 OR intro <> ''")
    secs = secs.withColumn("label", F.when((F.col("sec") == 0) & (F.col("label") == ""), "").otherwise(F.col("label")))
    trees = secs.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("sec", "type", "label", "intro", "questions"))).alias("sections"))
    first = Window.partitionBy("doc").orderBy("pos")
    head = items.withColumn("r", F.row_number().over(first)).filter("r <= 50").groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n").alias("head"))
    blank = F.array(F.struct(F.lit(0).cast("bigint").alias("sec"), F.lit(S.OTHER).alias("type"), F.lit("Nội dung").alias("label"), F.col("head").alias("intro"), empty.alias("questions")))
    out = head.join(trees, "doc", "left").withColumn("sections", F.coalesce("sections", blank))
    return out.select("doc", D.doc_type(F.transform("sections", lambda s: s["type"])).alias("doc_type"), "sections")


# --- Markdown ----------------------------------------------------------------------------------------------------

MD_HEADER = r"(?iu)ph[àầa]n\s*[ivx1-9]+|tr[áắa]c\s*nghi[eệ]m|[đd][úu]ng.*sai|t[ựu]\s*lu[ậa]n|tr[ảa]\s*l[ờo]i\s*ng[ắa]n"
MD_QUESTION = r"(?iu)^(?:\*{1,2})?c[âa]u\s*([0-9]+)[\s.):]*\*{0,2}\s*(.*)"
MD_NUMBERED = r"^([0-9]{1,3})\.[ \t]+(\S.*)"
MD_OPTION = r"^(?:\s*[-*+]\s+)?" + E.MARK + r"\s*(.*)"
MD_SUB = r"^(?:\s*[-*]\s*)?([a-d])\s*\\?[.)]\s*(.*)"


def markdown_lines(md: DataFrame) -> DataFrame:
    """doc, pos, line, clean: the lines of Markdown texts (doc, text), option tables turned to lines of options, quotes and
    escapes removed, image lines and blank ones left out. A block of pipe lines is looked at as one."""
    from .tables import option_lines

    raw = md.select("doc", F.posexplode(T.lines(F.col("text"))).alias("pos", "raw")).withColumn("pipe", T.strip(F.col("raw")).startswith("|"))
    change = (F.col("pipe") != F.lag("pipe", 1, False).over(Window.partitionBy("doc").orderBy("pos"))) | ~F.col("pipe")
    raw = raw.withColumn("block", F.sum(change.cast("int")).over(Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    blocks = raw.groupBy("doc", "block", "pipe").agg(F.min("pos").alias("at"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]).alias("lines"))
    lines = F.when(F.col("pipe"), F.coalesce(option_lines(F.col("lines"), E.OPTION), F.col("lines"))).otherwise(F.col("lines"))
    out = blocks.select("doc", "at", F.posexplode(lines).alias("k", "raw")).withColumn("pos", F.row_number().over(Window.partitionBy("doc").orderBy("at", "k")))
    line = F.regexp_replace(T.strip(F.regexp_replace("raw", r"^(?:\s*>)+\s?", "")), r"\\([\[\]()*_#>~.])", "$1")
    out = out.select("doc", "pos", line.alias("line")).filter((F.col("line") != "") & ~F.col("line").rlike(r"^!\[.*?\]\(.*?\)"))
    return out.withColumn("clean", T.strip(F.regexp_replace("line", r"^\*{1,2}|\*{1,2}$", "")))


def parse_markdown(md: DataFrame) -> DataFrame:
    """doc, sec, q, type, number, text, options, sub_items of Markdown texts (doc, text)."""
    rows = markdown_lines(md)
    bare = T.strip(F.regexp_replace("clean", r"^#+\s*", ""))
    asked = F.col("clean").rlike(MD_QUESTION) | F.col("line").rlike(MD_NUMBERED)
    rows = rows.withColumn("is_header", bare.rlike(MD_HEADER) & (F.length(bare) < E.HEADER_MAX) & ~asked).withColumn("label", F.when(F.col("is_header"), bare))
    rows = rows.withColumn("opens", ~F.col("is_header") & asked).withColumn("kind", F.when(F.col("is_header"), F.coalesce(E.section_type(bare), F.lit(S.OTHER))))
    by_doc = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sec", F.sum(F.col("is_header").cast("int")).over(by_doc)).withColumn("type", F.coalesce(F.last("kind", True).over(by_doc), F.lit(S.OTHER)))
    by_sec = Window.partitionBy("doc", "sec").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("q", F.sum(F.col("opens").cast("int")).over(by_sec)).filter("q > 0")
    is_option = ~F.col("opens") & F.col("line").rlike(MD_OPTION)
    earlier = Window.partitionBy("doc", "sec", "q").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    has_options = F.coalesce(F.max(is_option.cast("int")).over(earlier), F.lit(0)) == 1
    rows = rows.withColumn("is_option", is_option).withColumn("is_sub", ~F.col("opens") & ~is_option & F.col("line").rlike(MD_SUB) & ~has_options)
    body = F.regexp_replace("line", r"^\s*[-*+]\s+", "")
    many = E.split_options(body)
    one = F.array(F.concat(F.regexp_extract("line", MD_OPTION, 1), F.lit(". "), T.strip(F.regexp_extract("line", MD_OPTION, 2))))
    named = F.col("clean").rlike(MD_QUESTION)
    step = F.struct(
        "pos",
        F.when(F.col("opens"), T.strip(F.when(named, F.regexp_extract("clean", MD_QUESTION, 2)).otherwise(F.regexp_extract("line", MD_NUMBERED, 2)))).when(~F.col("is_option") & ~F.col("is_sub"), F.col("clean")).alias("text"),
        F.when(F.col("is_option"), F.when(F.size(many) >= 2, many).otherwise(one)).alias("options"),
        F.when(F.col("is_sub"), F.concat(F.regexp_extract("line", MD_SUB, 1), F.lit(") "), T.strip(F.regexp_extract("line", MD_SUB, 2)))).alias("sub"),
        F.when(F.col("opens"), F.when(named, F.regexp_extract("clean", MD_QUESTION, 1)).otherwise(F.regexp_extract("line", MD_NUMBERED, 1)).try_cast("int")).alias("number"),
    )
    grouped = rows.groupBy("doc", "sec", "q").agg(F.first("type").alias("type"), F.array_sort(F.collect_list(step)).alias("steps"))
    joined = F.aggregate("steps", F.lit(""), lambda acc, s: F.when(s["text"].isNull(), acc).when(acc == "", s["text"]).otherwise(F.concat(acc, F.when(s["text"].startswith("|") | acc.endswith("|"), "\n").otherwise(" "), s["text"])))
    options = F.flatten(F.transform(F.filter("steps", lambda s: s["options"].isNotNull()), lambda s: s["options"]))
    saved = E.rescued(F.col("text"), F.col("options"))
    out = grouped.select("doc", "sec", "q", "type", F.get("steps", F.lit(0))["number"].alias("number"), joined.alias("text"), options.alias("options"), F.filter(F.transform("steps", lambda s: s["sub"]), lambda x: x.isNotNull()).alias("sub_items"))
    return out.withColumn("saved", saved).select("doc", "sec", "q", "type", "number", F.col("saved.text").alias("text"), F.col("saved.options").alias("options"), "sub_items")
