"""Images in texts: placeholders, the questions they belong to, their sizes and grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

TAG = r'!\[[^\]\n]*\]\(([^)\n]+?)(?:\s+"[^"]*")?\)(?:\{[^}\n]*\})?'
HOLDER = r"\{\{IMG_([0-9]+)\}\}"
# Centimetres of a unit.
UNITS = {"pt": 2.54 / 72, "in": 2.54, "cm": 1.0, "mm": 0.1, "px": 2.54 / 96, "pc": 12 * 2.54 / 72}
LENGTH = r"(?i)^\s*(-?[0-9.]+)\s*(pt|in|cm|mm|px|pc|em|ex)?\s*$"


def with_placeholders(md: DataFrame, names: DataFrame) -> DataFrame:
    """doc, text, files: image tags become numbered placeholders if the image is saved (names: base, saved), else a blank.

    Texts are cut at tags; each tag's base name is looked up with and without its extension, numbers count the
    saved ones of a text, and the pieces are joined again in order.
    """
    cut = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), TAG, "\x01$1\x02"), "[\x01\x02]")
    pieces = md.select("doc", F.posexplode(cut).alias("pos", "piece")).withColumn("tag", F.col("pos") % 2 == 1)
    base = F.element_at(F.split(F.replace("piece", F.lit("\\"), F.lit("/")), "/"), -1)
    pieces = pieces.withColumn("base", F.when(F.col("tag"), base)).withColumn("stem", F.regexp_replace("base", r"\.[^.]*$", ""))
    by_base, by_stem = names.select("base", F.col("saved").alias("a")), names.select(F.col("base").alias("stem"), F.col("saved").alias("b"))
    found = pieces.join(by_base, "base", "left").join(by_stem, "stem", "left").withColumn("saved", F.coalesce("a", "b"))
    number = F.count("saved").over(Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    text = F.when(~F.col("tag"), F.col("piece")).when(F.col("saved").isNull(), " ").otherwise(F.concat(F.lit(" {{IMG_"), number.cast("string"), F.lit("}} ")))
    parts = found.withColumn("n", number).withColumn("out", text)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "out", "saved")))
    return parts.groupBy("doc").agg(ordered.alias("p")).select("doc", F.array_join(F.transform("p", lambda x: x["out"]), "").alias("text"), F.array_compact(F.transform("p", lambda x: x["saved"])).alias("files"))


def resolved(text: Column, names: Column) -> Column:
    """struct(text, files): a text without placeholders, and the files that names (number to file) gives for them."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(HOLDER), 1), lambda n: n.cast("int"))
    files = F.array_compact(F.transform(numbers, lambda n: F.try_element_at(names, n)))
    return F.struct(T.strip(F.regexp_replace(F.regexp_replace(text, HOLDER, " "), "[ \t]{2,}", " ")).alias("text"), files.alias("files"))


def to_questions(refs: DataFrame) -> DataFrame:
    """doc, image, question: each image (kind i) gets the last question (kind q) at or before it, or the first.

    The as-of join is a union in order of place with the last question carried on, so it is linear.
    """
    w = Window.partitionBy("doc").orderBy("at", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    rest = Window.partitionBy("doc").orderBy("at", F.desc("kind")).rowsBetween(0, Window.unboundedFollowing)
    question = F.when(F.col("kind") == "q", F.col("name"))
    return refs.withColumn("question", F.coalesce(F.last(question, True).over(w), F.first(question, True).over(rest))).filter("kind = 'i'").select("doc", F.col("name").alias("image"), "question")


def parsed_map(raw: Column, n: Column) -> Column:
    """map of image number to question number in a model's reply; other keys and numbers out of 1 to 999 are left out."""
    body = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)\{.*\}", 0)
    data = F.coalesce(F.from_json(body, "map<string,string>"), F.create_map().cast("map<string,string>"))
    entries = F.transform(F.map_entries(data), lambda e: F.struct(F.trim(e["key"]).try_cast("int").alias("k"), F.regexp_extract(e["value"], "[0-9]+", 0).try_cast("int").alias("v")))
    return F.map_from_entries(F.filter(entries, lambda e: e["k"].between(1, n) & e["v"].between(1, 999)))


def with_context(rows: DataFrame, key: str, order: str, chars: int = 160) -> DataFrame:
    """rows (text, label) that have text, with the last label so far and the end of the last three texts."""
    w = Window.partitionBy(key).orderBy(order)
    kept = rows.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    recent = F.array_join(F.collect_list("text").over(w.rowsBetween(-2, 0)), " ")
    return kept.withColumn("question", F.last("label", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("context", F.right(recent, F.lit(chars)))


def assigned(items: DataFrame, model: DataFrame) -> DataFrame:
    """items (i, local_question) with `question`: the model's where it gave one, else the local one."""
    return items.join(model, "i", "left").withColumn("question", F.coalesce("model_question", "local_question")).drop("model_question")


def grouped(items: DataFrame) -> DataFrame:
    """doc, question, n, files: images (doc, pos, file, question) by question, in order; null is a group of its own."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "file")))
    return items.groupBy("doc", "question").agg(F.count("*").alias("n"), F.transform(ordered, lambda x: x["file"]).alias("files"))


def emu_cm(c: Column) -> Column:
    return c.try_cast("bigint") / F.lit(360000)


def css_cm(c: Column) -> Column:
    """A CSS length in centimetres, points if it has no unit; null if it isn't positive or has an unknown unit."""
    value = F.regexp_extract(c, LENGTH, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(c, LENGTH, 2))
    factor = F.lit(None).cast("double")
    for name, cm in UNITS.items():
        factor = F.when(unit == name, F.lit(cm)).otherwise(factor)
    return F.when(value > 0, value * F.when(unit == "", F.lit(UNITS["pt"])).otherwise(factor))


def style_cm(style: Column, prop: str) -> Column:
    return css_cm(F.nullif(F.regexp_extract(F.coalesce(style, F.lit("")), rf"(?i)(?:^|;)\s*{prop}\s*:\s*([^;]*)", 1), F.lit("")))
