"""The document tree: parsing, defaults, counting and flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S


def parse(json: Column) -> Column:
    return F.from_json(json, S.DOCUMENT)


def pad_option_images(option_images: Column, options: Column) -> Column:
    """As many lists of images as there are options."""
    n = F.coalesce(F.size(options), F.lit(0))
    empty = F.array().cast(f"array<{S.IMAGE}>")
    padded = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.coalesce(F.get(option_images, i - 1), empty))
    return F.slice(padded, 1, F.greatest(n, F.lit(0)))


def has_images(images: Column, option_images: Column) -> Column:
    return (F.coalesce(F.size(images), F.lit(0)) > 0) | F.coalesce(F.exists(option_images, lambda x: F.size(x) > 0), F.lit(False))


def count_questions(doc: Column) -> Column:
    return F.aggregate(F.coalesce(doc["sections"], F.array().cast(f"array<{S.SECTION}>")), F.lit(0), lambda n, s: n + F.greatest(F.coalesce(F.size(s["questions"]), F.lit(0)), F.lit(0)))


def doc_type(types: Column) -> Column:
    """A document's type from its sections' types."""
    return F.when(F.array_contains(types, S.MULTIPLE_CHOICE) | F.array_contains(types, S.TRUE_FALSE), S.EXAM).when(F.array_contains(types, S.THEORY), S.WORKSHEET).otherwise(S.OTHER_DOCUMENT)


def questions(documents: DataFrame) -> DataFrame:
    """id, sec_ord, q_ord, section type, label and theory flag, and the question, in order; ids that are missing are made
    from the place."""
    sections = documents.select("id", F.posexplode("doc.sections").alias("sec_ord", "s"))
    out = sections.select("id", "sec_ord", F.col("s.type").alias("type"), F.col("s.label").alias("label"), F.coalesce("s.is_theory", F.lit(False)).alias("is_theory"), F.posexplode("s.questions").alias("q_ord", "q"))
    made = F.substring(F.sha2(F.concat_ws("/", F.col("id").cast("string"), F.col("sec_ord").cast("string"), F.col("q_ord").cast("string")), 256), 1, 8)
    return out.withColumn("question_id", F.coalesce("q.id", made))


def global_numbers(rows: DataFrame) -> DataFrame:
    """questions() with `gnum`, the number over all sections but theory; filter after this, as others keep their numbers."""
    return rows.filter(~F.col("is_theory")).withColumn("gnum", F.row_number().over(Window.partitionBy("id").orderBy("sec_ord", "q_ord")))


def answer_letter(correct: Column, solution: Column) -> Column:
    """The right option: the first of A to D in the key, else the letter that the solution chooses; null if neither."""
    key = F.regexp_extract(F.upper(F.coalesce(correct, F.lit(""))), "[A-D]", 0)
    said = F.regexp_extract(F.coalesce(solution, F.lit("")), r"(?:Ch[oọ]n|[Đđ]áp[ \t]*án|→)[^A-Da-d\n]{0,10}\b([A-D])\b", 1)
    return F.when(key != "", key).when(said != "", said)


def true_statements(solution: Column) -> Column:
    """The letters of statements that a solution calls true."""
    found = F.regexp_extract_all(F.coalesce(solution, F.lit("")), F.lit(r"\b([a-d])\)[ \t]*\**[ \t]*(?:Đúng|đúng)"), 1)
    return F.array_sort(F.array_distinct(found))


def answer_table(rows: DataFrame) -> DataFrame:
    """id, stt, caption, summary (80 characters), answer: the key or the solution's first 60 characters, numbered in order."""
    text = F.coalesce("q.text", F.lit(""))
    answer = F.coalesce(F.nullif(F.col("q.correct_answer"), F.lit("")), F.substring(F.coalesce("q.ai_solution", F.lit("")), 1, 60))
    return rows.select(
        "id", F.row_number().over(Window.partitionBy("id").orderBy("sec_ord", "q_ord")).alias("stt"), F.concat(F.lit("Câu "), F.col("q.number").cast("string")).alias("caption"),
        F.concat(F.substring(text, 1, 80), F.when(F.length(text) > 80, "...").otherwise("")).alias("summary"), answer.alias("answer"),
    )


def image_indexes(rows: DataFrame) -> DataFrame:
    """For questions with images: their (type, number) key, whether the number is unique in the document, and ordinal in
    the section. Numbers are counted over all questions, with images or without."""
    counts = rows.groupBy("id", F.col("q.number").alias("number")).agg(F.count("*").alias("n"))
    pictured = rows.filter(has_images(F.col("q.images"), F.col("q.option_images"))).withColumn("number", F.col("q.number"))
    return pictured.join(counts, ["id", "number"]).select("id", "sec_ord", "q_ord", "type", "number", (F.col("n") == 1).alias("unique_number"), F.col("q.images").alias("images"), F.col("q.option_images").alias("option_images"))


def attach_images(target: DataFrame, source: DataFrame) -> DataFrame:
    """target questions with images of source: by type and number, else by a number that is unique there, else by type and
    ordinal. Of several candidates for a key the last in order counts."""
    last = lambda keys, rows: rows.groupBy(*keys).agg(F.max_by("images", F.struct("sec_ord", "q_ord")).alias("found"))
    by_key = last(["id", "type", "number"], source).withColumnRenamed("found", "by_key")
    by_number = last(["id", "number"], source.filter("unique_number")).withColumnRenamed("found", "by_number")
    by_order = last(["id", "type", "q_ord"], source).withColumnRenamed("found", "by_order")
    out = target.withColumn("number", F.col("q.number")).join(by_key, ["id", "type", "number"], "left").join(by_number, ["id", "number"], "left").join(by_order, ["id", "type", "q_ord"], "left")
    return out.withColumn("attached", F.coalesce("by_key", "by_number", "by_order", F.array().cast(f"array<{S.IMAGE}>"))).drop("by_key", "by_number", "by_order")


def export_blocks(documents: DataFrame, show_solutions: bool = True) -> DataFrame:
    """doc, pos, kind, text, cells, right: the blocks that a document (doc: its name; tree: the document) is written as.

    The title, each section's label and introduction, and each question with its number, its options, its statements and its
    solution; a line of a text is a block of its own. `right` tells the options and statements that are right, where solutions
    are shown. All is made within the row, so blocks keep their order without a shuffle.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    block = lambda kind, said, right=None: F.struct(F.lit(kind).alias("kind"), said.alias("text"), (F.lit(False) if right is None else F.coalesce(right, F.lit(False))).alias("right"))
    filled = lambda c: F.filter(F.split(text(c), "\n"), lambda l: F.trim(l) != "")
    some = lambda on, blocks: F.when(on, blocks).otherwise(F.slice(blocks, 1, 0))
    letter = lambda c: F.regexp_extract(c, r"^\s*\*{0,2}([A-Da-d])[.)]", 1)

    def asked(q: Column) -> Column:
        shown = F.lit(show_solutions) & F.coalesce(q["show_solution"], F.lit(True)) & ((text(q["ai_solution"]) != "") | (text(q["correct_answer"]) != ""))
        one, several = answer_letter(q["correct_answer"], q["ai_solution"]), true_statements(q["ai_solution"])
        lines, told = filled(q["text"]), filled(q["ai_solution"])
        first = F.concat(F.lit("Câu "), F.coalesce(q["number"].cast("string"), F.lit("")), F.lit(". "), F.coalesce(F.get(lines, F.lit(0)), F.lit("")))
        rest = lambda ls: F.slice(ls, 2, F.greatest(F.size(ls) - 1, F.lit(0)))
        options = F.coalesce(q["options"], F.array().cast("array<string>"))
        subs = F.coalesce(q["sub_items"], F.array().cast("array<string>"))
        solution = F.transform(told, lambda l, i: block("solution", F.when(i == 0, F.concat(F.lit("Lời giải: "), l)).otherwise(l)))
        return F.concat(
            F.array(block("question", first)), F.transform(rest(lines), lambda l: block("para", l)),
            F.transform(options, lambda o: block("option", text(o), shown & (letter(text(o)) == one))),
            F.transform(subs, lambda o: block("sub", text(o), shown & F.array_contains(several, letter(text(o))))),
            some(shown, solution),
        )

    def section(s: Column) -> Column:
        label = F.array(block("heading", text(s["label"])))
        intro = F.transform(filled(s["intro"]), lambda l: block("para", l))
        return F.concat(some(text(s["label"]) != "", label), intro, F.flatten(F.transform(F.coalesce(s["questions"], F.array().cast(f"array<{S.QUESTION}>")), asked)))

    sections = F.coalesce("tree.sections", F.array().cast(f"array<{S.SECTION}>"))
    whole = F.concat(F.array(block("title", text(F.col("tree.title")))), F.flatten(F.transform(sections, section)))
    rows = documents.select("doc", F.posexplode(whole).alias("pos", "b"))
    return rows.select("doc", F.col("pos").cast("long").alias("pos"), "b.kind", "b.text", F.lit(None).cast("array<array<string>>").alias("cells"), "b.right")
