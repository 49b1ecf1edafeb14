"""Queries over exam lines: classification, options, the two parsers, tables and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exam as E
from ..functions import text as T
from ..operators import images as I
from ..operators import structure as P
from ..operators import tables as G
from .registry import Derived, Inline, query, table

RAW = [
    "PHẦN I. CÂU TRẮC NGHIỆM NHIỀU LỰA CHỌN", "Mỗi câu chọn một phương án.", "Câu 1. Một vật dao động điều hoà với biên độ 4 cm.", "A. 2 cm B. 4 cm C. 6 cm D. 8 cm",
    "Câu 2: Đơn vị của lực là gì", "được dùng trong hệ SI?", "A. N", "B. J", "C. .", "D) W", "| t | 1 | 2 |", "| x | 3 | 4 |", "hết bảng", "2) cm.", "3. Tính quãng đường vật đi được",
    "PHẦN II - CÂU TRẮC NGHIỆM ĐÚNG SAI", "Câu 1. Xét chuyển động.", "a) Vật đứng yên.", "b. Vật chuyển động.", "PHẦN III. TRẢ LỜI NGẮN", "Câu 1. Cho biết vận tốc A. 1 B. 2 là bao nhiêu", "Tự luận", "Câu 1.", "Tóm tắt lý thuyết cơ bản"]
#: The lines of all documents, dressed as what an exam paper's lines are.
LINES = Derived("lines", "documents", "pos long, line string", ["doc_id * 100000 + k", """CASE (doc_id + k) % 16
    WHEN 0 THEN concat('PHẦN ', k % 4 + 1, '. TRẮC NGHIỆM ', t) WHEN 1 THEN concat('Câu ', k + 1, '. ', t) WHEN 2 THEN concat('A. ', k, ' B. ', lang, ' C. ', source, ' D. ', t) WHEN 3 THEN concat('**A.** ', t, ' **B.** n')
    WHEN 4 THEN concat(k, ') ', t) WHEN 5 THEN concat('a) ', t) WHEN 6 THEN concat('A. x C. ', t) WHEN 7 THEN concat(k, '. ', lang) WHEN 8 THEN concat('Cho biết ', lang, ' A. ', k, ' B. ', n_chars) WHEN 9 THEN 'Tự luận'
    WHEN 10 THEN concat('PHẦN II - CÂU TRẮC NGHIỆM ĐÚNG SAI ', lang) WHEN 11 THEN concat('Câu ', k, ':') WHEN 12 THEN concat('(A) ', lang, ' (B) hai (C) ', k, ' (D) bốn') WHEN 13 THEN concat(k, ' m/s ', t) WHEN 14 THEN 'Tóm tắt lý thuyết' ELSE t END"""], by_line=True)  # fmt: skip

_when = "".join(f"WHEN regexp_matches(line, '(?i){w}') THEN '{n}' " for n, w in E.SECTION_WORDS)


@query(f"WITH {LINES.cte} SELECT pos, CASE {_when} END AS kind FROM lines")
def section_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LINES.df(spark, sf_dir).select("pos", E.section_type(F.col("line")).alias("kind"))


_question = r"(?i)^(?:c[aâ]u\s*)?([0-9]+)\s*[.):\s]\s*((?s).*)"
_strip = "regexp_replace({0}, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')"


@query(f"""WITH {LINES.cte}, m AS (SELECT pos, line, regexp_extract(line, '{_question}', 1) AS number, regexp_extract(line, '{_question}', 2) AS rest FROM lines),
    q AS (SELECT *, regexp_matches(line, '(?i)^c[aâ]u\\s*[0-9]+\\s*[.):\\s]')
        OR (regexp_matches(line, '^[0-9]+\\s*[.)]\\s*\\S') AND length(trim(ltrim(rest, '*_ '))) >= 12 AND NOT regexp_matches(ltrim(rest, '*_ '), '^\\p{{Ll}}')) AS is_question FROM m)
    SELECT pos, is_question, CASE WHEN is_question THEN try_cast(number AS INTEGER) END AS number, CASE WHEN is_question THEN {_strip.format("rest")} END AS text FROM q""")
def question_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("line")
    return LINES.df(spark, sf_dir).select("pos", E.is_question(c).alias("is_question"), E.question_number(c).alias("number"), E.question_text(c).alias("text"))


#: A line's marks and what is behind each, and whether the letters are two or more in a row.
_marks = f"""p AS (SELECT pos, line, regexp_extract_all(line, '{E.MARK}', 1) AS letters, string_split(regexp_replace(line, '{E.MARK}', chr(1), 'g'), chr(1)) AS parts FROM lines),
    o AS (SELECT pos, line, letters, parts[1] AS head, [letters[k] || '. ' || {_strip.format("parts[k + 1]")} FOR k IN range(1, len(letters) + 1)] AS options,
        len(letters) >= 2 AND coalesce(list_bool_and([ascii(letters[k + 1]) = ascii(letters[k]) + 1 FOR k IN range(1, len(letters))]), TRUE) AS in_a_row FROM p)"""


@query(f"WITH {LINES.cte}, {_marks} SELECT pos, CASE WHEN in_a_row THEN array_to_string(options, '|') ELSE line END AS options FROM o")
def option_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LINES.df(spark, sf_dir).select("pos", F.array_join(E.split_options(F.col("line")), "|").alias("options"))


@query(f"""WITH {LINES.cte}, {_marks}, f AS (SELECT *, in_a_row AND letters[1] = 'A' AND regexp_matches(head, '^$|[\\s]$') AS fits FROM o)
    SELECT pos, CASE WHEN fits THEN rtrim(head) ELSE line END AS text, CASE WHEN fits THEN array_to_string(options, '|') ELSE '' END AS options FROM f""")
def options_rescued(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = E.rescued(F.col("line"), F.array().cast("array<string>"))
    return LINES.df(spark, sf_dir).select("pos", saved["text"].alias("text"), F.array_join(saved["options"], "|").alias("options"))


LETTERS = Derived("letters", "documents", "i long, a array<string>", ["doc_id", "concat(chr(65 + CAST(doc_id % 3 AS INT)), '~', chr(65 + CAST((doc_id + n_chars) % 4 AS INT)), CASE WHEN n_chars % 3 = 0 THEN '~C~D' WHEN n_chars % 3 = 1 THEN '~C' ELSE '' END)"])


@query(f"WITH {LETTERS.cte} SELECT i, coalesce(list_bool_and([ascii(a[k + 1]) = ascii(a[k]) + 1 FOR k IN range(1, len(a))]), TRUE) AS ok FROM letters")
def consecutive_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LETTERS.df(spark, sf_dir).select("i", G.consecutive(F.col("a")).alias("ok"))


TEXTS = Derived("texts", "documents", "i long, t string", ["doc_id * 100000 + k", "CASE k % 7 WHEN 0 THEN ' . ' WHEN 1 THEN NULL WHEN 2 THEN concat('  ', t, ' ') WHEN 3 THEN '–_-' WHEN 4 THEN concat(t, '.') WHEN 5 THEN concat('.', lang) ELSE t END"], by_line=True)


@query(f"WITH {TEXTS.cte}, s AS (SELECT i, regexp_replace(coalesce(t, ''), '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g') AS t FROM texts) SELECT i, CASE WHEN regexp_matches(t, '^[\\s.:;,\\-–_]*$') THEN '' ELSE t END AS t FROM s")
def clean_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TEXTS.df(spark, sf_dir).select("i", E.clean_option(F.col("t")).alias("t"))


def items(spark: SparkSession) -> DataFrame:
    rows = [("d", i, x, ["p.png"] if i in (1, 20) else ["a.png", "b.png", "c.png", "d.png"] if i == 3 else [], None) for i, x in enumerate(RAW)]
    rows += [("t", 0, "Câu 7. Chọn hình", [], None), ("t", 1, "", [], [("A", "", ["1.png"]), ("B", ".", ["2.png"])]), ("n", 0, "chỉ có chữ", [], None), ("n", 1, "không có câu", ["z.png"], None)]
    return spark.createDataFrame(rows, P.ITEMS)


@query()
def doc_struct_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse(items(spark))


@query()
def doc_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parsed_documents(items(spark)).select("doc", "doc_type", F.to_json("sections").alias("sections"))


@query()
def documents_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parser over all documents, line by line."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.posexplode(T.lines(F.col("text"))).alias("pos", "text"))
    rows = lines.withColumn("images", F.array().cast("array<string>")).withColumn("option_cells", F.lit(None).cast("array<struct<letter:string,text:string,images:array<string>>>"))
    return P.parsed_documents(rows).select("doc", "doc_type", F.size("sections").alias("n_sections"), F.aggregate("sections", F.lit(0), lambda n, s: n + F.size(s["questions"])).alias("n_questions"))


#: Documents as exam papers: of five lines one is a question and the others its options.
PAPERS = r"""WITH p AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents), l AS (SELECT doc_id, unnest(range(len(parts))) AS i, parts FROM p),
    t AS (SELECT doc_id, i, trim(regexp_replace(parts[i + 1], '[^\p{L}]+', ' ', 'g')) AS t FROM l), q AS (SELECT doc_id, i // 5 AS k, 'Hỏi ' || t AS text FROM t WHERE i % 5 = 0),
    o AS (SELECT doc_id, i // 5 AS k, string_agg(chr(CAST(64 + i % 5 AS INTEGER)) || '. ý ' || t, '|' ORDER BY i) AS options FROM t WHERE i % 5 > 0 GROUP BY 1, 2)"""
_by_question = PAPERS + r"""
    SELECT CAST(doc_id AS VARCHAR) AS doc, CAST(k + 1 AS INTEGER) AS number, trim(text) AS text, coalesce(regexp_replace(options, ' (\||$)', '\1', 'g'), '') AS options FROM q LEFT JOIN o USING (doc_id, k)"""


def paper_lines(spark: SparkSession, sf_dir: str, bold: str = "") -> DataFrame:
    """doc, pos, text: the lines of the papers, with what is before and after a mark in `bold`."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    words, part, b = F.trim(F.regexp_replace("line", r"[^\p{L}]+", " ")), F.col("pos") % 5, F.lit(bold)
    question = F.concat(b, F.lit("Câu "), F.floor(F.col("pos") / 5 + 1).cast("string"), F.lit("."), b, F.lit(" Hỏi "))
    return lines.select("doc", "pos", F.concat(F.when(part == 0, question).otherwise(F.concat(b, F.chr(part + 64), F.lit("."), b, F.lit(" ý "))), words).alias("text"))


def paper_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.lit(None).cast("array<struct<letter:string,text:string,images:array<string>>>")
    return paper_lines(spark, sf_dir).withColumns({"images": F.array().cast("array<string>"), "option_cells": cells})


@query(_by_question)
def papers_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse(paper_items(spark, sf_dir)).select("doc", "number", "text", F.array_join("options", "|").alias("options"))


@query(_by_question)
def papers_from_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    md = paper_lines(spark, sf_dir, "**").groupBy("doc").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))
    return P.parse_markdown(md).select("doc", "number", "text", F.array_join("options", "|").alias("options"))


@query(PAPERS + """, n AS (SELECT doc_id, count(*) AS n_questions, string_agg(trim(text), '|' ORDER BY k) AS texts FROM q GROUP BY 1)
    SELECT CAST(doc_id AS VARCHAR) AS doc, 1 AS n_sections, CAST(n_questions AS INTEGER) AS n_questions, texts FROM n""")
def paper_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = F.flatten(F.transform("sections", lambda s: s["questions"]))
    tree = P.parsed_documents(paper_items(spark, sf_dir))
    return tree.select("doc", F.size("sections").alias("n_sections"), F.size(questions).alias("n_questions"), F.array_join(F.transform(questions, lambda q: q["text"]), "|").alias("texts"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc, 'Hỏi ' || doc_id || ' tiếp theo' AS text, 'A. m|B. n' AS options FROM documents")
def continued_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question that goes on in the next line, in each document, behind a line before the first question."""
    i = F.col("doc_id").cast("string")
    texts = F.array(F.lit("lời dẫn"), F.concat(F.lit("Câu 1. Hỏi "), i), F.lit("tiếp theo"), F.lit("A. m B. n"))
    cells = F.lit(None).cast("array<struct<letter:string,text:string,images:array<string>>>")
    rows = table(spark, sf_dir, "documents").select(i.alias("doc"), F.posexplode(texts).alias("pos", "text")).withColumns({"images": F.array().cast("array<string>"), "option_cells": cells})
    return P.parse(rows).select("doc", "text", F.array_join("options", "|").alias("options"))


MD = "\n".join(["# PHẦN I. TRẮC NGHIỆM", "**Câu 1.** Vật rơi", "tự do.", "> **A.** 1 s **B.** 2 s", "- **C.** 3 s", "D\\. 4 s", "![](x.png)", "2.  Hãy tìm gia tốc", "| A. 1 | B. 2 |", "|---|---|", "| C. 3 | D. 4 |",
    "## ĐÚNG SAI", "Câu 3: Xét các phát biểu", "a\\) đúng", "b) sai", "| t | 1 |", "| x | 2 |", "hết"])


@query()
def markdown_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse_markdown(spark.createDataFrame([("m", MD), ("e", "chữ"), ("n", None)], "doc string, text string"))


#: Tables in Markdown, with what a document has in their cells.
BLOCKS = Derived("blocks", "documents", "i long, lines array<string>", ["doc_id", """CASE doc_id % 7 WHEN 0 THEN concat('| A. ', lang, ' | B. ', n_chars, ' |~|---|:-:|~| D. 4 | C. ', coalesce(source, '-'), ' |') WHEN 1 THEN concat('| t | ', n_chars, ' |~| x | 2 |')
    WHEN 2 THEN concat('| Nội dung | Đ | S |~|---|---|---|~| a) ', lang, ' | | |~| b) sai | | |') WHEN 3 THEN concat('| a) ', n_chars, ' |~| b) n |~| ', lang, ' |') WHEN 4 THEN concat('| A. ', lang, ' | A. 2 |')
    WHEN 5 THEN concat('| B. ', lang, ' | C. ', n_chars, ' |') ELSE concat('| ', lang, ' |') END"""])  # fmt: skip
_cells = "[regexp_replace(c, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g') FOR c IN string_split(trim(trim(x), '|'), '|')]"


@query(f"WITH {BLOCKS.cte} SELECT i, array_to_string(flatten([{_cells} FOR x IN lines IF NOT regexp_matches(trim(trim(x), '|'), '^[ \\t:|\\-]+$')]), '/') AS cells FROM blocks")
def markdown_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BLOCKS.df(spark, sf_dir).select("i", F.array_join(G.block_cells(F.col("lines")), "/").alias("cells"))


@query(f"""WITH {BLOCKS.cte}, c AS (SELECT i, flatten([{_cells} FOR x IN lines IF NOT regexp_matches(trim(trim(x), '|'), '^[ \\t:|\\-]+$')]) AS cells FROM blocks), f AS (SELECT i, [x FOR x IN cells IF x <> ''] AS cells FROM c),
    l AS (SELECT i, cells, [regexp_extract(x, '^([A-D])[.]', 1) FOR x IN cells] AS letters FROM f)
    SELECT i, CASE WHEN len(cells) BETWEEN 2 AND 4 AND NOT list_contains(letters, '') AND len(list_distinct(letters)) = len(letters) AND ascii(list_sort(letters)[-1]) - ascii(list_sort(letters)[1]) = len(letters) - 1 THEN array_to_string(list_sort(cells), '/') END AS options FROM l""")
def option_tables_to_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BLOCKS.df(spark, sf_dir).select("i", F.array_join(G.option_lines(F.col("lines"), E.OPTION), "/").alias("options"))


_rows = f"[{_cells} FOR x IN lines IF NOT regexp_matches(replace({_cells}[1], ' ', ''), '^:?-{{2,}}:?$')]"


@query(f"""WITH {BLOCKS.cte}, r AS (SELECT i, {_rows} AS rows FROM blocks) SELECT i, len([r FOR r IN rows[1:2] IF (list_contains(r, 'Đ') OR list_contains(r, 'Đúng')) AND (list_contains(r, 'S') OR list_contains(r, 'Sai'))]) > 0
    OR len([r FOR r IN rows IF regexp_matches(r[1], '^[ \\t]*\\**[a-d][.)]')]) >= 2 AS is_ds FROM r""")
def true_false_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.filter(F.transform("lines", G.pipe_cells), lambda r: ~F.replace(F.get(r, F.lit(0)), F.lit(" ")).rlike("^:?-{2,}:?$"))
    return BLOCKS.df(spark, sf_dir).select("i", G.is_true_false_rows(rows).alias("is_ds"))


@query(f"WITH {BLOCKS.cte} SELECT i, array_to_string([c FOR c IN [{_cells}[1] FOR x IN lines] IF c <> '' AND NOT regexp_matches(replace(c, ' ', ''), '^:?-{{2,}}:?$') AND NOT regexp_matches(c, '(?i)^(Nội dung|Phát biểu|Nhận định|Phương án)[ \\t]*$')], '/') AS first_cells FROM blocks")
def true_false_to_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BLOCKS.df(spark, sf_dir).select("i", F.array_join(G.true_false_lines(F.col("lines")), "/").alias("first_cells"))


#: Grids of cells with a document's language and size in them, and pictures in some.
GRIDS = Derived("grids", "documents", "i long, n_rows int, n_cols int, texts array<string>, pics array<int>", [
    "doc_id", "CASE doc_id % 8 WHEN 5 THEN 3 WHEN 7 THEN 1 ELSE 2 END", "CASE doc_id % 8 WHEN 2 THEN 3 WHEN 5 THEN 1 WHEN 7 THEN 4 ELSE 2 END",
    """CASE doc_id % 8 WHEN 0 THEN concat('A. ', lang, '~B. 2~C. 3~D. ', n_chars) WHEN 1 THEN concat('A. ', n_chars, '~B. 2~~') WHEN 2 THEN concat('Nội dung~Đ~S~a) ', lang, '~~') WHEN 3 THEN concat('t~1~', lang, '~', n_chars) WHEN 4 THEN concat('t~', lang, '~x~2')
        WHEN 5 THEN concat('a) ', lang, '~b) n~k') WHEN 6 THEN concat('B. ', lang, '~A. 2~~') ELSE concat('A. 1~A. ', n_chars, '~B. 3~') END""",
    "CASE doc_id % 8 WHEN 1 THEN '0~0~1~1' WHEN 2 THEN '0~0~0~0~0~0' WHEN 4 THEN concat('0~0~0~', n_chars % 2) WHEN 5 THEN '0~0~0' WHEN 6 THEN concat('0~0~', n_chars % 2, '~0') ELSE '0~0~0~0' END"])
_one = "regexp_extract(t, '^\\**[ \\t]*\\(?([A-D])\\**[ \\t]*\\\\?[.):]', 1)"


def grid_cells() -> F.Column:
    return F.zip_with("texts", "pics", lambda t, p: F.struct(t.alias("text"), F.array_repeat(F.lit("x.png"), p).alias("images")))


@query(f"""WITH {GRIDS.cte}, a AS (SELECT *, [t FOR t IN texts IF t <> ''] AS wt, [{_one} FOR t IN texts IF t <> ''] AS letters, len([k FOR k IN range(1, len(texts) + 1) IF texts[k] <> '' OR pics[k] > 0]) AS filled,
        len([k FOR k IN range(1, len(texts) + 1) IF texts[k] = '' AND pics[k] > 0]) AS pic_only, len([p FOR p IN pics IF p > 0]) AS np, [texts[r * n_cols + 1:(r + 1) * n_cols] FOR r IN range(n_rows)] AS rows FROM grids)
    SELECT i, CASE WHEN n_rows <= 0 OR n_cols <= 0 OR len(texts) = 0 THEN 'plain'
        WHEN (n_rows, n_cols) IN ((2, 2), (1, 4), (4, 1), (1, 2), (2, 1)) AND filled BETWEEN 2 AND 4 AND len(letters) > 0 AND NOT list_contains(letters, '') AND len(list_distinct(letters)) = len(letters) AND (pic_only = 0 OR len(letters) >= 2) THEN 'option'
        WHEN len([r FOR r IN rows[1:2] IF (list_contains(r, 'Đ') OR list_contains(r, 'Đúng')) AND (list_contains(r, 'S') OR list_contains(r, 'Sai'))]) > 0 OR len([r FOR r IN rows IF regexp_matches(r[1], '^[ \\t]*\\**\\(?[a-d][.)]')]) >= 2 THEN 'ds'
        WHEN n_rows >= 2 AND n_cols >= 2 AND len(wt) >= 2 AND np = 0 THEN 'data' ELSE 'plain' END AS kind FROM a""")
def table_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GRIDS.df(spark, sf_dir).select("i", G.table_kind(grid_cells(), F.col("n_rows"), F.col("n_cols")).alias("kind"))


OPTION_GRIDS = Derived("og", "documents", "i long, texts array<string>, want string", [
    "doc_id", "CASE doc_id % 3 WHEN 0 THEN concat('B. ', lang, '~~A. ', n_chars, '~x') WHEN 1 THEN concat('C) ', lang, '~A) a') ELSE concat(lang, '~q~r~s~t') END",
    "CASE doc_id % 3 WHEN 0 THEN concat('A=', n_chars, ',B=', lang, ',C=,D=x') WHEN 1 THEN concat('A=a,C=', lang) ELSE concat('A=', lang, ',B=q,C=r,D=s,=t') END"])


@query(f"WITH {OPTION_GRIDS.cte} SELECT i, want AS cells FROM og")
def option_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.transform("texts", lambda t: F.struct(t.alias("text"), F.when(t == "", F.array(F.lit("x.png"))).otherwise(F.array().cast("array<string>")).alias("images")))
    return OPTION_GRIDS.df(spark, sf_dir).select("i", F.array_join(F.transform(G.option_cells(cells), lambda c: F.concat(c["letter"], F.lit("="), c["text"])), ",").alias("cells"))


FIGURE_GRIDS = Derived("fg", "documents", "i long, cells array<string>", ["doc_id", "CASE doc_id % 5 WHEN 0 THEN concat(doc_id, repeat('~', 11)) WHEN 1 THEN concat('O~x~', doc_id % 10) WHEN 2 THEN concat('a', lang, '~d') WHEN 3 THEN concat('abc', repeat(concat('~', lang), 11)) ELSE concat(n_chars % 100, '~ ~y') END"])


@query(f"WITH {FIGURE_GRIDS.cte} SELECT i, len(cells) > 0 AND ((len(cells) >= 12 AND len([c FOR c IN cells IF trim(c) <> '']) <= 0.25 * len(cells)) OR len([c FOR c IN cells IF length(regexp_replace(c, '[^A-Za-z0-9]', '', 'g')) >= 3]) = 0) AS figure FROM fg")
def figure_like_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FIGURE_GRIDS.df(spark, sf_dir).select("i", G.is_figure_grid(F.col("cells")).alias("figure"))


# --- images in texts -------------------------------------------------------------------------------------------

PIC_MD = "Câu 1. Hình ![a](media/image1.wmf){width=1} và ![b](media/none.png)\nCâu 2. Khác ![c](media/image2.png)"
NAMES = Inline("names", "base string, saved string", [("image1.wmf", "s1.png"), ("image2", "s2.png")])


@query()
def image_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.with_placeholders(spark.createDataFrame([("m", PIC_MD), ("n", None)], "doc string, text string"), NAMES.df(spark))


HOLDERS = Derived("holders", "documents", "i long, t string", ["doc_id", "CASE doc_id % 4 WHEN 0 THEN concat('a {{IMG_1}} ', lang, '  {{IMG_', doc_id % 12, '}}') WHEN 1 THEN concat('A. {{IMG_', n_chars % 4, '}} .') WHEN 2 THEN concat('none  ', lang) ELSE '{{IMG_9}}' END"])


@query(f"WITH {HOLDERS.cte} SELECT i, trim(regexp_replace(regexp_replace(t, '\\{{\\{{IMG_[0-9]+\\}}\\}}', ' ', 'g'), '[ \\t]{{2,}}', ' ', 'g')) AS text, array_to_string([x FOR x IN [CASE n WHEN '1' THEN 'p' WHEN '2' THEN 'q' WHEN '3' THEN 'r' END FOR n IN regexp_extract_all(t, '\\{{\\{{IMG_([0-9]+)\\}}\\}}', 1)] IF x IS NOT NULL], ',') AS files FROM holders")
def resolved_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for x in (1, "p", 2, "q", 3, "r")])
    got = I.resolved(F.col("t"), names)
    return HOLDERS.df(spark, sf_dir).select("i", got["text"].alias("text"), F.array_join(got["files"], ",").alias("files"))


#: A conversation's user turns as questions and the others as images, by their place.
REFS = Derived("refs", "conversations", "doc string, kind string, at int, name string", ["concat('', conv_id)", "CASE WHEN role = 'user' THEN 'q' ELSE 'i' END", "turn * 10", "concat('n', turn)"])


@query(f"WITH {REFS.cte} SELECT i.doc, i.name AS image, coalesce((SELECT arg_max(q.name, q.at) FROM refs q WHERE q.doc = i.doc AND q.kind = 'q' AND q.at <= i.at), (SELECT arg_min(q.name, q.at) FROM refs q WHERE q.doc = i.doc AND q.kind = 'q')) AS question FROM refs i WHERE i.kind = 'i'")
def images_to_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.to_questions(REFS.df(spark, sf_dir)).select("doc", "image", "question")


REPLIES = Inline("replies", "i int, raw string, n int", [(1, '{"1": 3, "2": "câu 12", "3": null, "9": 4}', 3), (2, '```json\n{"1": 5}\n```', 2), (3, "nothing", 2), (4, 'so: {"2": 1000, "1": 7} end', 2)])
WANT = Inline("want", "i int, k int, question int", [(1, 1, 3), (1, 2, 12), (2, 1, 5), (4, 1, 7)])


@query(f"WITH {WANT.cte} SELECT i, k, question FROM want")
def model_image_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return REPLIES.df(spark).select("i", F.explode(I.parsed_map(F.col("raw"), F.col("n"))).alias("k", "question"))


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN turn END AS q, text FROM conversations WHERE trim(coalesce(text, '')) <> '')
    SELECT conv_id, turn, last_value(q IGNORE NULLS) OVER w AS question, right(array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), ' '), 160) AS context FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def forward_fill_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("label", F.when(F.col("role") == "user", F.col("turn")))
    return I.with_context(c, "conv_id", "turn").select("conv_id", "turn", "question", "context")


@query("""SELECT c.conv_id, c.turn, coalesce(d.n_chars, c.turn) AS question FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id * 10 + c.turn""")
def assigned_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 10 + F.col("turn")).alias("i"), F.col("turn").alias("local_question"))
    return I.assigned(local, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), F.col("n_chars").alias("model_question"))).select("conv_id", "turn", "question")


SIZES = Derived("sizes", "documents", "i long, t string, want double", [
    "doc_id", "CASE doc_id % 9 WHEN 0 THEN concat(n_chars, 'pt') WHEN 1 THEN concat(n_chars, 'in') WHEN 2 THEN concat(' ', n_chars, '.5 cm ') WHEN 3 THEN concat(n_chars, 'mm') WHEN 4 THEN concat(n_chars, 'px') WHEN 5 THEN concat(n_chars, 'pc') WHEN 6 THEN concat(n_chars, 'em') WHEN 7 THEN concat('-', n_chars, 'cm') ELSE NULL END",
    "CASE doc_id % 9 WHEN 0 THEN n_chars * CAST(2.54 AS DOUBLE) / 72 WHEN 1 THEN n_chars * CAST(2.54 AS DOUBLE) WHEN 2 THEN n_chars + CAST(0.5 AS DOUBLE) WHEN 3 THEN n_chars / CAST(10 AS DOUBLE) WHEN 4 THEN n_chars * CAST(2.54 AS DOUBLE) / 96 WHEN 5 THEN n_chars * CAST(2.54 AS DOUBLE) / 6 ELSE NULL END"])


@query(f"WITH {SIZES.cte} SELECT i, round(want, 4) AS cm FROM sizes")
def css_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SIZES.df(spark, sf_dir).select("i", F.round(I.css_cm(F.col("t")), 4).alias("cm"))


STYLES = Inline("styles", "i int, t string, emu string", [(1, "width:72pt;height: 36pt", "360000"), (2, "HEIGHT:1in", "x"), (3, "color:red", None)])


@query(f"WITH {STYLES.cte} SELECT i, CASE i WHEN 1 THEN 2.54 END AS w, CASE i WHEN 1 THEN 1.27 WHEN 2 THEN 2.54 END AS h, CAST(try_cast(emu AS BIGINT) / 360000 AS DOUBLE) AS cm FROM styles")
def shape_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STYLES.df(spark).select("i", I.style_cm(F.col("t"), "width").alias("w"), I.style_cm(F.col("t"), "height").alias("h"), I.emu_cm(F.col("emu")).alias("cm"))


@query("""SELECT doc_id % 7 AS question, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS files, row_number() OVER (ORDER BY CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 7 END NULLS LAST) AS place FROM documents GROUP BY doc_id % 7""")
def images_by_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.lit("d").alias("doc"), F.nullif(F.col("doc_id") % 7, F.lit(0)).alias("question"), F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("file"))
    groups = I.grouped(d)
    place = F.row_number().over(Window.partitionBy("doc").orderBy(F.col("question").asc_nulls_last()))
    return groups.select(F.coalesce("question", F.lit(0)).alias("question"), "n", F.array_join("files", ",").alias("files"), place.alias("place"))
