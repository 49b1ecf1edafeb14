"""Queries over several readings of the same pages, and over lines that figures are anchored to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import anchors as A
from ..operators import reconcile as R
from .lines import STRIP
from .registry import Derived, Inline, query, table

Q = "struct<number:string,text:string,options:array<string>,sub_items:array<string>>"
SECTIONS = [
    ("d", 1, "trac_nghiem_lua_chon", "PHẦN I", "mở đầu", [("1", "a", [], []), ("2", "ngắn", [], [])]),
    ("d", 2, "trac_nghiem_lua_chon", "PHẦN I - TRẮC NGHIỆM", "", [("2", "câu dài hơn", ["A. x"], []), ("3", "c", [], [])]),
    ("d", 3, None, "", "", [("4", "d", [], [])]),
    ("d", 4, "dung_sai", "PHẦN II", "", [("1", "e", [], [])]),
    ("d", 5, "dung_sai", "PHẦN III", "x", [("1", "f", [], ["a. m"])]),
    ("e", 1, "tu_luan", None, None, None),
]


def sections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SECTIONS, f"doc string, ord int, type string, label string, intro string, questions array<{Q}>")


@query()
def sections_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.merge_sections(sections(spark), "last").withColumn("mode", F.lit("last")).unionByName(R.merge_sections(sections(spark), "any").withColumn("mode", F.lit("any")))
    return out.unionByName(R.merge_sections(sections(spark)).withColumn("mode", F.lit("none"))).select("mode", "doc", "sec", "type", "label", "intro", F.array_join(F.transform("questions", lambda q: F.concat(q["number"], F.lit("="), q["text"])), "|").alias("questions"))


LABELS = Derived("labels_", "documents", "i long, label string", ["doc_id", "CASE doc_id % 6 WHEN 0 THEN concat('PHẦN I - Câu trắc nghiệm ', lang) WHEN 1 THEN concat('Phần ', doc_id % 10, '. Đúng sai') WHEN 2 THEN concat('phan iii ', lang) WHEN 3 THEN NULL WHEN 4 THEN concat('Tự luận ', n_chars) ELSE 'PHẦN IV' END"])


@query(f"WITH {LABELS.cte} SELECT i, regexp_replace(lower(coalesce(label, '')), '[^0-9a-zà-ỹ]+', '', 'g') AS norm, lower(regexp_extract(coalesce(label, ''), '(?i)ph[àầa]n[ \\t]*([ivx]+|[0-9]+)\\b', 1)) AS part FROM labels_")
def label_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LABELS.df(spark, sf_dir).select("i", T.norm_label(F.col("label")).alias("norm"), T.part_id(F.col("label")).alias("part"))


HAVE = "SELECT source AS doc, CASE doc_id % 2 WHEN 0 THEN 'dung_sai' ELSE 'tu_luan' END AS type, doc_id AS number FROM documents WHERE doc_id % 5 <> 3"
OTHER = "SELECT source AS doc, CASE WHEN doc_id % 7 = 0 THEN 'khac' WHEN doc_id % 2 = 0 THEN 'dung_sai' ELSE 'tu_luan' END AS type, doc_id AS number, text FROM documents"


@query(f"""WITH h AS ({HAVE}), o AS ({OTHER}), l AS (SELECT o.* FROM o WHERE length(trim(coalesce(text, ''))) >= 15 AND NOT EXISTS (SELECT 1 FROM h WHERE h.doc = o.doc AND h.number = o.number AND (o.type = 'khac' OR h.type = o.type)))
    SELECT doc, type, number, (SELECT max(number) FROM h WHERE h.doc = l.doc AND h.type = l.type AND h.number < l.number) AS after, (SELECT min(number) FROM h WHERE h.doc = l.doc AND h.type = l.type AND h.number > l.number) AS before FROM l""")
def fill_missing_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    kind = F.when(i % 2 == 0, "dung_sai").otherwise("tu_luan")
    have = d.filter("doc_id % 5 <> 3").select(F.col("source").alias("doc"), kind.alias("type"), i.alias("number"))
    other = d.select(F.col("source").alias("doc"), F.when(i % 7 == 0, "khac").otherwise(kind).alias("type"), i.alias("number"), "text")
    return R.missing_questions(have, other).select("doc", "type", "number", "after", "before")


@query("SELECT source, string_agg(DISTINCT CAST(doc_id % 9 AS VARCHAR), ',' ORDER BY CAST(doc_id % 9 AS VARCHAR)) AS numbers FROM documents GROUP BY 1")
def section_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set((F.col("doc_id") % 9).cast("string"))), ",").alias("numbers"))


LENGTHS = Inline("lengths", "i int, text string, options array<string>, sub_items array<string>, number string", [(1, "abc", ["A. x", "B. yy"], [], "12"), (2, None, None, ["a. z"], "x"), (3, "", [], None, None), (4, "ab", ["é"], ["ü", "v"], " 7")])


@query(f"WITH {LENGTHS.cte} SELECT i, CAST(length(coalesce(text, '')) + coalesce(list_sum([length(x) FOR x IN options]), 0) + coalesce(list_sum([length(x) FOR x IN sub_items]), 0) AS INTEGER) AS n, try_cast(trim(number) AS INTEGER) AS number FROM lengths")
def question_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LENGTHS.df(spark).select("i", R.question_length(F.struct("text", "options", "sub_items")).alias("n"), F.trim("number").try_cast("int").alias("number"))


@query("""WITH a AS (SELECT source, doc_id % 10 AS number, length(text) AS n, doc_id FROM documents) SELECT source, number, arg_max(doc_id, (n, -doc_id)) AS kept FROM a GROUP BY 1, 2""".replace("arg_max(doc_id, (n, -doc_id))", "first(doc_id ORDER BY n DESC, doc_id)"))
def question_merge_longer_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 10).alias("number"), "doc_id", F.length("text").alias("n"))
    return d.groupBy("source", "number").agg(F.max_by("doc_id", F.struct("n", -F.col("doc_id"))).alias("kept"))


@query("SELECT doc_id, k AS kind FROM documents, (VALUES ('full'), ('halves')) v(k) WHERE k = CASE doc_id % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'halves' ELSE 'none' END")
def chosen_page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.lit("d").alias("doc"), F.col("doc_id").alias("page"))
    boxes = d.withColumn("kind", F.explode(F.array(F.lit("full"), F.lit("halves"))))
    keep = d.withColumn("kind", F.when(F.col("page") % 3 == 0, "full").when(F.col("page") % 3 == 1, "halves").otherwise("none"))
    return R.chosen_boxes(boxes, keep).select(F.col("page").alias("doc_id"), "kind")


@query(f"""SELECT doc_id, md5(chr(10) || chr(10) || '> ⚠️ **[Trang ' || (doc_id + 1) || ']** Không đọc được chữ (' || source || '). Ảnh gốc của trang ở dưới — hãy chuyển lại riêng trang này.' || chr(10) || chr(10)
    || CASE WHEN {STRIP.format("text")} = '' THEN '' ELSE {STRIP.format("text")} || chr(10) END) AS note FROM documents""")
def page_failure_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(R.failure_note(F.col("doc_id"), F.col("source"), F.col("text"))).alias("note"))


TOP = "\n".join(["**Câu 7.** Con lắc lò xo gồm vật nhỏ khối lượng 200 g.", "Lấy gần đúng π² = 10.", "**A.** 0,5 s", "## III. Sóng dừng trên dây", "* Sóng dừng là sóng có nút và bụng cố định trong không gian.", "* n = 2", "* Điều kiện: chiều dài dây bằng số nguyên lần nửa bước sóng."])
BOTTOM = "\n".join(["## III. Sóng dừng trên dây", "* Sóng dừng là sóng có các nút và bụng cố định trong không gian.", "* n = 2", "* Điều kiện: chiều dài dây bằng số nguyên lần nửa bước sóng.", "* Hai nút liên tiếp cách nhau nửa bước sóng.", "**Câu 8.** Một sợi dây đàn hồi dài 1,2 m có hai đầu cố định.", "**A.** 0,5 s", "**B.** 0,8 s"])


@query()
def overlap_fuzzy_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.drop_overlap(spark.createDataFrame([("a", TOP, BOTTOM), ("b", "Câu 3. Trang này nói về mạch điện xoay chiều.", BOTTOM), ("c", None, "x")], "doc string, top string, bottom string"))


REPLY = "[CÂU 1] lời giải một\n**[Câu 2]**: hai\n[câu 1]\nmột mới [CÂU 9] lạc [CÂU 3]  "
NUMBERS = Inline("numbers", "doc string, number string, question_id string", [("d", "1", "q1"), ("d", "2", "q2"), ("d", "3", "q3")])


@query("SELECT * FROM (VALUES ('d', 'q1', 'một mới'), ('d', 'q2', 'hai')) t(doc, question_id, solution)")
def parsed_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.solutions(spark.createDataFrame([("d", REPLY)], "doc string, text string"), NUMBERS.df(spark))


@query("SELECT * FROM (VALUES ('d', 'q1', 'một mới'), ('d', 'q2', 'hai'), ('d', 'q3', 'bù')) t(doc, question_id, solution)")
def filled_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ask = lambda lost, k: lost.select("doc", F.concat(F.lit("[CÂU 1] không [CÂU "), F.col("number"), F.lit("] bù")).alias("text"))
    return R.fill_missing(NUMBERS.df(spark), spark.createDataFrame([("d", REPLY)], "doc string, text string"), ask)


@query("SELECT conv_id, turn FROM conversations u WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant')")
def unanswered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    answers = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return c.filter("role = 'user'").select("conv_id", "turn").join(answers, ["conv_id", "turn"], "left_anti")


BROKEN = ['{"a": "x"}', '```json\n{"t": "$\\frac{1}{2}$"}\n```', 'Đây: {"t": "\\nu và \\alpha"} hết', '{"a": "\\"q\\" \\\\ok"}', "không có", '{"a": ', None, '{"n": [1, {"b": null}]}']


@query()
def salvaged_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(BROKEN)), "i int, raw string").select("i", R.salvaged(F.col("raw")).alias("json"))


# --- anchors -----------------------------------------------------------------------------------------------------

PAGE = [
    "<!-- p2w:page=3 -->", "**Câu 16.** Đặt một khung dây dẫn hình chữ nhật.", "Lực từ tác dụng lên cạnh", "*[Hình trong trang gốc]*", "**A.** AB ngược hướng", "**B.** BC cùng hướng", "**C.** CD cùng hướng", "**D.** DA ngược hướng", "",
    "**Câu 17.** Hình vẽ nào dưới đây?", "", "**A.** Hình 1", "<!-- p2w:page=5 -->", "Lý thuyết dòng 1.", "", "Lý thuyết dòng 2.", "**Câu 16.** Lặp lại"]
MD = Inline("md", "doc string, pos int, line string", [("p", i, x) for i, x in enumerate(PAGE)])


@query(f"""WITH {MD.cte}, m AS (SELECT a.doc, a.pos, a.line, (SELECT min(b.pos) FROM md b WHERE b.pos > a.pos AND (trim(b.line) = '' OR regexp_matches(b.line, '(?i)^\\s*(\\*\\*)?\\s*(Câu\\s*[0-9]|Bài\\s*[0-9]|PHẦN|Phần\\s|[A-D][.)]|[a-d][.)]|\\||!\\[|#|-{{3,}})'))) AS p,
    (SELECT min(b.pos) FROM md b WHERE b.pos > a.pos AND (regexp_matches(b.line, '^\\s*(\\*\\*)?\\s*([A-D]|[a-d])\\s*(\\*\\*)?\\s*[.)]') OR regexp_matches(b.line, '(?i)^\\s*(\\*\\*)?\\s*(Câu|Bài|Ví\\s*dụ|Minh\\s*họa)\\s*[0-9]+') OR trim(b.line) = '---' OR starts_with(trim(b.line), '<!--'))) AS s FROM md a)
    SELECT pos, coalesce(p, {len(PAGE)}) AS para_end, coalesce(s, {len(PAGE)}) AS stem_end FROM m""")
def block_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.block_ends(MD.df(spark)).select("pos", "para_end", "stem_end")


@query(f"WITH {MD.cte}, m AS (SELECT CAST(regexp_extract(line, 'page=([0-9]+)', 1) AS INTEGER) AS page, pos + 1 AS lo, lead(pos) OVER (ORDER BY pos) AS hi FROM md WHERE regexp_matches(line, '^\\s*<!--\\s*p2w:page=[0-9]+\\s*-->\\s*$')), w AS (SELECT unnest(range(1, 8))::INTEGER AS p) SELECT p AS page, (SELECT arg_max(lo, page) FROM m WHERE m.page <= p) AS lo, (SELECT arg_max(coalesce(hi, {len(PAGE)}), page) FROM m WHERE m.page <= p) AS hi FROM w")
def page_line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.range(1, 8).select(F.lit("p").alias("doc"), F.col("id").cast("int").alias("page"))
    return A.range_of(asked, A.page_ranges(MD.df(spark))).select("page", "lo", "hi")


WANTED = Inline("wanted", "id int, key string, number string, lo int, hi int, cur int", [(1, "hình", "16", 0, 17, 0), (2, "hình", "16", 0, 17, 5), (3, "không", "17", 0, 17, 12), (4, "lý thuyết", "16", 13, 17, 14), (5, "cd", "99", 0, 9, 7)])


@query(f"""WITH {MD.cte}, {WANTED.cte}, f AS (SELECT id, pos, (pos - least(greatest(cur, lo), hi) + (hi - lo)) % (hi - lo) AS far, contains(lower(line), key) AS k, regexp_extract(line, '(?i)^\\s*(?:\\*\\*)?\\s*(?:Câu|Bài)\\s*([0-9]+)', 1) = number AS q FROM wanted, md WHERE pos >= lo AND pos < hi)
    SELECT w.id, (SELECT arg_min(pos, far) FROM f WHERE f.id = w.id AND k) AS by_key, (SELECT arg_min(pos, far) FROM f WHERE f.id = w.id AND q) AS by_number FROM wanted w""")
def found_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = WANTED.df(spark).withColumn("doc", F.lit("p")).withColumn("keys", F.array("key")).withColumn("cursor", F.col("cur"))
    lines = MD.df(spark).withColumn("norm", F.lower("line"))
    by_key = A.find_lines(w, lines).select("id", F.col("found").alias("by_key"))
    return by_key.join(A.find_questions(w, lines).select("id", F.col("found").alias("by_number")), "id")


@query("SELECT * FROM (VALUES (1, 3, 4), (2, -1, 17)) t(id, note, at_height)".replace("-1", "NULL"))
def heights_and_leftovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = spark.createDataFrame([("p", 1, 1, 12, 0.35, 4), ("p", 2, 13, 17, 0.9, 15)], "doc string, id int, lo int, hi int, part double, at int")
    lines = MD.df(spark).withColumn("used", F.lit(False))
    height = A.by_height(w, lines).select("id", F.col("found").alias("at_height"))
    return height.join(A.leftovers(w, lines).select("id", F.col("found").alias("note")), "id")


@query()
def anchor_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    return lines.select("doc_id", "pos", A.anchor_keys(F.col("line")).alias("keys"))


@query("SELECT * FROM (VALUES ('p', 1, 4, 'anchor'), ('p', 2, 11, 'question'), ('p', 3, 16, 'height'), ('p', 4, 4, 'height')) AS t(doc, fig, line, how)")
def placed_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = spark.createDataFrame([("p", 1, 3, "Lực từ tác dụng lên cạnh", None, 0.1), ("p", 2, 3, None, "17", 0.9), ("p", 3, 5, "x", None, 0.5), ("p", 4, 3, None, None, 0.35)], "doc string, fig int, page int, anchor string, question string, part double")
    return A.place_figures(figures, MD.df(spark))


@query("SELECT doc_id, md5('a ' || coalesce(text, '')) AS h FROM documents")
def tool_images_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("a ![x](<d_images/imageFile3.png>)"), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.strip_tool_images(body)).alias("h"))


#: Documents as pages of an exam: page marks, questions, options and blank lines among a text's own lines.
SHEETS = Derived("sheet", "documents", "doc string, pos int, line string", ["concat('', doc_id)", "k", """CASE (doc_id + k) % 9 WHEN 0 THEN concat('<!-- p2w:page=', k + 1, ' -->') WHEN 1 THEN concat('**Câu ', k % 4 + 1, '.** ', t) WHEN 4 THEN concat('A. ', t) WHEN 6 THEN '' ELSE t END"""], by_line=True)
#: Five figures of each document; anchors are beginnings of its lines or of none.
SHEET_FIGURES = Derived("figure", "documents", "doc string, fig int, page int, anchor string, question string, part double", [
    "concat('', doc_id)", "i", "(i * 7 + doc_id) % 20", "CASE (i + doc_id) % 3 WHEN 0 THEN substr(split_part(coalesce(text, ''), chr(10), i + 1), 1, 60) WHEN 1 THEN substr(split_part(coalesce(text, ''), chr(10), 1), 10, 25) ELSE 'x' END",
    "CASE (i + doc_id) % 4 WHEN 1 THEN concat('', 1 + i % 4) ELSE NULL END", "(i * 37 % 100) / CAST(100 AS DOUBLE)"], times=5)
_plain = r"trim(regexp_replace(regexp_replace(replace(lower(nfc_normalize({0})), 'ß', 'ss'), '[^\p{{L}}\p{{N}}\s]+', ' ', 'g'), '\s+', ' ', 'g'))"
_bare = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_block = r"regexp_matches({0}, '(?i)^\s*(\*\*)?\s*(Câu\s*[0-9]|Bài\s*[0-9]|PHẦN|Phần\s|[A-D][.)]|[a-d][.)]|\||!\[|#|-{{3,}})')"
_asks = r"regexp_matches({0}, '(?i)^\s*(\*\*)?\s*(Câu|Bài|Ví\s*dụ|Minh\s*họa)\s*[0-9]+')"

_PLACED = rf"""WITH RECURSIVE {SHEETS.cte}, {SHEET_FIGURES.cte},
    b AS (SELECT *, {_bare.format("line")} AS bare, {_plain.format("line")} AS norm, {_block.format("line")} AS block, {_asks.format("line")} AS asks, regexp_extract(line, '(?i)^\s*(?:\*\*)?\s*(?:Câu|Bài)\s*([0-9]+)', 1) AS number FROM sheet),
    l AS (SELECT *, bare = '---' OR starts_with(bare, '<!--') AS rule, lag(bare, 1, '') OVER w AS prev, count(*) OVER (PARTITION BY doc) AS n FROM b WINDOW w AS (PARTITION BY doc ORDER BY pos)),
    e AS (SELECT *, coalesce(min(pos) FILTER (bare = '' OR block) OVER w, n) AS para_end, coalesce(min(pos) FILTER (asks OR rule OR regexp_matches(line, '^\s*(\*\*)?\s*([A-D]|[a-d])\s*(\*\*)?\s*[.)]')) OVER w, n) AS stem_end
        FROM l WINDOW w AS (PARTITION BY doc ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    m AS (SELECT doc, CAST(regexp_extract(line, 'page=([0-9]+)', 1) AS INTEGER) AS page, pos + 1 AS lo, lead(pos, 1, n) OVER (PARTITION BY doc ORDER BY pos) AS hi FROM e WHERE regexp_matches(line, '^\s*<!--\s*p2w:page=[0-9]+\s*-->\s*$')),
    f AS (SELECT g.*, row_number() OVER (PARTITION BY doc ORDER BY fig) AS turn, coalesce((SELECT max(lo) FROM m WHERE m.doc = g.doc AND m.page <= g.page), 0) AS lo,
        coalesce((SELECT max_by(hi, lo) FROM m WHERE m.doc = g.doc AND m.page <= g.page), (SELECT max(n) FROM e WHERE e.doc = g.doc)) AS hi FROM figure g),
    k0 AS (SELECT *, regexp_extract_all(anchor, '\p{{L}}+(?:\s+\p{{L}}+)+') AS runs FROM f),
    k1 AS (SELECT *, CASE WHEN len(runs) = 0 THEN '' ELSE {_plain.format("list_reduce(runs, lambda a, c: CASE WHEN length(c) > length(a) THEN c ELSE a END)")} END AS run, {_plain.format("anchor")} AS whole FROM k0),
    k2 AS (SELECT *, CASE WHEN length(run) >= 12 THEN run ELSE whole END AS key FROM k1),
    k3 AS (SELECT *, regexp_replace(substr(key, 1, 30), ' [^ ]*$', '') AS k30, regexp_replace(substr(key, 1, 18), ' [^ ]*$', '') AS k18 FROM k2),
    tries AS (SELECT doc, fig, lo, hi, 0 AS rank, key FROM k3 WHERE length(key) >= 12 UNION ALL SELECT doc, fig, lo, hi, 1, k30 FROM k3 WHERE length(key) > 30 AND length(k30) >= 12
        UNION ALL SELECT doc, fig, lo, hi, 2, k18 FROM k3 WHERE length(key) > 18 AND length(k18) >= 12 AND k18 <> k30),
    hits AS (SELECT doc, fig, t.rank, pos, least(para_end, t.hi) AS place FROM tries t JOIN e USING (doc) WHERE pos >= t.lo AND pos < t.hi AND contains(norm, key)
        UNION ALL SELECT doc, fig, 9, pos, least(stem_end, f.hi) FROM f JOIN e USING (doc) WHERE pos >= f.lo AND pos < f.hi AND e.number = f.question),
    best AS (SELECT doc, fig, min(rank) AS rank FROM hits GROUP BY 1, 2), near AS (SELECT hits.* FROM hits JOIN best USING (doc, fig, rank)),
    opens AS (SELECT doc, fig, pos, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY doc, fig) AS blocks, least(para_end, f.hi) AS behind FROM f JOIN e USING (doc)
        WHERE pos >= f.lo AND pos < f.hi AND bare <> '' AND NOT rule AND (pos = f.lo OR prev = '' OR prev = '---' OR starts_with(prev, '<!--') OR block) WINDOW w AS (PARTITION BY doc, fig ORDER BY pos)),
    high AS (SELECT f.doc, f.fig, f.lo, f.hi, CASE WHEN any_value(blocks) IS NULL THEN f.lo ELSE coalesce(max(o.pos) FILTER (k = round_even(part * blocks, 0)), max(behind) FILTER (k = blocks - 1)) END AS at, any_value(blocks) AS blocks
        FROM f LEFT JOIN opens o ON o.doc = f.doc AND o.fig = f.fig WHERE NOT EXISTS (SELECT 1 FROM best WHERE best.doc = f.doc AND best.fig = f.fig) GROUP BY 1, 2, 3, 4),
    drawn AS (SELECT h.doc, h.fig, coalesce(CASE WHEN blocks IS NOT NULL THEN (SELECT max_by(least(stem_end, h.hi), pos) FROM e WHERE e.doc = h.doc AND pos >= h.lo AND pos < least(h.at, h.hi) AND asks) END, h.at) AS place FROM high h),
    walk AS (SELECT doc, 0::BIGINT AS turn, -1 AS fig, 0::BIGINT AS place, '' AS how FROM f GROUP BY 1
        UNION ALL SELECT w.doc, f.turn, f.fig, coalesce((SELECT min_by(n.place, n.pos) FROM near n WHERE n.doc = f.doc AND n.fig = f.fig AND n.pos >= least(greatest(w.place, f.lo), f.hi)), (SELECT min_by(n.place, n.pos) FROM near n WHERE n.doc = f.doc AND n.fig = f.fig),
            (SELECT d.place FROM drawn d WHERE d.doc = f.doc AND d.fig = f.fig)), coalesce((SELECT CASE rank WHEN 9 THEN 'question' ELSE 'anchor' END FROM best t WHERE t.doc = f.doc AND t.fig = f.fig), 'height')
        FROM walk w JOIN f ON f.doc = w.doc AND f.turn = w.turn + 1)
    SELECT doc, fig, CAST(place AS INTEGER) AS line, how FROM walk WHERE turn > 0"""


@query(_PLACED)
def placed_figures_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.place_figures(SHEET_FIGURES.df(spark, sf_dir), SHEETS.df(spark, sf_dir))


@query(rf"""WITH {SHEETS.cte}, b AS (SELECT *, {_bare.format("line")} AS bare, count(*) OVER (PARTITION BY doc) AS n FROM sheet)
    SELECT doc, pos, CAST(coalesce(min(pos) FILTER (bare = '' OR {_block.format("line")}) OVER w, n) AS INTEGER) AS para_end,
        CAST(coalesce(min(pos) FILTER ({_asks.format("line")} OR bare = '---' OR starts_with(bare, '<!--') OR regexp_matches(line, '^\s*(\*\*)?\s*([A-D]|[a-d])\s*(\*\*)?\s*[.)]')) OVER w, n) AS INTEGER) AS stem_end
    FROM b WINDOW w AS (PARTITION BY doc ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""")
def block_ends_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.block_ends(SHEETS.df(spark, sf_dir)).select("doc", "pos", "para_end", "stem_end")


@query(rf"""WITH {SHEETS.cte}, w AS (SELECT doc, pos AS id, lower(substr(line, 3, 9)) AS key, 0 AS lo, 50 AS hi, pos % 7 AS cur FROM sheet WHERE pos % 5 = 2), n AS (SELECT doc, pos, lower(line) AS norm FROM sheet)
    SELECT w.doc, w.id, (SELECT min_by(pos, (pos - cur + 50) % 50) FROM n WHERE n.doc = w.doc AND pos < 50 AND key <> '' AND contains(norm, key)) AS found FROM w""")
def found_lines_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = SHEETS.df(spark, sf_dir)
    wanted = lines.filter("pos % 5 = 2").select("doc", F.col("pos").alias("id"), F.array(F.lower(F.substring("line", 3, 9))).alias("keys"), F.lit(0).alias("lo"), F.lit(50).alias("hi"), (F.col("pos") % 7).alias("cursor"))
    return A.find_lines(wanted, lines.withColumn("norm", F.lower("line"))).select("doc", "id", "found")
