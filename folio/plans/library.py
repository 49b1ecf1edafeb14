"""Queries over the library store, the document tree and the curriculum."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import curriculum as C
from ..operators import documents as D
from ..operators import library as L
from .registry import Derived, Inline, query, table

T0, T1, T2 = (datetime.datetime(2026, 1, d) for d in (1, 2, 3))
#: Suppliers as settings: every third is a key, some are empty.
_value = "CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('v', s_nationkey) END"
SETTINGS = Derived("settings", "supplier", "key string, value string", ["concat('setting_', s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '_key' ELSE '' END)", _value], "s_suppkey % 4 > 0")
DEFAULTS = Derived("defaults", "supplier", "key string, value string", ["concat('setting_', s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '_key' ELSE '' END)", "concat('default', s_nationkey)"], "s_suppkey % 7 <> 1")
INCOMING = Derived("incoming", "supplier", "key string, value string", ["concat('setting_', s_suppkey + 5, CASE WHEN (s_suppkey + 5) % 3 = 0 THEN '_key' ELSE '' END)", "CASE s_suppkey % 4 WHEN 0 THEN '***' WHEN 1 THEN '' ELSE concat('new', s_nationkey) END"])
#: Documents as the library's rows; a third holds a tree.
LIBRARY = Derived("store", "documents", S.LIBRARY, [
    "doc_id", "CASE doc_id % 4 WHEN 0 THEN concat('Dao động ', lang) ELSE concat('Sóng cơ ', doc_id) END", "'Vật lý'", "10 + doc_id % 3", "CASE doc_id % 5 WHEN 0 THEN 'dao dong' WHEN 1 THEN NULL ELSE concat('Chương ', doc_id % 7) END", "'1'", "CASE doc_id % 2 WHEN 0 THEN 'de_thi' ELSE 'khac' END",
    """CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '{}' ELSE concat('{"title":"N', doc_id, '","sections":[{"type":"dung_sai","questions":[{"number":1},{"number":2}]}]}') END""",
    "'2026-01-01'", "CASE doc_id % 2 WHEN 0 THEN '2026-01-02' ELSE '2026-01-03' END"])
DOCS = Inline("store", S.LIBRARY, [
    (1, "Dao động", "Vật lý", 11, "Chương 1", "1", "de_thi", "{}", T0, T1), (2, "Sóng cơ", "Vật lý", 11, "dao dong", "1", "khac", None, T0, T2),
    (3, "Nhiệt học", "Vật lý", 12, "", "2", "de_thi", '{"title":"N","sections":[{"type":"dung_sai","questions":[{"number":1},{"number":2}]}]}', T0, T1)])
SAVES = Inline("saves", "seq int, id long, title string, subject string, grade int, chapter string, semester string, doc_type string, content_json string", [
    (1, None, "Mới", None, 10, None, None, None, "{}"), (2, 2, "Sóng", "Vật lý", 11, "c", "2", "de_thi", "{}"), (3, 2, "Sóng 2", None, 11, None, None, None, '{"a":1}'), (4, 0, "Mới 2", "Toán", None, "x", "1", "khac", None)])
UPDATES = Derived("updates", "documents", "id long, title string, content_json string", [
    "doc_id", "CASE doc_id % 6 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE concat(lang, ' ', doc_id) END", """CASE doc_id % 5 WHEN 0 THEN '{"sections":[]}' WHEN 1 THEN '{}' WHEN 2 THEN NULL ELSE concat('{"sections":[{"type":"khac","label":"', lang, '"}]}') END"""])


@query(f"WITH {SETTINGS.cte}, {DEFAULTS.cte} SELECT key, value FROM settings UNION ALL SELECT key, value FROM defaults WHERE key NOT IN (SELECT key FROM settings)")
def settings_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.seed_settings(SETTINGS.df(spark, sf_dir), DEFAULTS.df(spark, sf_dir))


@query(f"WITH {SETTINGS.cte} SELECT key, CASE WHEN contains(key, 'key') AND coalesce(value, '') <> '' THEN '***' ELSE value END AS value FROM settings")
def settings_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.masked_settings(SETTINGS.df(spark, sf_dir))


@query(f"""WITH {SETTINGS.cte}, {INCOMING.cte}, ok AS (SELECT i.key, i.value FROM incoming i LEFT JOIN settings s USING (key)
    WHERE NOT (contains(i.key, 'key') AND coalesce(s.value, '') <> '' AND i.value IN ('***', ''))) SELECT * FROM ok UNION ALL SELECT key, value FROM settings WHERE key NOT IN (SELECT key FROM ok)""")
def settings_guarded_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.update_settings(SETTINGS.df(spark, sf_dir), INCOMING.df(spark, sf_dir))


@query(f"WITH {SETTINGS.cte} SELECT key, value FROM settings")
def settings_as_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.settings_map(SETTINGS.df(spark, sf_dir)).select(F.explode("settings").alias("key", "value"))


@query(f"""WITH {DOCS.cte}, {SAVES.cte}, f AS (SELECT seq, id, title, coalesce(subject, 'Vật lý') AS subject, grade, coalesce(chapter, '') AS chapter, coalesce(semester, '') AS semester, coalesce(doc_type, 'khac') AS doc_type, content_json FROM saves),
    n AS (SELECT * REPLACE ((SELECT max(id) FROM store) + row_number() OVER (ORDER BY seq) AS id), TIMESTAMP '2026-02-01' AS created_at FROM f WHERE coalesce(id, 0) = 0),
    u AS (SELECT f.*, s.created_at FROM f JOIN store s USING (id) WHERE f.id <> 0 QUALIFY row_number() OVER (PARTITION BY f.id ORDER BY f.seq DESC) = 1),
    r AS (SELECT * FROM n UNION ALL SELECT * FROM u)
    SELECT id, title, subject, grade, chapter, semester, doc_type, content_json, created_at, TIMESTAMP '2026-02-01' AS updated_at FROM r
    UNION ALL SELECT * FROM store WHERE id NOT IN (SELECT id FROM r)""")
def library_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.save_documents(DOCS.df(spark), SAVES.df(spark), F.lit(datetime.datetime(2026, 2, 1)).cast("timestamp"))


@query(f"WITH {LIBRARY.cte} SELECT id, title, updated_at FROM store WHERE grade = 11 AND (title ILIKE '%dao%' OR chapter ILIKE '%dao%')")
def library_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.list_documents(LIBRARY.df(spark, sf_dir), grade=11, search="dao").select("id", "title", "updated_at")


@query(f"WITH {LIBRARY.cte} SELECT id, title, content_json->>'$.title' AS content_title, CAST(json_array_length(content_json, '$.sections') AS INTEGER) AS n_sections FROM store WHERE id = 5")
def library_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.get_document(LIBRARY.df(spark, sf_dir), 5).select("id", "title", F.col("content.title").alias("content_title"), F.size("content.sections").alias("n_sections"))


@query("""WITH gone AS (SELECT p_partkey FROM part WHERE p_partkey % 10 = 0) SELECT 'part' AS tbl, count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM gone)
    UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM gone)""")
def library_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("document_id"))
    kept, children = L.delete_documents(parts, items, parts.filter("id % 10 = 0"))
    return kept.agg(F.count("*").alias("n")).select(F.lit("part").alias("tbl"), "n").unionByName(children.agg(F.count("*").alias("n")).select(F.lit("lineitem").alias("tbl"), "n"))


@query(f"""WITH {UPDATES.cte} SELECT id, CASE WHEN trim(coalesce(title, '')) = '' THEN 'no title' WHEN coalesce(json_array_length(content_json, '$.sections'), 0) = 0 THEN 'no sections' ELSE 'ok' END AS reason FROM updates""")
def library_guarded_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = L.split_updates(UPDATES.df(spark, sf_dir))
    return good.select("id", F.lit("ok").alias("reason")).unionByName(bad.select("id", "reason"))


@query("SELECT p_partkey, p_name, p_size, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM part WHERE p_size = 10 AND p_name ILIKE '%a%' QUALIFY place <= 20")
def library_filter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "part").filter((F.col("p_size") == 10) & F.col("p_name").ilike("%a%")).orderBy(F.desc("p_retailprice"), "p_partkey").limit(20)
    return top.select("p_partkey", "p_name", "p_size", F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("place"))


HISTORY = "SELECT conv_id AS document_id, conv_id * 1000 + turn AS id, role AS model_used, text AS solution_text, TIMESTAMP '2026-01-01' + turn * INTERVAL 1 MINUTE AS created_at FROM conversations"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as solution history: one row for each turn."""
    c = table(spark, sf_dir, "conversations")
    at = F.timestamp_micros((F.lit(1767225600) + F.col("turn") * 60) * 1_000_000)
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("document_id"), F.lit("").alias("question_id"), F.lit("").alias("question_text"), F.col("text").alias("solution_text"), F.col("role").alias("model_used"), F.lit(0).alias("tokens_used"), at.alias("created_at"))


@query(f"WITH h AS ({HISTORY}) SELECT id, document_id, created_at FROM h ORDER BY created_at DESC, id DESC LIMIT 50")
def history_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.latest_history(history(spark, sf_dir)).select("id", "document_id", "created_at")


@query(f"WITH h AS ({HISTORY}) SELECT id, document_id, created_at FROM h QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) <= 2")
def history_topk_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("created_at"), F.desc("id")))
    return history(spark, sf_dir).select("id", "document_id", "created_at", rank.alias("r")).filter("r <= 2").drop("r")


@query(f"""WITH h AS ({HISTORY}), a AS (SELECT * FROM h UNION ALL SELECT 7, (SELECT max(id) FROM h) + row_number() OVER (ORDER BY doc_id), 'm', text, TIMESTAMP '2026-02-01' FROM documents)
    SELECT count(*) AS n, max(id) AS top, count(*) FILTER (model_used = 'm') AS added, count(*) FILTER (id <> 1) AS without_one FROM a""")
def history_append_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.lit(7).cast("long").alias("document_id"), F.lit("").alias("question_id"), F.lit("").alias("question_text"), F.col("text").alias("solution_text"), F.lit("m").alias("model_used"), F.lit(0).alias("tokens_used"))
    grown = L.append_history(history(spark, sf_dir), new, F.lit(datetime.datetime(2026, 2, 1)).cast("timestamp"))
    one = L.delete_history(grown, 1).agg(F.count("*").alias("without_one"))
    return grown.agg(F.count("*").alias("n"), F.max("id").alias("top"), F.count_if(F.col("model_used") == "m").alias("added")).crossJoin(one)


@query("SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1")
def last_answer_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", "text")
    return L.last_write_wins(rows, "conv_id", "turn")


# --- the document tree -------------------------------------------------------------------------------------------

IMG = lambda f: {"id": f, "filename": f, "extra": 1}
_TREES = [
    {"title": "A @lang", "unknown": 5, "sections": [
        {"type": "trac_nghiem_lua_chon", "label": "PHẦN I", "questions": [
            {"number": 1, "text": "q1 @lang", "options": ["A. x", "B. y"], "correct_answer": "b", "images": [IMG("a@id.png")]},
            {"number": 2, "text": "t" * 90, "options": ["A. x", "B. y", "C. z"], "option_images": [[IMG("o@id.png")]], "ai_solution": "Vậy chọn => Chọn C. vì @id " + "s" * 60}]},
        {"type": "ly_thuyet", "label": "LT", "is_theory": True, "questions": [{"number": 1, "text": "theory"}]},
        {"type": "dung_sai", "label": "PHẦN II", "questions": [{"number": 1, "text": "ds @id", "sub_items": ["a. m", "b. n"], "ai_solution": "a) Đúng, b) Sai, c) **Đúng**"}]}]},
    {"title": "B @id", "sections": [{"type": "ly_thuyet", "questions": []}]}, {},
    {"sections": [{"type": "tu_luan", "questions": [{"number": 3, "text": "@lang"}, {"number": 4, "images": [IMG("c@id.png"), IMG("d.png")]}]}]}]
_tree = " ".join(f"WHEN {k} THEN '{json.dumps(t, ensure_ascii=False)}'" for k, t in enumerate(_TREES))
#: Documents as trees of four shapes, with their number and language in them.
TREES = Derived("trees", "documents", "id long, content_json string", ["doc_id", f"replace(replace(CASE doc_id % 4 {_tree} END, '@id', concat('', doc_id)), '@lang', lang)"])


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TREES.df(spark, sf_dir).withColumn("doc", D.parse(F.col("content_json")))


FLAT = f"""WITH {TREES.cte}, s AS (SELECT id, i AS sec_ord, content_json->'$.sections'->i AS s FROM trees, range(10) r(i) WHERE i < json_array_length(content_json, '$.sections')),
    q AS (SELECT id, sec_ord, j AS q_ord, s->>'$.type' AS type, coalesce(CAST(s->>'$.is_theory' AS BOOLEAN), FALSE) AS is_theory, s->'$.questions'->j AS q FROM s, range(10) r(j) WHERE j < json_array_length(s, '$.questions'))"""


@query(f"WITH {TREES.cte} SELECT id, content_json->>'$.title' AS title, CAST(coalesce((SELECT sum(json_array_length(content_json, '$.sections[' || i || '].questions')) FROM range(10) r(i)), 0) AS INTEGER) AS n FROM trees")
def count_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees(spark, sf_dir).select("id", F.col("doc.title").alias("title"), D.count_questions(F.col("doc")).alias("n"))


@query(f"""{FLAT}, t AS (SELECT id, list(s->>'$.type') AS types FROM s GROUP BY 1) SELECT id, CASE WHEN list_contains(types, 'trac_nghiem_lua_chon') OR list_contains(types, 'dung_sai') THEN 'de_thi'
    WHEN list_contains(types, 'ly_thuyet') THEN 'phieu_bai_tap' ELSE 'khac' END AS doc_type FROM trees LEFT JOIN t USING (id)""")
def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees(spark, sf_dir).select("id", D.doc_type(F.coalesce(F.transform("doc.sections", lambda s: s["type"]), F.array().cast("array<string>"))).alias("doc_type"))


@query(f"""{FLAT} SELECT id, sec_ord, q_ord, coalesce(json_array_length(q, '$.images'), 0) > 0 OR coalesce(list_sum([json_array_length(q, '$.option_images[' || k || ']') FOR k IN range(5)]), 0) > 0 AS has_images,
    CAST(coalesce(json_array_length(q, '$.options'), 0) AS INTEGER) AS n_lists, q->>'$.images[0].filename' AS first_image FROM q""")
def question_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.questions(trees(spark, sf_dir))
    padded = D.pad_option_images(F.col("q.option_images"), F.col("q.options"))
    return rows.select("id", F.col("sec_ord").cast("long").alias("sec_ord"), F.col("q_ord").cast("long").alias("q_ord"), D.has_images(F.col("q.images"), F.col("q.option_images")).alias("has_images"), F.size(padded).alias("n_lists"), F.get("q.images", F.lit(0))["filename"].alias("first_image"))


@query(f"""{FLAT} SELECT id, row_number() OVER (PARTITION BY id ORDER BY sec_ord, q_ord) AS stt, 'Câu ' || (q->>'$.number') AS caption, substr(coalesce(q->>'$.text', ''), 1, 80) || CASE WHEN length(coalesce(q->>'$.text', '')) > 80 THEN '...' ELSE '' END AS summary,
    coalesce(nullif(q->>'$.correct_answer', ''), substr(coalesce(q->>'$.ai_solution', ''), 1, 60)) AS answer FROM q""")
def answer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.answer_table(D.questions(trees(spark, sf_dir)))


@query(f"""{FLAT}, n AS (SELECT id, sec_ord, q_ord, row_number() OVER (PARTITION BY id ORDER BY sec_ord, q_ord) AS gnum FROM q WHERE NOT is_theory) SELECT * FROM n WHERE q_ord > 0 OR sec_ord = 2""")
def global_numbering_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.global_numbers(D.questions(trees(spark, sf_dir))).select("id", F.col("sec_ord").cast("long").alias("sec_ord"), F.col("q_ord").cast("long").alias("q_ord"), F.col("gnum").cast("long").alias("gnum")).filter("q_ord > 0 OR sec_ord = 2")


@query(f"""{FLAT} SELECT id, sec_ord, q_ord, coalesce(nullif(regexp_extract(upper(coalesce(q->>'$.correct_answer', '')), '[A-D]'), ''), nullif(regexp_extract(coalesce(q->>'$.ai_solution', ''), '(?:Ch[oọ]n|[Đđ]áp[ \\t]*án|→)[^A-Da-d\\n]{{0,10}}\\b([A-D])\\b', 1), '')) AS letter,
    array_to_string(list_sort(regexp_extract_all(coalesce(q->>'$.ai_solution', ''), '\\b([a-d])\\)[ \\t]*\\**[ \\t]*(?:Đúng|đúng)', 1)), ',') AS true_items FROM q""")
def right_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.questions(trees(spark, sf_dir))
    return rows.select("id", F.col("sec_ord").cast("long").alias("sec_ord"), F.col("q_ord").cast("long").alias("q_ord"), D.answer_letter(F.col("q.correct_answer"), F.col("q.ai_solution")).alias("letter"), F.array_join(D.true_statements(F.col("q.ai_solution")), ",").alias("true_items"))


@query(f"""{FLAT}, f AS (SELECT *, CAST(q->>'$.number' AS INTEGER) AS number FROM q), c AS (SELECT id, number, count(*) AS n FROM f GROUP BY 1, 2),
    p AS (SELECT f.*, n = 1 AS uniq, q->>'$.images[0].filename' AS img FROM f JOIN c USING (id, number) WHERE coalesce(json_array_length(q, '$.images'), 0) > 0 OR coalesce(list_sum([json_array_length(q, '$.option_images[' || k || ']') FOR k IN range(5)]), 0) > 0),
    k AS (SELECT id, type, number, arg_max(coalesce(img, '-'), sec_ord * 100 + q_ord) AS img FROM p GROUP BY 1, 2, 3), u AS (SELECT id, number, arg_max(coalesce(img, '-'), sec_ord * 100 + q_ord) AS img FROM p WHERE uniq GROUP BY 1, 2), o AS (SELECT id, type, q_ord, arg_max(coalesce(img, '-'), sec_ord * 100 + q_ord) AS img FROM p GROUP BY 1, 2, 3)
    SELECT f.id, f.sec_ord, f.q_ord, nullif(coalesce(k.img, u.img, o.img, '-'), '-') AS img FROM f LEFT JOIN k ON k.id = f.id AND k.type = f.type AND k.number = f.number LEFT JOIN u ON u.id = f.id AND u.number = f.number LEFT JOIN o ON o.id = f.id AND o.type = f.type AND o.q_ord = f.q_ord""")
def images_by_key_number_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.questions(trees(spark, sf_dir))
    out = D.attach_images(rows, D.image_indexes(rows))
    return out.select("id", F.col("sec_ord").cast("long").alias("sec_ord"), F.col("q_ord").cast("long").alias("q_ord"), F.get("attached", F.lit(0))["filename"].alias("img"))


@query(f"WITH {TREES.cte} SELECT id, content_json->>'$.title' AS title, coalesce(json_array_length(content_json, '$.sections'), 0)::INTEGER AS n FROM trees")
def document_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = trees(spark, sf_dir).withColumn("doc", D.parse(F.to_json("doc")))
    return again.select("id", F.col("doc.title").alias("title"), F.greatest(F.coalesce(F.size("doc.sections"), F.lit(0)), F.lit(0)).alias("n"))


# --- curriculum --------------------------------------------------------------------------------------------------

CHAPTERS = Inline("chapters", C.SCHEMA, C.CHAPTERS)
SCOPES = Inline("scopes", "sid int, mode string, grade int, chapter_id string, cumulative boolean", [
    (1, "chuong_trinh", 11, "11.2", True), (2, "chuong_trinh", 11, "11.2", False), (3, "chuong_trinh", 10, "nope", None), (4, "tuy_chinh", None, None, None), (5, None, None, None, None), (6, "chuong_trinh", 9, "9.1", True)])


@query(f"""WITH {CHAPTERS.cte}, {SCOPES.cte}, s AS (SELECT sid, s.grade AS g, coalesce((SELECT ord FROM chapters c WHERE c.grade = s.grade AND c.id = s.chapter_id), (SELECT max(ord) FROM chapters c WHERE c.grade = s.grade)) AS upto, coalesce(cumulative, TRUE) AS cum FROM scopes s WHERE mode = 'chuong_trinh' AND grade IN (SELECT grade FROM chapters))
    SELECT sid, grade, ord, id, name, CASE WHEN cum THEN grade < g OR (grade = g AND ord <= upto) ELSE grade = g AND ord = upto END AS allowed FROM s, chapters""")
def curriculum_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.scope_chapters(SCOPES.df(spark), C.chapters(spark))


@query(f"""WITH {CHAPTERS.cte}, {SCOPES.cte} SELECT sid, CASE WHEN mode = 'tuy_chinh' THEN 'Tùy chỉnh' WHEN coalesce(mode, '') <> 'chuong_trinh' OR s.grade NOT IN (SELECT grade FROM chapters) THEN 'Không ràng buộc'
    ELSE coalesce((SELECT grade_name || ' · ' || CASE WHEN coalesce(cumulative, TRUE) THEN '' ELSE 'chỉ ' END || name FROM chapters c WHERE c.grade = s.grade AND c.id = s.chapter_id), (SELECT any_value(grade_name) FROM chapters c WHERE c.grade = s.grade)) END AS label FROM scopes s""")
def curriculum_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.scope_labels(SCOPES.df(spark), C.chapters(spark))
