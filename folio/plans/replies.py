"""Queries over model replies and tables in Markdown."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import replies as R
from .registry import Inline, query, table

REPLY = json.dumps({"markdown": "Câu 1. {{FIGURE_1}} và {{FIGURE_2}} rồi {{FIGURE_9}}", "figures": [{"id": 1, "box_2d": [100, 100, 300, 500], "caption": "Đồ thị"}, {"id": 2, "bbox": [10, 20, 11, 21], "caption": ""}]})


@query("SELECT * FROM (VALUES ('d', 2, 'Câu 1. \n\n![Đồ thị](figures/p3_fig1.png)\n\n và \n\n*[Hình trong trang gốc]*\n\n rồi \n\n*[Hình trong trang gốc]*', '1:true:55.0,2:false:60.0'), ('d', 3, 'chỉ chữ', '')) t(doc, page, markdown, figures)")
def page_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("d", 2, REPLY, 1000, 1400, 0.5, 0.5), ("d", 3, "```md\nchỉ chữ\n```", 1000, 1400, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "doc string, page int, raw string, width int, height int, y_off double, y_span double")
    shown = F.array_join(F.transform("figures", lambda f: F.concat_ws(":", f["id"], f["placed"].cast("string"), F.round(f["box"]["y0"], 3).cast("string"))), ",")
    return R.page_replies(df).select("doc", "page", "markdown", shown.alias("figures"))


MD = ["a", "| t | 1 |", "|---|---|", "| x | 2 |", "b", "| Nội dung | Đ | S |", "|---|---|---|", "| a) m | | |", "c", "| p |", "| 1 | 2 |", "| 3 | 4 |"]
OUT = Inline("wanted_lines", "pos int, line string", list(enumerate(["a", "", "![Bảng](f1.png)", "", "b", "", "a) m", "", "c", "| p |", "| 1 | 2 |", "| 3 | 4 |"], 1)))


@query(f"WITH {OUT.cte} SELECT pos, line FROM wanted_lines")
def tables_as_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(MD)], "doc string, pos int, line string")
    refs = spark.createDataFrame([("d", 1, "f1.png"), ("d", 2, None)], "doc string, k int, file string")
    return R.tables_as_images(lines, refs).select("pos", "line")


@query("""WITH l AS (SELECT doc_id, i, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)))
    SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_matches(line, '^[ \\t]*\\|.*\\|[ \\t]*$')) AS rows FROM l GROUP BY 1""")
def tables_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With no refs and no tables of two rows, documents stay as they are."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    refs = spark.createDataFrame([], "doc long, k int, file string")
    out = R.tables_as_images(lines, refs)
    return out.groupBy(F.col("doc").alias("doc_id")).agg(F.count("*").alias("n"), F.count_if(F.col("line").rlike(r"^[ \t]*\|.*\|[ \t]*$")).alias("rows"))


ANSWERS = Inline("model_out", "sec int, q int, images string, option_images string", [(0, 0, "k.png", ""), (0, 1, "", "o1.png/o2.png"), (1, 0, "u.png", ""), (1, 1, "z.png", "")])


@query(f"WITH {ANSWERS.cte} SELECT sec, q, images, option_images FROM model_out")
def model_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = [("d", 0, 0, "tu_luan", 1, "một", [], None), ("d", 0, 1, "tu_luan", 2, "hai", ["A.", "B."], True), ("d", 1, 0, "dung_sai", 7, "bảy", [], None), ("d", 1, 1, "dung_sai", 8, "| a | b |\n| 1 | 2 |", [], None), ("d", 1, 2, "dung_sai", 9, " ", [], None)]
    pool = [("d", 0, "tu_luan", 1, 0, ["k.png"]), ("d", 1, "tu_luan", 2, 1, ["o1.png", "o2.png"]), ("d", 2, "khac", 7, 5, ["u.png"]), ("d", 3, "dung_sai", 8, 1, ["p_tbl3.png"]), ("d", 4, "khac", 99, 9, ["z.png"])]
    q = spark.createDataFrame(questions, "doc string, sec int, q int, type string, number int, text string, options array<string>, options_are_figures boolean")
    p = spark.createDataFrame(pool, "doc string, ord int, type string, number int, q int, files array<string>")
    out = R.model_questions(q, p)
    return out.select("sec", "q", F.array_join("images", "/").alias("images"), F.array_join(F.flatten("option_images"), "/").alias("option_images"))
