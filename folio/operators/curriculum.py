"""The curriculum dimension and what a scope allows and denies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Grades and the ordered chapters of the upper-secondary physics curriculum.
CHAPTERS = [
    (10, "Lớp 10", 0, "10.1", "Mở đầu"),
    (10, "Lớp 10", 1, "10.2", "Động học"),
    (10, "Lớp 10", 2, "10.3", "Động lực học"),
    (10, "Lớp 10", 3, "10.4", "Công, năng lượng, công suất"),
    (10, "Lớp 10", 4, "10.5", "Động lượng"),
    (10, "Lớp 10", 5, "10.6", "Chuyển động tròn"),
    (10, "Lớp 10", 6, "10.7", "Biến dạng của vật rắn"),
    (11, "Lớp 11", 0, "11.1", "Dao động"),
    (11, "Lớp 11", 1, "11.2", "Sóng"),
    (11, "Lớp 11", 2, "11.3", "Điện trường"),
    (11, "Lớp 11", 3, "11.4", "Dòng điện, mạch điện"),
    (12, "Lớp 12", 0, "12.1", "Vật lí nhiệt"),
    (12, "Lớp 12", 1, "12.2", "Khí lí tưởng"),
    (12, "Lớp 12", 2, "12.3", "Từ trường"),
    (12, "Lớp 12", 3, "12.4", "Vật lí hạt nhân và phóng xạ"),
]
SCHEMA = "grade int, grade_name string, ord int, id string, name string"


def chapters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHAPTERS, SCHEMA)


def scope_chapters(scopes: DataFrame, dimension: DataFrame) -> DataFrame:
    """For each scope (sid, mode, grade, chapter_id, cumulative) and chapter whether it is allowed.

    An unknown chapter means the grade's last. Cumulative scopes allow lower grades and the grade up to the chapter,
    others the chapter alone; what comes later, and for others all else, is denied. The dimension is broadcast;
    it has a row for each chapter of the curriculum.
    """
    d = F.broadcast(dimension)
    here = d.select(F.col("grade").alias("g"), F.col("id").alias("chapter_id"), F.col("ord").alias("found"))
    last = d.groupBy(F.col("grade").alias("g")).agg(F.max("ord").alias("last"))
    s = scopes.filter(F.col("mode") == "chuong_trinh").join(F.broadcast(last), F.col("grade") == F.col("g")).drop("g")
    s = s.join(here, (s["grade"] == here["g"]) & (s["chapter_id"] == here["chapter_id"]), "left").select(s["sid"], s["grade"].alias("at_grade"), F.coalesce("found", "last").alias("at"), F.coalesce(s["cumulative"], F.lit(True)).alias("cumulative"))
    same, lower = F.col("grade") == F.col("at_grade"), F.col("grade") < F.col("at_grade")
    allowed = F.when(F.col("cumulative"), lower | (same & (F.col("ord") <= F.col("at")))).otherwise(same & (F.col("ord") == F.col("at")))
    return s.join(d).select("sid", "grade", "ord", "id", "name", allowed.alias("allowed"))


def scope_labels(scopes: DataFrame, dimension: DataFrame) -> DataFrame:
    """sid and a short label."""
    d = F.broadcast(dimension)
    grades = d.select(F.col("grade").alias("g"), "grade_name").distinct()
    names = d.select(F.col("grade").alias("cg"), F.col("id").alias("cid"), "name")
    s = scopes.join(grades, F.col("grade") == F.col("g"), "left").join(names, (F.col("grade") == F.col("cg")) & (F.col("chapter_id") == F.col("cid")), "left")
    chapter = F.concat(F.col("grade_name"), F.lit(" · "), F.when(F.coalesce("cumulative", F.lit(True)), "").otherwise("chỉ "), F.col("name"))
    label = F.when(F.col("mode") == "tuy_chinh", "Tùy chỉnh").when((F.coalesce("mode", F.lit("")) != "chuong_trinh") | F.col("grade_name").isNull(), "Không ràng buộc").otherwise(F.coalesce(chapter, F.col("grade_name")))
    return s.select("sid", label.alias("label"))
