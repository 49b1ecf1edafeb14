"""Queries over pages, lines and single texts of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import boilerplate as B
from .registry import FILE, Inline, file_of, query, table

NORM = "replace(lower(regexp_replace(regexp_replace({0}, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')), 'ß', 'ss')"
STRIP = "regexp_replace({0}, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')"
NUMBER = "regexp_matches(norm, '^[ \\t\\-–—.|]*([0-9]{1,4}|[ivxlcdmIVXLCDM]{1,7})[ \\t\\-–—.|]*$')"
LINES = f"""l AS (SELECT doc, page, i - 1 AS pos, parts[i] AS line, {NORM.format("parts[i]")} AS norm
    FROM (SELECT doc, page, parts, unnest(range(1, len(parts) + 1)) AS i FROM
        (SELECT {FILE} AS doc, doc_id AS page, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)))"""
BOILER = "t AS (SELECT " + FILE + """ AS doc, count(*) AS pages FROM documents GROUP BY 1),
    c AS (SELECT doc, norm, count(DISTINCT page) AS n_pages FROM l WHERE norm <> '' AND length(norm) <= 80 GROUP BY 1, 2),
    b AS (SELECT doc, norm, n_pages, greatest(2, CAST(round_even(pages * {0}, 0) AS INTEGER)) AS need FROM c JOIN t USING (doc)
        WHERE n_pages >= greatest(2, CAST(round_even(pages * {0}, 0) AS INTEGER)) OR """ + NUMBER + ")"
EFFECTIVE = f"""k AS (SELECT doc, page, string_agg({STRIP.format("line")}, chr(10) ORDER BY pos) AS e FROM l
        WHERE norm <> '' AND NOT {NUMBER} AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc = l.doc AND b.norm = l.norm) GROUP BY 1, 2),
    e AS (SELECT d.doc, d.doc_id AS page, {STRIP.format("coalesce(d.text, '')")} AS raw, coalesce({STRIP.format("k.e")}, '') AS effective
        FROM (SELECT {FILE} AS doc, doc_id, text FROM documents) d LEFT JOIN k ON k.doc = d.doc AND k.page = d.doc_id)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of files."""
    return table(spark, sf_dir, "documents").select(file_of().alias("doc"), F.col("doc_id").alias("page"), "text")


@query(f"WITH {LINES}, {BOILER.replace('{0}', '0.8')} SELECT doc, norm, n_pages, need FROM b")
def boilerplate_lines_80(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.boilerplate(pages(spark, sf_dir))


@query(f"WITH {LINES}, {BOILER.replace('{0}', '0.2')} SELECT doc, norm, n_pages, need FROM b")
def boilerplate_lines_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.boilerplate(pages(spark, sf_dir), 0.20)


@query(f"""WITH p AS (SELECT {FILE} AS doc, row_number() OVER (PARTITION BY {FILE} ORDER BY doc_id) - 1 AS page, count(*) OVER (PARTITION BY {FILE}) AS n FROM documents)
    SELECT doc, page FROM p WHERE n <= 24 OR page IN (SELECT CAST(floor(i * (n / 24.0)) AS BIGINT) FROM range(24) AS r(i))""")
def sampled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = pages(spark, sf_dir).withColumn("page", (F.row_number().over(Window.partitionBy("doc").orderBy("page")) - 1).cast("long"))
    return B.sampled(numbered).select("doc", "page")


@query(f"WITH {LINES}, {BOILER.replace('{0}', '0.2')}, {EFFECTIVE} SELECT doc, page, length(raw) AS raw_len, length(effective) AS eff_len, md5(effective) AS eff_md5 FROM e")
def effective_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    return B.effective_text(p, B.boilerplate(p, 0.20)).select("doc", "page", F.length("raw").alias("raw_len"), F.length("effective").alias("eff_len"), F.md5("effective").alias("eff_md5"))


SCAN = """s AS (SELECT doc, page, CASE WHEN length(effective) >= 200 OR length(raw) >= 800 THEN FALSE
        WHEN (page % 10) / 10.0 >= 0.7 THEN TRUE ELSE length(effective) <= 20 AND (page % 3 > 0 OR page % 97 >= 40) END AS scan FROM e)"""


def scanned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages with `scan`; image cover, images and strokes, which the tables lack, are made from the page number."""
    p = pages(spark, sf_dir)
    boiler = B.boilerplate(p, 0.20)
    page = F.col("page")
    scan = B.is_scan(F.col("raw"), F.col("effective"), (page % 10) / F.lit(10.0), page % 3, page % 97)
    return B.effective_text(p, boiler).select("doc", "page", scan.alias("scan")), boiler


@query(f"WITH {LINES}, {BOILER.replace('{0}', '0.2')}, {EFFECTIVE}, {SCAN} SELECT doc, page, scan FROM s")
def scan_length_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark, sf_dir)[0]


@query(f"""WITH {LINES}, {BOILER.replace('{0}', '0.2')}, {EFFECTIVE}, {SCAN},
    a AS (SELECT doc, count(*) AS pages, count(*) FILTER (NOT scan) AS pages_with_text, coalesce(string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FILTER (scan), '') AS scan_pages FROM s GROUP BY 1),
    f AS (SELECT doc, string_agg(norm, '|' ORDER BY norm) AS boilerplate FROM (SELECT doc, norm, row_number() OVER (PARTITION BY doc ORDER BY norm) AS r FROM b) WHERE r <= 12 GROUP BY 1)
    SELECT doc, pages, pages AS checked, pages_with_text, round(pages_with_text / pages, 3) AS coverage, pages_with_text / pages >= 0.8 AS is_digital,
        pages_with_text = 0 AS is_scan_doc, scan_pages, coalesce(boilerplate, '') AS boilerplate FROM a LEFT JOIN f USING (doc)""")
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, boiler = scanned(spark, sf_dir)
    return B.summary(p, boiler).withColumn("scan_pages", F.array_join(F.transform("scan_pages", lambda x: x.cast("string")), ",")).withColumn("boilerplate", F.array_join("boilerplate", "|"))


@query(f"""WITH {LINES}, {BOILER.replace('{0}', '0.2')}, {EFFECTIVE}, {SCAN},
    n AS (SELECT *, (row_number() OVER (PARTITION BY doc ORDER BY page) - 1) // 50 AS chunk FROM s),
    g AS (SELECT doc, chunk, min(page) + 1 AS lo, max(page) + 1 AS hi, count(*) AS n, count(*) FILTER (scan) AS s FROM n GROUP BY 1, 2)
    SELECT doc, CAST(sum(n) AS BIGINT) AS pages, CAST(sum(s) AS BIGINT) AS scan_pages, sum(s) > 80 AS large, greatest(1, CAST(round_even(sum(s) * 10 / 60, 0) AS INTEGER)) AS est_min,
        string_agg(CASE WHEN n > 1 THEN lo || '-' || hi ELSE CAST(lo AS VARCHAR) END, ',' ORDER BY chunk) AS ranges FROM g GROUP BY 1""")
def large_source_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.size_check(scanned(spark, sf_dir)[0])


BOXES = Inline("boxes", "doc string, page int, x0 double, y0 double, x1 double, y1 double", [
    ("a", 0, 0.0, 0.0, 600.0, 700.0), ("a", 1, 10.0, 10.0, 310.0, 410.0), ("a", 1, 200.0, 300.0, 500.0, 800.0), ("a", 2, 100.0, 100.0, 90.0, 200.0),
    ("b", 0, 0.0, 0.0, 300.0, 800.0), ("b", 0, 300.0, 0.0, 600.0, 400.0), ("b", 1, -50.0, -50.0, 650.0, 100.0)])
SIZES = Inline("sizes", "doc string, page int, width double, height double", [("a", 0, 600.0, 800.0), ("a", 1, 600.0, 800.0), ("a", 2, 600.0, 800.0), ("b", 0, 600.0, 800.0), ("b", 1, 600.0, 800.0), ("b", 2, 600.0, 800.0)])


@query(f"""WITH {BOXES.cte}, {SIZES.cte}, g AS (SELECT unnest(range(32)) AS k), cell AS (SELECT a.k AS gx, b.k AS gy FROM g a CROSS JOIN g b),
    big AS (SELECT doc, page, max(greatest(0, x1 - x0) * greatest(0, y1 - y0) / (width * height)) AS big FROM boxes JOIN sizes USING (doc, page) GROUP BY 1, 2),
    hit AS (SELECT s.doc, s.page, count(*) AS hits FROM sizes s, cell WHERE EXISTS (SELECT 1 FROM boxes b WHERE b.doc = s.doc AND b.page = s.page
        AND (gx + 0.5) * width / 32 BETWEEN b.x0 AND b.x1 AND (gy + 0.5) * height / 32 BETWEEN b.y0 AND b.y1) GROUP BY 1, 2)
    SELECT doc, page, coalesce(CASE WHEN big >= 0.7 THEN least(big, 1.0) ELSE coalesce(hits, 0) / 1024.0 END, 0.0)::DOUBLE AS cover
    FROM sizes LEFT JOIN big USING (doc, page) LEFT JOIN hit USING (doc, page)""")
def coverage_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.coverage(BOXES.df(spark), SIZES.df(spark))


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), n AS (SELECT doc_id, {NORM.format("line")} AS norm FROM l)
    SELECT norm, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM n WHERE norm <> '' GROUP BY 1""")
def norm_line_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.lines(F.col("text"))).alias("line")).select("doc_id", T.norm_line(F.col("line")).alias("norm"))
    counted = lines.filter("norm <> ''").groupBy("norm", "doc_id").agg(F.count("*").alias("n"))
    return counted.groupBy("norm").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query("""SELECT doc_id, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''),
        '!\\[[^\\]]*\\]\\(<[^>]*>\\)', '', 'g'), '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?m)^---+$', '', 'g'), '[#*_`\\-=|>]', '', 'g'),
        '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')) AS n FROM documents""")
def meaningful_text_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.meaningful_length(F.col("text")).alias("n"))


@query(f"""WITH s AS (SELECT doc_id, {STRIP.format("coalesce(text, '')")} AS t FROM documents), m AS (SELECT doc_id, t, {STRIP.format("string_split(t, chr(10))[-1]")} AS last FROM s)
    SELECT doc_id, CASE WHEN t = '' THEN FALSE WHEN (length(t) - length(replace(t, '$', ''))) % 2 = 1 THEN TRUE
        WHEN last = '' OR regexp_matches(last, '^(\\*\\*)?([A-Da-d][.)]|Câu|Bài|#|\\||\\*|-|[0-9]+[.)])') OR regexp_matches(last, '[.?!:)\\]"”…|]$') THEN FALSE
        ELSE length(last) > 40 END AS truncated FROM m""")
def looks_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.looks_truncated(F.col("text")).alias("truncated"))


@query("""SELECT doc_id, length(text) - length(replace(text, '$', '')) AS dollars,
    CAST((length(replace(text, '$$', '')) - length(replace(replace(text, '$$', ''), '$', ''))) % 2 + ((length(text) - length(replace(text, '$$', ''))) // 2) % 2 AS INTEGER) AS unbalanced FROM documents""")
def dollar_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.dollars(F.col("text")).alias("dollars"), T.unbalanced_dollars(F.col("text")).alias("unbalanced"))


MARKED = "'<!-- p2w:page=' || doc_id || ' -->' || chr(10) || coalesce(text, '') || chr(10) || '  ______  ' || chr(10) || 'end'"


def marked() -> F.Column:
    return F.concat(F.lit("<!-- p2w:page="), F.col("doc_id").cast("string"), F.lit(" -->\n"), F.coalesce("text", F.lit("")), F.lit("\n  ______  \nend"))


@query(f"SELECT doc_id, md5(regexp_replace(regexp_replace({MARKED}, '<!-- p2w:page=[0-9]+ -->', '', 'g'), '(?m)^[ \\t]*_{{5,}}[ \\t]*$\\n?', '', 'g')) AS h FROM documents")
def markers_and_rules_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.strip_rule_lines(T.strip_page_markers(marked()))).alias("h"))


@query(f"""SELECT {FILE} AS doc, md5(string_agg(coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id)) AS merged FROM documents GROUP BY 1""")
def merged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text"))))
    return table(spark, sf_dir, "documents").groupBy(file_of().alias("doc")).agg(F.md5(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n---\n\n")).alias("merged"))


@query("""WITH l AS (SELECT doc_id, i, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
    f AS (SELECT *, contains(line, '|') AS pipe, i - row_number() OVER (PARTITION BY doc_id, contains(line, '|') ORDER BY i) AS g FROM l)
    SELECT doc_id, min(i) - 1 AS first_line, count(*) AS n_lines, count(*) >= 2 AS is_table FROM f WHERE pipe GROUP BY doc_id, g""")
def pipe_table_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.tables import islands

    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    blocks = islands(lines, ["doc_id"], "pos", F.contains(F.col("line"), F.lit("|")))
    return blocks.groupBy("doc_id", "island").agg(F.min("pos").cast("long").alias("first_line"), F.count("*").alias("n_lines"), (F.count("*") >= 2).alias("is_table")).drop("island")


SYMBOLS = "√∑∫∞≤≥≠≈±×÷πλμαβγθωφΔΩ"


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, doc_id % 50 = 0 AS scan, doc_id % 41 = 0 AS has_table, doc_id % 53 AS strokes FROM documents),
    n AS (SELECT *, len(regexp_extract_all(t, '[{SYMBOLS}]')) AS n_sym, regexp_matches(t, '\\b(cos|sin|tan|cot|log|ln|sqrt)\\b') AS fn, len(regexp_extract_all(t, '[0-9πλμαβγθωφ] */ *[0-9πλμαβγθωφ]')) AS n_frac, regexp_matches(t, '[.,xX×·] *10 *-?[0-9]') AS sci FROM d)
    SELECT doc_id, scan OR has_table OR strokes > 40 OR n_sym >= 8 OR n_frac >= 2 OR sci AS is_complex FROM n""")
def page_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.routing import is_complex

    t = F.coalesce("text", F.lit(""))
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", is_complex(t, i % 50 == 0, i % 41 == 0, i % 53).alias("is_complex"))


@query(f"""WITH c AS (SELECT {FILE} AS doc, row_number() OVER (PARTITION BY {FILE} ORDER BY doc_id) - 1 AS idx, doc_id % 7 < 2 AS hard FROM documents),
    g AS (SELECT *, idx - row_number() OVER (PARTITION BY doc, hard ORDER BY idx) AS island FROM c)
    SELECT doc, CASE WHEN hard THEN 'C' ELSE 'S' END AS kind, min(idx) AS first_page, max(idx) AS last_page, count(*) AS n FROM g GROUP BY doc, hard, island""")
def page_ranges_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.routing import page_ranges

    numbered = table(spark, sf_dir, "documents").select(file_of().alias("doc"), (F.row_number().over(Window.partitionBy(file_of()).orderBy("doc_id")) - 1).cast("long").alias("idx"), (F.col("doc_id") % 7 < 2).alias("hard"))
    return page_ranges(numbered, "doc")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which short lines of each file are boilerplate, what text is left, and which pages look empty."""
    return source_summary(spark, sf_dir)
