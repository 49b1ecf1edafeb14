"""Queries that write DOCX and XLSX files of the given tables, read them again and give what stands there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import documents as D
from ..session import scratch
from ..sources import files, office
from .registry import query, table

#: What XML can't hold goes; a paragraph's ends are bare when it is read.
_SAID = "trim(regexp_replace({0}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), ' ' || chr(9) || chr(10) || chr(13))"


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(replace(coalesce(text, ''), '**', ''), chr(10))) AS t, generate_subscripts(string_split(replace(coalesce(text, ''), '**', ''), chr(10)), 1) AS pos FROM documents),
    b AS (SELECT doc_id, 0 AS pos, 'D' || doc_id AS t FROM documents UNION ALL SELECT doc_id, pos, t FROM l
          UNION ALL SELECT doc_id, len(string_split(replace(coalesce(text, ''), '**', ''), chr(10))) + 1, '$\\frac{{' || doc_id || '}}{{\\sqrt{{' || n_chars || '}}}}+x_{{' || doc_id % 7 || '}}^{{2}}$ and $\\odd{{' || doc_id || '}}$' FROM documents)
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, {_SAID.format("replace(replace(t, '$', CASE WHEN pos > 0 AND t LIKE '$\\frac%and $\\odd%' THEN '$' ELSE '' END), '*', '')")} AS text FROM b""")
def docx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a DOCX file: a title, a paragraph for each line, and one with a formula that is understood and one that isn't."""
    docs = table(spark, sf_dir, "documents")
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "[*$]", ""), "\n")
    i, n = F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    math = F.concat(F.lit("$\\frac{"), i, F.lit("}{\\sqrt{"), n, F.lit("}}+x_"), (F.col("doc_id") % 7).cast("string"), F.lit("^2$ and $\\odd{"), i, F.lit("}$"))
    said = F.concat(F.array(F.concat(F.lit("D"), i)), lines, F.array(math))
    blocks = docs.select(i.alias("doc"), F.posexplode(said).alias("pos", "text"))
    blocks = blocks.select("doc", F.col("pos").cast("long").alias("pos"), F.when(F.col("pos") == 0, "title").otherwise("para").alias("kind"), "text", F.lit(None).cast("array<array<string>>").alias("cells"), F.lit(False).alias("right"))
    path = scratch(spark, "docx")
    office.write_docx(blocks, path, teacher="a & b", school="<c>")
    # A file's name has the document's number and which part of a long one it is.
    doc, part = (F.regexp_extract("path", r"/(-?\d+)-[0-9a-f]{12}(?:\.part-(\d+))?\.docx$", g) for g in (1, 2))
    before = F.coalesce(F.nullif(part, F.lit("")).cast("int"), F.lit(0)) * office.DOCX_BLOCKS
    return files.read_docx(office.written(spark, path)).select(doc.cast("long").alias("doc_id"), (F.col("pos") + before).alias("pos"), "text")


@query("""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS pos, [CAST(turn AS VARCHAR), role, regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), CAST(length(text) AS VARCHAR)] AS cells FROM conversations
    UNION ALL SELECT DISTINCT conv_id, 0, ['turn', 'role', 'text', 'n'] FROM conversations""")
def xlsx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a sheet, a turn a row."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc"), F.col("turn").alias("pos"), "turn", "role", "text", F.length("text").alias("n"))
    path = scratch(spark, "xlsx")
    office.write_xlsx(rows, path, sheet="turns")
    read = office.read_xlsx(office.written(spark, path))
    return read.select(F.regexp_extract("path", r"/(\d+)-[0-9a-f]{12}\.xlsx$", 1).cast("long").alias("conv_id"), "pos", "cells")


@query("""WITH t AS (SELECT *, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
    q AS (SELECT conv_id, k, max(text) FILTER (role = 'user') AS asked, arg_min(text, turn) FILTER (role = 'assistant') AS told FROM t GROUP BY 1, 2 HAVING k > 0),
    a AS (SELECT conv_id, k, 0 AS step, unnest(string_split('Câu ' || k || '. ' || asked, chr(10))) AS t, generate_subscripts(string_split(asked, chr(10)), 1) AS i FROM q),
    s AS (SELECT conv_id, k, 1 AS step, unnest(string_split('Lời giải: ' || told, chr(10))) AS t, generate_subscripts(string_split(told, chr(10)), 1) AS i FROM q WHERE told IS NOT NULL AND told <> ''),
    b AS (SELECT conv_id, 0 AS k, 0 AS step, 1 AS i, 'title' AS kind, 'Conversation ' || conv_id AS text FROM q WHERE k = 1
          UNION ALL SELECT conv_id, 0, 1, 1, 'heading', 'PHẦN I' FROM q WHERE k = 1
          UNION ALL SELECT conv_id, k, step, i, CASE WHEN step = 1 THEN 'solution' WHEN i = 1 THEN 'question' ELSE 'para' END, t FROM (SELECT * FROM a UNION ALL SELECT * FROM s) WHERE trim(t) <> '')
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k, step, i) - 1 AS pos, kind, text FROM b""")
def exported_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents: what the user says is a question, the first answer to it its solution."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    k = F.count_if(F.col("role") == "user").over(Window.partitionBy("conv_id").orderBy("turn"))
    q = c.withColumn("k", k).filter("k > 0").groupBy("conv_id", "k").agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("text"), F.min(F.when(F.col("role") == "assistant", F.struct("turn", "text")))["text"].alias("ai_solution"))
    made = F.array_sort(F.collect_list(F.struct(F.col("k").cast("int").alias("number"), "text", "ai_solution")))
    section = F.struct(F.lit(S.ESSAY).alias("type"), F.lit("PHẦN I").alias("label"), F.col("questions"))
    doc = F.to_json(F.struct(F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"), F.array(section).alias("sections")))
    trees = q.groupBy("conv_id").agg(made.alias("questions")).select(F.col("conv_id").alias("doc"), D.parse(doc).alias("tree"))
    return D.export_blocks(trees).select(F.col("doc").alias("conv_id"), "pos", "kind", "text")
