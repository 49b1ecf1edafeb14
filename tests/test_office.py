"""Formulas as trees, DOCX and XLSX files, and the commit of what tasks write."""

from __future__ import annotations

import io
import json
import zipfile
from xml.etree import ElementTree as ET

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.functions import office_math as M
from folio.operators import documents as D
from folio.sources import files, office

X, Y = ("id", "x"), ("id", "y")
TREES = [
    (r"x^2+y_1", ("row", ("script", X, None, ("num", "2")), ("op", "+"), ("script", Y, ("num", "1"), None))),
    (r"\frac12", ("frac", ("num", "1"), ("num", "2"))),
    (r"\frac{x}{\sqrt[3]{y}}", ("frac", X, ("root", Y, ("num", "3")))),
    (r"\vec{x}=\overline{y}", ("row", ("accent", "⃗", X), ("op", "="), ("line", "top", Y))),
    (r"\left(\dfrac{x}{y}\right]", ("fence", "(", "]", ("frac", X, Y))),
    (r"\sum_{x=1}^{2}y", ("big", "∑", ("row", X, ("op", "="), ("num", "1")), ("num", "2"), Y)),
    (r"\int x", ("big", "∫", None, None, X)),
    (r"5\,\text{m/s}", ("row", ("num", "5"), ("space",), ("text", "m/s"))),
    (r"x''", ("script", X, None, ("op", "′′"))),
    (r"\begin{cases}x & 1\\ y & 2\end{cases}", ("table", "{", "", ("row", X, ("num", "1")), ("row", Y, ("num", "2")))),
    (r"\sin\alpha", ("row", ("name", "sin"), ("id", "α"))),
    (r"1,5x", ("row", ("num", "1,5"), X)),
    (r"^{14}_{6}C", ("row", ("script", ("row",), ("num", "6"), ("num", "14")), ("id", "C"))),
]
NONE = ["", " ", None, r"\odd{x}", r"\frac{x}", "x_{1", "x^2^3", "}", r"\left(x", r"\begin{cases}x\end{matrix}", "{" * 200 + "x" + "}" * 200, "x&y", "50%"]


@pytest.mark.parametrize(("latex", "tree"), TREES)
def test_trees(latex, tree):
    assert M.formula(latex) == tree
    assert M.formula(M.latex_of(M.office_math(tree))) == tree
    ET.fromstring(M.mathml(tree))


@pytest.mark.parametrize("latex", NONE)
def test_what_is_no_formula(latex):
    assert M.formula(latex) is None


def test_mathml():
    assert M.mathml(M.formula(r"\frac{x}{2}")) == '<math xmlns="http://www.w3.org/1998/Math/MathML"><mfrac><mi>x</mi><mn>2</mn></mfrac></math>'
    assert M.mathml(M.formula(r"\sqrt{x}_1")) == '<math xmlns="http://www.w3.org/1998/Math/MathML"><msub><msqrt><mi>x</mi></msqrt><mn>1</mn></msub></math>'


def test_office_math():
    got = ET.tostring(M.office_math(M.formula("x^2")), encoding="unicode")
    space = 'xml:space="preserve"'
    assert got == f'<m:oMath xmlns:m="{M.OFFICE}"><m:sSup><m:e><m:r><m:t {space}>x</m:t></m:r></m:e><m:sup><m:r><m:t {space}>2</m:t></m:r></m:sup></m:sSup></m:oMath>'


leaves = st.sampled_from([("num", "12"), X, ("id", "α"), ("op", "+"), ("name", "cos"), ("text", "m/s"), ("space",), ("op", "≤"), ("num", "0,5")])


def grown(of):
    some = st.one_of(of, st.lists(of, min_size=2, max_size=3).map(lambda x: ("row", *x)).map(flat))
    return st.one_of(
        st.tuples(st.just("frac"), some, some), st.tuples(st.just("root"), some, st.none() | some), st.tuples(st.just("accent"), st.just("⃗"), some),
        st.tuples(st.just("fence"), st.sampled_from("(["), st.sampled_from(")]"), some), st.tuples(st.just("line"), st.sampled_from(["top", "bot"]), some),
        st.tuples(st.just("script"), of, some, some), st.tuples(st.just("script"), of, st.none(), some),
    )


def flat(n):
    """Rows within rows, and numbers or spaces side by side, read as one."""
    out = []
    for x in n[1:]:
        out += x[1:] if x[0] == "row" else [x]
    out = [x for a, x in zip([None, *out], out, strict=False) if not (a and a[0] == x[0] == "num")]
    return out[0] if len(out) == 1 else ("row", *out)


@settings(max_examples=150, deadline=None)
@given(st.recursive(leaves, grown, max_leaves=8))
def test_any_tree_comes_back(tree):
    assert M.formula(M.latex_of(M.office_math(tree))) == tree


TREE = {"title": "Đề 1", "sections": [{"type": "trac_nghiem_lua_chon", "label": "PHẦN I", "intro": "Read.\n\nThen answer.", "questions": [
    {"number": 1, "text": "What is $x^2$?\nSay **it**.", "options": ["A. $1$", "B. 2 & <3>"], "correct_answer": "b", "ai_solution": "Since\nso"},
    {"number": 2, "text": None, "sub_items": ["a) so", "b) not"], "ai_solution": "a) Đúng, b) Sai", "show_solution": True}, {"number": 3, "text": "hidden", "ai_solution": "no", "show_solution": False}]}]}
BLOCKS = [
    ("title", "Đề 1", False), ("heading", "PHẦN I", False), ("para", "Read.", False), ("para", "Then answer.", False), ("question", "Câu 1. What is $x^2$?", False), ("para", "Say **it**.", False),
    ("option", "A. $1$", False), ("option", "B. 2 & <3>", True), ("solution", "Lời giải: Since", False), ("solution", "so", False), ("question", "Câu 2. ", False), ("sub", "a) so", True), ("sub", "b) not", False),
    ("solution", "Lời giải: a) Đúng, b) Sai", False), ("question", "Câu 3. hidden", False),
]


@pytest.fixture(scope="module")
def blocks(spark):
    trees = spark.createDataFrame([("e/1", json.dumps(TREE)), ("none", "{}"), ("e?1", json.dumps({"title": "other"}))], "doc string, json string")
    return D.export_blocks(trees.select("doc", D.parse(F.col("json")).alias("tree")))


def test_blocks(blocks):
    got = [tuple(r)[2:4] + (r["right"],) for r in blocks.filter("doc = 'e/1'").orderBy("pos").collect()]
    assert got == BLOCKS
    assert [tuple(r) for r in blocks.filter("doc = 'none'").collect()] == [("none", 0, "title", "", None, False)]
    plain = D.export_blocks(blocks.sparkSession.createDataFrame([("d", json.dumps(TREE))], "doc string, json string").select("doc", D.parse(F.col("json")).alias("tree")), show_solutions=False)
    assert plain.filter("right OR kind = 'solution'").count() == 0


def test_docx(spark, blocks, tmp_path):
    path = str(tmp_path / "out")
    grid = spark.createDataFrame([("t", 0, "table", None, [["a", "b $y$"], ["c"]], False), (None, 0, "para", "lost", None, False)], office.BLOCKS)
    office.write_docx(blocks.unionByName(grid), path, teacher="T", school="S")
    found = list((tmp_path / "out").rglob("*.docx"))
    assert len(found) == 4 and (tmp_path / "out" / "_SUCCESS").exists() and not list((tmp_path / "out").glob("_staging*"))
    rows = files.read_docx(files.files(spark, path).filter(F.col("path").endswith(".docx"))).collect()
    mine = sorted((r["pos"], r["text"]) for r in rows if "/e_1-" in r["path"] and len([x for x in rows if x["path"] == r["path"]]) > 1)
    assert mine == [(i, t.replace("x^2", "x^{2}").replace("**", "").strip()) for i, (_, t, _) in enumerate(BLOCKS)]
    cells = next(r["cells"] for r in rows if r["kind"] == "tbl")
    assert [c["text"] for c in cells] == ["a", "b $y$", "c", ""]
    whole = next(f for f in found if zipfile.ZipFile(f).read("word/document.xml").count(b"<w:p>") > 10)
    xml = zipfile.ZipFile(whole).read("word/document.xml").decode()
    assert '<w:u w:val="single"/></w:rPr><w:t xml:space="preserve">B.</w:t>' in xml and "<m:sSup>" in xml and "<w:b/>" in xml and 'w:fill="EBF4FF"' in xml
    assert b">T<" in zipfile.ZipFile(whole).read("word/header1.xml")
    for name in zipfile.ZipFile(whole).namelist():
        ET.fromstring(zipfile.ZipFile(whole).read(name))


def test_long_documents_go_to_parts(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(25).select(F.lit("long").alias("doc"), F.col("id").alias("pos"), F.lit("para").alias("kind"), F.concat(F.lit("line "), F.col("id")).alias("text"), F.lit(None).cast("array<array<string>>").alias("cells"), F.lit(False).alias("right"))
    office.write_docx(rows, path, size=10)
    names = sorted(f.name.partition(".")[2] for f in (tmp_path / "out").rglob("*.docx"))
    assert names == ["docx", "part-00001.docx", "part-00002.docx"]
    read = files.read_docx(files.files(spark, path).filter(F.col("path").endswith(".docx"))).collect()
    assert sorted(int(r["text"].split()[1]) for r in read) == list(range(25))


def test_xlsx(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [("a", 0, 1, "x < & y", 0.5, None), ("a", 1, None, "\x01two\nlines", float("nan"), True), ("b", 0, -3, "", 1e300, False)]
    df = spark.createDataFrame(rows, "doc string, pos long, n int, t string, d double, flag boolean")
    office.write_xlsx(df, path, sheet="a&b")
    got = office.read_xlsx(files.files(spark, path).filter(F.col("path").endswith(".xlsx"))).collect()
    by = {(r["path"].rsplit("/", 1)[-1][0], r["pos"]): r["cells"] for r in got}
    assert by["a", 0] == by["b", 0] == ["n", "t", "d", "flag"]
    assert by["a", 1] == ["1", "x < & y", "0.5", None] and by["a", 2] == [None, "two\nlines", None, "true"] and by["b", 1] == ["-3", "", "1.0E300", "false"]
    office.write_xlsx(df.filter("doc = 'b'"), path, mode="overwrite")
    assert len(list((tmp_path / "out").rglob("*.xlsx"))) == 1


def test_nothing_to_write(spark, tmp_path):
    office.write_docx(spark.createDataFrame([], office.BLOCKS), str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["_SUCCESS"]


def test_only_committed_attempts_stay(tmp_path):
    """A second attempt of a task gives the same bytes; the one that isn't committed leaves nothing, and no more does a failed job."""
    rows = [{"doc": "d", "part": 0, "pos": i, "kind": "para", "text": f"p{i}", "cells": None, "right": False} for i in range(3)]
    schema = pa.schema([("doc", pa.string()), ("part", pa.int32()), ("pos", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("cells", pa.list_(pa.list_(pa.string()))), ("right", pa.bool_())])
    batch = pa.RecordBatch.from_pylist(rows, schema=schema)
    writer = office.OfficeWriter({"path": str(tmp_path / "out"), "kind": "docx"}, False)
    first, second = writer.write(iter([batch])), writer.write(iter([batch]))
    made = [f.read_bytes() for f in (tmp_path / "out").rglob("*.docx")]
    assert len(made) == 2 and made[0] == made[1] and first != second
    writer.commit([second, None])
    assert [f.parent.name for f in (tmp_path / "out").rglob("*.docx")] == [second.folder]
    failed = office.OfficeWriter({"path": str(tmp_path / "out"), "kind": "docx"}, False)
    with pytest.raises(KeyError):
        failed.write(iter([batch.drop_columns(["text"])]))
    failed.abort([])
    assert len(list((tmp_path / "out").rglob("*.docx"))) == 1 and not list((tmp_path / "out").glob("_staging*"))


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    bad = spark.range(10).select(F.lit("d").alias("doc"), F.col("id").alias("pos"), F.lit("para").alias("kind"), F.when(F.col("id") == 7, F.raise_error(F.lit("stop"))).otherwise("x").alias("text"), F.lit(None).cast("array<array<string>>").alias("cells"), F.lit(False).alias("right"))
    with pytest.raises(Exception, match="stop"):
        office.write_docx(bad, str(tmp_path / "out"))
    assert not list((tmp_path / "out").rglob("*.docx")) and not (tmp_path / "out" / "_SUCCESS").exists()


def test_text_that_xml_cannot_hold():
    out = io.BytesIO()
    z = office.docx_file(out, {})
    z.write(office.paragraph("para", "a\x00b\x0bc￾ <tag> \ud800"))
    z.close()
    assert [b[2] for b in files.docx_blocks(out.getvalue())] == ["abc <tag>"]


def test_files_are_read_a_folder_a_task(spark, tmp_path):
    """A task reads what a task wrote, however many files that are; folders of jobs that aren't committed are left out."""
    path = str(tmp_path / "out")
    rows = spark.range(900).selectExpr("CAST(id % 300 AS STRING) AS doc", "id DIV 300 AS pos", "'para' AS kind", "CONCAT('p', id) AS text", "CAST(NULL AS ARRAY<ARRAY<STRING>>) AS cells", "FALSE AS right")
    office.write_docx(rows, path)
    folders = [f for f in (tmp_path / "out").iterdir() if f.is_dir()]
    (tmp_path / "out" / "_staging-x" / "part-0").mkdir(parents=True)
    (tmp_path / "out" / "_staging-x" / "part-0" / "a.docx").write_bytes(b"no")
    found = office.written(spark, path)
    assert found.rdd.getNumPartitions() == len(folders) <= 4
    assert sorted(r["text"] for r in files.read_docx(found).collect()) == sorted(f"p{i}" for i in range(900))
    assert found.count() == 300
    office.write_docx(rows.limit(0), str(tmp_path / "none"))
    assert office.written(spark, str(tmp_path / "none")).count() == 0


def test_a_document_of_several_files_comes_back(spark, tmp_path):
    from folio.plans.office import docx_round_trip

    n = office.DOCX_BLOCKS + 5
    rows = [(-7, "\n".join(f"l{i}" for i in range(n)), 9), (8, "one", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["pos"]): r["text"] for r in docx_round_trip(spark, str(tmp_path)).collect()}
    assert len(got) == n + 2 + 3 and got[-7, 0] == "D-7" and got[8, 1] == "one"
    assert all(got[-7, i + 1] == f"l{i}" for i in range(n)) and got[-7, n + 1].startswith("$\\frac{-7}")
