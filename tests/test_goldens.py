"""Exact results of what SQL can't express, derived by hand from the rules."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.functions import exam, formatting, notation
from folio.functions import text as T
from folio.operators import anchors, boilerplate, reconcile, structure
from folio.plans import reconcile as plans
from folio.plans import runtime as runtime_plans
from folio.plans import structure as structure_plans


def column(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, s string").select("i", f(F.col("s")).alias("x"))
    return [r["x"] for r in rows.orderBy("i").collect()]


def test_norm_line(spark):
    assert column(spark, T.norm_line, ["  TAILIEUONTHI.NET  ", "Tài   Liệu", "Straße", None]) == ["tailieuonthi.net", "tài liệu", "strasse", None]


def test_meaningful_length(spark):
    got = column(spark, T.meaningful_length, ["", "![x](figures/a.png)", "<!-- p2w:page=3 -->\n---\n", "Câu 1. Một vật dao động", None])
    assert got[:3] == [0, 0, 0] and got[3] > 15 and got[4] == 0


def test_truncated(spark):
    cases = [("Câu 1. Vật dao động với biên độ 5 cm.", False), ("**A.** 30", False), ("| a | b |", False), ("## Năng lượng dao động", False), ("Một vật chuyển động thẳng đều với vận tốc ban đầu rất lớn và gia tốc", True), ("Ta có $v = 2", True), ("", False)]
    assert column(spark, T.looks_truncated, [c for c, _ in cases]) == [x for _, x in cases]


def test_size_check(spark):
    pages = spark.range(436).select(F.lit("d").alias("doc"), F.col("id").alias("page"), F.lit(True).alias("scan"))
    r = boilerplate.size_check(pages).first()
    assert (r["pages"], r["scan_pages"], r["large"], r["est_min"]) == (436, 436, True, 73)
    assert r["ranges"].split(",") == ["1-50", "51-100", "101-150", "151-200", "201-250", "251-300", "301-350", "351-400", "401-436"]
    assert not boilerplate.size_check(pages.filter("page BETWEEN 100 AND 149")).first()["large"]


def test_questions(spark):
    assert column(spark, exam.is_question, ["Câu 1. x", "câu 12: ", "2) cm.", "6 s.", "3. Tính quãng đường vật", "10 m/s là vận tốc", "CÂU 5", "", None]) == [True, True, False, False, True, False, False, False, False]
    assert column(spark, exam.question_number, ["Câu 12) y", "3. Tính quãng đường vật"]) == [12, 3]


def test_options(spark):
    assert column(spark, exam.split_options, ["A. x B. y C. z", "A. x C. y", "điểm B. rồi điểm A.", "**A.** m **B.** n", "(A) 1 (B) 2"]) == [["A. x", "B. y", "C. z"], ["A. x C. y"], ["điểm B. rồi điểm A."], ["A. m", "B. n"], ["A. 1", "B. 2"]]
    saved = lambda c: F.to_json(exam.rescued(c, F.array().cast("array<string>")))
    got = column(spark, saved, ["Hỏi A. 1 B. 2", "vậtA. 1 B. 2", "B. 1 C. 2"])
    assert got == ['{"text":"Hỏi","options":["A. 1","B. 2"]}', '{"text":"vậtA. 1 B. 2","options":[]}', '{"text":"B. 1 C. 2","options":[]}']


def test_parser(spark):
    rows = {(r["doc"], r["sec"], r["q"]): r for r in structure.parse(structure_plans.items(spark)).collect()}
    one = rows["d", 1, 1]
    assert (one["text"], one["options"], one["images"]) == ("Một vật dao động điều hoà với biên độ 4 cm.", ["A. 2 cm", "B. 4 cm", "C. 6 cm", "D. 8 cm"], ["p.png"])
    assert one["option_images"] == [["a.png"], ["b.png"], ["c.png"], ["d.png"]]
    two = rows["d", 1, 2]
    assert two["text"] == "Đơn vị của lực là gì được dùng trong hệ SI?\n| t | 1 | 2 |\n| x | 3 | 4 |\nhết bảng 2) cm." and two["options"] == ["A. N", "B. J", "C.", "D. W"]
    assert rows["d", 1, 3]["number"] == 3
    assert rows["d", 2, 1]["sub_items"] == ["a. Vật đứng yên.", "b. Vật chuyển động."]
    assert rows["t", 0, 1]["options"] == ["A.", "B."] and rows["t", 0, 1]["option_images"] == [["1.png"], ["2.png"]]


def test_empty_question_is_not_carried_over_a_header(spark):
    lines = ["Câu 5.", "PHẦN II. ĐÚNG SAI", "lời dẫn", "Câu 1. Xét chuyển động"]
    items = spark.createDataFrame([("x", i, t, [], None) for i, t in enumerate(lines)], structure.ITEMS)
    assert [(r["sec"], r["number"], r["text"]) for r in structure.parse(items).collect()] == [(1, 1, "Xét chuyển động")]


def test_no_section(spark):
    tree = {r["doc"]: r for r in structure.parsed_documents(structure_plans.items(spark)).collect()}
    assert tree["d"]["doc_type"] == "de_thi"
    assert tree["n"]["sections"][0]["intro"] == "chỉ có chữ không có câu"
    empty = spark.createDataFrame([("e", 0, "", [], None)], structure.ITEMS)
    assert structure.parsed_documents(empty).first()["sections"][0]["label"] == "Nội dung"


def test_markdown(spark):
    rows = {(r["doc"], r["sec"], r["q"]): r for r in structure_plans.markdown_parse(spark, "").collect()}
    assert rows["m", 1, 1]["text"] == "Vật rơi tự do." and rows["m", 1, 1]["options"] == ["A. 1 s", "B. 2 s", "C. 3 s", "D. 4 s"]
    assert rows["m", 1, 2]["options"] == ["A. 1", "B. 2", "C. 3", "D. 4"]
    assert rows["m", 2, 1]["sub_items"] == ["a) đúng", "b) sai"] and rows["m", 2, 1]["text"] == "Xét các phát biểu\n| t | 1 |\n| x | 2 |\nhết"


def test_docx(spark):
    rows = runtime_plans.docx_parsed(spark, "").orderBy("q").collect()
    assert [(r["number"], r["text"]) for r in rows] == [(1, "Tính vận tốc của vật rơi"), (2, "Tính gia tốc của vật này")]
    assert rows[0]["options"] == ["A. 1", "B. 2", "C. 3", "D. 4"] and rows[0]["images"] == ["image1.png"]


def test_overlap(spark):
    got = {r["doc"]: r["text"] for r in plans.overlap_fuzzy_dedupe(spark, "").collect()}
    assert got["a"] == "\n".join(plans.BOTTOM.split("\n")[4:])
    assert got["b"] == plans.BOTTOM
    top, bottom = "Ví dụ mở đầu của bài.\n# 4. Giao thoa\n> Hiệu đường đi bằng số nguyên lần bước sóng.", "### 4. Giao thoa\n> Hiệu đường đi bằng số nguyên lần bước sóng.\n> Vân sáng bậc hai nằm xa vân trung tâm hơn."
    assert reconcile.drop_overlap(spark.createDataFrame([("x", top, bottom)], "doc string, top string, bottom string")).first()["text"] == "> Vân sáng bậc hai nằm xa vân trung tâm hơn."


def test_overlap_of_short_lines_goes_by_neighbours(spark):
    rows = [("chain", "x\nmột hai\nba\nbốn dòng dài hơn mười hai chữ", "ba\nmột hai\nbốn dòng dài hơn mười hai chữ\nmột hai\nmới\nba\n8"), ("alone", "x\nba\ny", "ba\nmới\nnữa\n4\n5"), ("none", None, None), ("empty", "", "")]
    got = dict(map(tuple, reconcile.drop_overlap(spark.createDataFrame(rows, "doc string, top string, bottom string")).collect()))
    assert got == {"chain": "mới\nba\n8", "alone": "ba\nmới\nnữa\n4\n5", "none": None, "empty": ""}


def test_merge_sections(spark):
    rows = {(r["mode"], r["doc"], r["sec"]): (r["type"], r["questions"]) for r in plans.sections_merged(spark, "").collect()}
    assert rows["last", "d", 0] == ("trac_nghiem_lua_chon", "1=a|2=câu dài hơn|3=c|4=d")
    assert rows["none", "d", 0] == ("trac_nghiem_lua_chon", "1=a|2=ngắn|2=câu dài hơn|3=c|4=d")
    assert rows["any", "d", 1] == ("dung_sai", "1=e") and rows["any", "d", 2] == ("dung_sai", "1=f")


@pytest.mark.parametrize(
    ("raw", "want"),
    [('{"a": "x"}', '{"a": "x"}'), ('```json\n{"t": "$\\frac{1}{2}$"}\n```', '{"t": "$\\\\frac{1}{2}$"}'), ('x {"t": "\\alpha"} y', '{"t": "\\\\alpha"}'), ("none", None), ('{"a": ', None), (None, None), ("", None)],
)
def test_salvage(raw, want):
    assert reconcile.salvaged_json(raw) == want


def test_placed_figures(spark):
    got = {r["fig"]: (r["line"], r["how"]) for r in plans.placed_figures(spark, "").collect()}
    assert got == {1: (4, "anchor"), 2: (11, "question"), 3: (16, "height"), 4: (4, "height")}


def test_anchor_keys():
    assert anchors.keys_of("x = 5") == []
    assert anchors.keys_of("Lực từ tác dụng lên cạnh 3 của khung dây dẫn") == ["lực từ tác dụng lên cạnh", "lực từ tác dụng"]


@pytest.mark.parametrize(
    ("f", "given_text", "want"),
    [
        (notation.house_style, "1,0$cm^{2}$", "$1,0\\text{cm}^2$"),
        (notation.house_style, "2,0.$10^{5}$Pa", "$2,0.10^5\\text{Pa}$"),
        (notation.house_style, "g = $10\\text{m/s}^2$", "$g = 10\\text{m/s}^2$"),
        (notation.house_style, "25°C", "$25^\\circ\\text{C}$"),
        (notation.house_style, "$v = 5 m/s$", "$v = 5\\text{m/s}$"),
        (notation.house_style, "$2\\text{lít}$", "$2\\text{l}$"),
        (notation.house_style, "c = 0,460kJ/kg.K", "$c = 0,460\\text{kJ/kg.K}$"),
        (notation.house_style, "h = 20 A. 2 s B. 4 s", "h = 20 A. 2 s B. 4 s"),
        (notation.latex_to_plain, "\\frac{v_0^2}{2g}", "v₀²/2g"),
        (notation.latex_to_plain, "25^\\circ\\text{C}", "25°C"),
        (notation.latex_to_plain, "\\vec{F}", "F⃗"),
        (notation.latex_to_plain, "\\frac{a+b}{2}", "(a+b)/2"),
        (notation.unwrap_prose, "$$A. 15. B. 30. C. 32. D. 16.$$", "A. 15. B. 30. C. 32. D. 16."),
        (notation.unwrap_prose, "$f(a) = g(b)$", "$f(a) = g(b)$"),
        (notation.balanced, "$T_1 >$ T_0$", "$T_1 > T_0$"),
        (notation.balanced, "$v_0$ = 360 km/h$", "$v_0 = 360 km/h$"),
        (notation.normalize_latex, "nếu$x$thì", "nếu $x$ thì"),
        (notation.degree_zeros, "nung đến 350C", "nung đến 35°C"),
        (notation.degree_zeros, "lớp 10C, điện tích 200C", "lớp 10C, điện tích 200C"),
        (notation.unit_powers, "10 m/s2 và 3 cm3", "10 m/s² và 3 cm³"),
        (notation.scripts, "p 1 V 1 = p 2 V 2", "p₁ V₁ = p₂ V₂"),
        (notation.plain_accents, "$m_{đá} = 2$ và $đây là một câu văn$", "$m_{da} = 2$ và $đây là một câu văn$"),
        (notation.unicode_to_latex, "F⃗ và v₀", "$\\vec{F}$ và $v_{0}$"),
        (formatting.format_exam_text, "Hỏi A. 1 B. 2 C. 3 D. 4", "Hỏi\n**A.** 1\n**B.** 2\n**C.** 3\n**D.** 4"),
    ],
)
def test_notation(f, given_text, want):
    assert f(given_text) == want


PIECES = st.lists(st.sampled_from(["$", "$$", "x", " ", "\n", "10", "°C", "cm", "^{2}", "=", "A. ", "đá", "\\text{m}", ",", ".", "v", "5", "Pa"]), max_size=14).map("".join)


@settings(max_examples=150, deadline=None)
@given(PIECES)
def test_balanced_lines_have_even_dollars(s):
    for line in notation.balanced(s).split("\n"):
        assert line.replace("$$", "").count("$") % 2 == 0


@pytest.mark.parametrize("s", ["1,0$cm^{2}$", "2,0.$10^{5}$Pa", "25°C và 45°", "V = 3,3.10^{-3} m^3", "c = 0,460kJ/kg.K", "$v = 5 m/s$\nA. 2 s", "$$x = 2 lít$$"])
def test_house_style_twice(s):
    once = notation.house_style(s)
    assert notation.house_style(once) == once


def test_same_for_any_partitions(spark):
    f = notation.columns(notation.export_chain)
    rows = spark.createDataFrame([(i, f"v₀ = {i} m/s2") for i in range(40)], "i int, s string")
    one, many = (sorted(map(tuple, rows.repartition(n).select("i", f(F.col("s"))).collect())) for n in (1, 7))
    assert one == many


def test_places_of_missing_questions_read_a_section_once(spark):
    """What is known is carried on both ways; no frame reaches to the section's end, which is quadratic."""
    have = spark.range(0, 20, 4).selectExpr("'d' AS doc", "'t' AS type", "id AS number")
    others = spark.range(0, 20, 3).selectExpr("'d' AS doc", "'t' AS type", "id AS number", "repeat('x', 20) AS text")
    out = reconcile.missing_questions(have, others)
    assert "UnboundedFollowing" not in out._jdf.queryExecution().toString() and "unboundedfollowing" not in out._jdf.queryExecution().toString()
    assert sorted((r["number"], r["after"], r["before"]) for r in out.collect()) == [(3, 0, 4), (6, 4, 8), (9, 8, 12), (15, 12, 16), (18, 16, None)]
