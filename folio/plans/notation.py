"""Queries over math notation and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formatting as L
from ..functions import notation as N
from ..functions import text as T
from .lines import STRIP
from .registry import Derived, query, table

EXAMPLES = [
    "1,0$cm^{2}$", "2,0.$10^{5}$Pa", "g = $10\\text{m/s}^2$", "25°C", "$v = 5 m/s$", "$2\\text{lít}$", "c = 0,460kJ/kg.K", "$$A. 15. B. 30. C. 32. D. 16.$$", "$f(a) = g(b)$", "$T_1 >$ T_0$", "F⃗ và v₀ x² α",
    "đun nóng đến 350C", "lớp 10C", "nếu$x$thì \\(y\\)", "\\frac{v_0^2}{2g}", "\\sqrt{2gh}", "$m_{đá} = 2$", "p 1 V 1 = p 2 V 2", "3,3.10−3 m3", "", None]


def _examples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(EXAMPLES)), "i int, s string")


@query()
def notation_house_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examples(spark).select("i", N.columns(N.house_style)(F.col("s")).alias("out"))


@query()
def notation_from_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examples(spark).select("i", N.columns(N.unicode_to_latex)(F.col("s")).alias("out"))


@query()
def notation_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examples(spark).select("i", N.columns(N.normalize_latex)(F.col("s")).alias("out"), N.columns(N.unwrap_prose)(F.col("s")).alias("unwrapped"), N.columns(N.balanced)(F.col("s")).alias("balanced"))


@query()
def notation_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examples(spark).select("i", N.columns(N.latex_to_plain)(F.col("s")).alias("out"), N.columns(N.plain_if_latex)(F.col("s")).alias("if_latex"), N.columns(N.plain_accents)(F.col("s")).alias("bare"), N.columns(N.unit_words)(F.col("s")).alias("units"))


@query()
def notation_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = lambda f: N.columns(lambda x: x and f(x))(F.col("s"))
    return _examples(spark).select("i", fixed(N.unit_powers).alias("powers"), fixed(N.degree_zeros).alias("degrees"), fixed(N.scripts).alias("scripts"))


@query()
def documents_export_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the export chain; dollars are paired on every line afterwards."""
    out = table(spark, sf_dir, "documents").select("doc_id", N.columns(N.export_chain)(F.col("text")).alias("out"))
    return out.select("doc_id", F.length("out").alias("n"), T.dollars(F.col("out")).alias("dollars"))


MATHS = Derived("maths", "documents", "i long, s string", ["doc_id", "CASE doc_id % 7 WHEN 0 THEN concat('a ', chr(92), 'frac{', n_chars, '}') WHEN 1 THEN concat('x^', n_chars) WHEN 2 THEN concat('x^{', n_chars, '}') WHEN 3 THEN concat(chr(92), '(', lang, chr(92), ')') WHEN 4 THEN NULL WHEN 5 THEN lang ELSE concat('a_{', lang, '} $c$') END"])


@query(f"WITH {MATHS.cte} SELECT i, coalesce(regexp_matches(s, '\\\\[A-Za-z]{{2,}}|\\\\[\\[\\]()]|[\\^_]\\{{'), FALSE) AS latex FROM maths")
def has_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MATHS.df(spark, sf_dir).select("i", F.coalesce(F.col("s").rlike(r"\\[A-Za-z]{2,}|\\[\[\]()]|[\^_]\{"), F.lit(False)).alias("latex"))


EXPRESSIONS = Derived("ex", "documents", "i long, s string", ["doc_id", "CASE doc_id % 4 WHEN 0 THEN concat(' ', lang, ' ', chr(10), ' b ') WHEN 1 THEN concat('**', lang, '** = *', n_chars, '*') WHEN 2 THEN concat('p   ', n_chars) ELSE '' END"])


@query(f"WITH {EXPRESSIONS.cte} SELECT i, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(s, '[ \\t]*\\n[ \\t]*', ' ', 'g'), '\\*\\*([^*]+?)\\*\\*', '\\1', 'g'), '\\*([^*]+?)\\*', '\\1', 'g')), '[ \\t]{{2,}}', ' ', 'g') AS s FROM ex")
def clean_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EXPRESSIONS.df(spark, sf_dir).select("i", N.columns(N.clean_expression)(F.col("s")).alias("s"))


LAYOUT = [
    "- A. một\n* **B.** hai\n1. A. ba\n• a) bốn\n- năm", "| Câu 1. Hỏi gì A. 1 B. 2 C. 3 D. 4 Câu 2. Tiếp", "4 , 5 m\n.\nPHẦN I a) m b) n c) p d) q", "không có gì", None]


@query()
def layout_bold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(LAYOUT)), "i int, s string")
    return rows.select("i", N.columns(L.strip_answer_bullets)(F.col("s")).alias("bullets"), N.columns(L.bold_labels)(F.col("s")).alias("bold"), N.columns(L.format_exam_text)(F.col("s")).alias("question"))


@query("SELECT doc_id, md5('![x](b.png) ' || coalesce(text, '')) AS h FROM documents")
def large_images_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.concat(F.lit("![](figures/a.png)![x](b.png) "), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(L.drop_large_images(md, F.array(F.lit("a.png"), F.lit("c.png")))).alias("h"))


FENCES = Derived("fences", "documents", "i long, s string", ["doc_id", "CASE doc_id % 5 WHEN 0 THEN concat('```markdown', chr(10), '# ', lang, chr(10), n_chars, chr(10), '```') WHEN 1 THEN concat('```', chr(10), lang, chr(10), '```') WHEN 2 THEN concat('no fence ', lang) WHEN 3 THEN NULL ELSE concat('```js', chr(10), lang, chr(10), '```') END"])


@query(f"WITH {FENCES.cte}, s AS (SELECT i, {STRIP.format("coalesce(s, '')")} AS s FROM fences) SELECT i, CASE WHEN regexp_matches(s, '(?s)^```(markdown|md)?[ \\t\\n\\r\\f]*\\n.*```$') THEN trim(regexp_replace(s, '(?s)^```(markdown|md)?[ \\t\\n\\r\\f]*\\n(.*?)\\n?```$', '\\2'), chr(10)) ELSE s END AS s FROM s")
def fences_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FENCES.df(spark, sf_dir).select("i", T.strip_fence(F.col("s")).alias("s"))


NAMES = Derived("file_names", "documents", "i long, s string", ["doc_id", "CASE doc_id % 5 WHEN 0 THEN concat('dir/Đề thi (', doc_id, ').pdf') WHEN 1 THEN '???.docx' WHEN 2 THEN concat(lang, '_b-', n_chars, '.PDF') WHEN 3 THEN concat(repeat('x', 100), doc_id, '.pdf') ELSE concat('noext', doc_id) END"])


@query(f"WITH {NAMES.cte}, s AS (SELECT i, s, trim(regexp_replace(regexp_replace(string_split(s, '/')[-1], '(.)\\.[^.]*$', '\\1'), '[^A-Za-zÀ-ÖØ-öø-ɏΑ-ωḀ-ỿ0-9 _-]', '', 'g')) AS k FROM file_names) SELECT i, CASE WHEN k = '' THEN 'TaiLieu' ELSE substr(k, 1, 80) END AS stem, lower(regexp_extract(s, '\\.([^.]*)$', 1)) AS ext, lower(regexp_extract(s, '\\.([^.]*)$', 1)) IN ('pdf', 'docx', 'doc') AS allowed FROM s")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import allowed

    return NAMES.df(spark, sf_dir).select("i", T.safe_stem(F.col("s")).alias("stem"), T.extension(F.col("s")).alias("ext"), allowed(F.col("s")).alias("allowed"))


@query("SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS x FROM documents")
def xml_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.xml_escape(F.col("text")).alias("x"))


@query("SELECT * FROM (VALUES (1, 'a &lt;b&gt; $x<y &amp; z$ &quot;c&quot;'), (2, '&amp; $ &lt;'), (3, '$a$')) t(i, x)")
def html_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(1, 'a <b> $x<y & z$ "c"'), (2, "& $ <"), (3, "$a$")], "i int, s string").select("i", T.html_escape(F.col("s")).alias("x"))


@query("SELECT * FROM (VALUES (1, 'lời giải'), (2, 'x'), (3, 'chỉ chữ')) t(i, s)")
def cleaned_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, 5, "<think>a\nb</think> [CÂU 5]: lời giải"), (2, 3, "**[câu 9]**: x"), (3, 1, "chỉ chữ")]
    return spark.createDataFrame(rows, "i int, n int, s string").select("i", T.after_answer_marker(F.col("s"), F.col("n")).alias("s"))


#: Formulas as documents have them, @ standing for a number of the document's, and what becomes of them, worked out by hand.
PLANTED = {
    "house_style": [
        ("@,0$cm^{2}$", "$@,0\\text{cm}^2$"), ("@,0.$10^{5}$Pa", "$@,0.10^5\\text{Pa}$"), ("g = $@\\text{m/s}^2$", "$g = @\\text{m/s}^2$"), ("@°C", "$@^\\circ\\text{C}$"), ("$v = @ m/s$", "$v = @\\text{m/s}$"),
        ("$@\\text{lít}$", "$@\\text{l}$"), ("c = @,460kJ/kg.K", "$c = @,460\\text{kJ/kg.K}$"), ("h = @ A. 2 s B. 4 s", "h = @ A. 2 s B. 4 s")],
    "latex_to_plain": [("\\frac{v_0^2}{@g}", "v₀²/@g"), ("@^\\circ\\text{C}", "@°C"), ("\\frac{a+b}{@}", "(a+b)/@")],
    "normalize_latex": [("nếu$x_{@}$thì", "nếu $x_{@}$ thì"), ("a \\(@y\\) b", "a $@y$ b")],
    "unicode_to_latex": [("F⃗ và v₀ và @", "$\\vec{F}$ và $v_{0}$ và @")],
    "plain_accents": [("$m_{đá} = @$ và chữ", "$m_{da} = @$ và chữ")],
    "unwrap_prose": [("$$A. @. B. 30. C. 32. D. 16.$$", "A. @. B. 30. C. 32. D. 16."), ("$f(@) = g(b)$", "$f(@) = g(b)$")],
    "balanced": [("$T_@ >$ T_0$", "$T_@ > T_0$"), ("$v_0$ = @ km/h$", "$v_0 = @ km/h$")],
    "unit_powers": [("@ m/s2 và 3 cm3", "@ m/s² và 3 cm³")],
    "scripts": [("p 1 V 1 = @", "p₁ V₁ = @")],
    "export_chain": [("v = @ m/s² và 25°C", "$v = @\\text{m/s}^2$ và $25^\\circ\\text{C}$")],
}
_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_planted = ", ".join(f"({_quoted(f)}, {k}, {_quoted(want)})" for f, pairs in PLANTED.items() for k, (_, want) in enumerate(pairs))


@query(f"SELECT doc_id, f, k, replace(want, '@', CAST(doc_id % 90 + 10 AS VARCHAR)) AS out FROM documents, (VALUES {_planted}) t(f, k, want)")
def notation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rewriting step over formulas with a number of each document in them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 90 + 10).cast("string").alias("number"))
    out = None
    for name, pairs in PLANTED.items():
        given = F.posexplode(F.array(*[F.replace(F.lit(s), F.lit("@"), F.col("number")) for s, _ in pairs])).alias("k", "s")
        rows = docs.select("doc_id", given).select("doc_id", F.lit(name).alias("f"), "k", N.columns(getattr(N, name))(F.col("s")).alias("out"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""WITH b AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents), l AS (SELECT doc_id, unnest(parts) AS t, generate_subscripts(parts, 1) AS i FROM b),
    s AS (SELECT doc_id, i, CASE i % 6 WHEN 0 THEN 'x_' || chr(123) || i || chr(125) || t WHEN 1 THEN t || '\\frac' WHEN 2 THEN '\\(' || t WHEN 3 THEN t || '^2' ELSE t END AS s FROM l)
    SELECT doc_id, i, coalesce(regexp_matches(s, '\\\\[A-Za-z]{{2,}}|\\\\[\\[\\]()]|[\\^_]\\{{'), FALSE) AS latex FROM s""")
def has_latex_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, with commands and scripts in some."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "t"))
    i = (F.col("k") + 1).cast("long")
    s = F.when(i % 6 == 0, F.concat(F.lit("x_{"), i.cast("string"), F.lit("}"), "t")).when(i % 6 == 1, F.concat("t", F.lit("\\frac"))).when(i % 6 == 2, F.concat(F.lit("\\("), "t")).when(i % 6 == 3, F.concat("t", F.lit("^2"))).otherwise(F.col("t"))
    return lines.select("doc_id", i.alias("i"), N.columns(N.has_latex, "boolean")(s).alias("latex"))
