"""Column functions over lines: what they are made of, and odd blanks."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import exam as E
from folio.functions import text as T


def test_pieces_are_worked_out_once(spark):
    """A text is cut at its marks once, however often its pieces are looked at."""
    none = F.array().cast("array<string>")
    for c in (E.rescued(F.col("line"), none), E.split_options(F.col("line")), E.option_texts(F.col("line"))):
        plan = spark.createDataFrame([("A. x B. y",)], "line string").select(c.alias("c"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("sequence(") == 1


def test_options_of_lines_without_marks(spark):
    rows = spark.createDataFrame([(1, None), (2, "x"), (3, "q A. m B. n"), (4, "A. m"), (5, "C. m A. n"), (6, "")], "i int, line string")
    got = rows.select("i", E.rescued(F.col("line"), F.array().cast("array<string>")).alias("r"), E.split_options(F.col("line")).alias("s"), E.option_texts(F.col("line")).alias("o")).orderBy("i").collect()
    assert [(r["r"]["text"], r["r"]["options"]) for r in got] == [(None, []), ("x", []), ("q", ["A. m", "B. n"]), ("A. m", []), ("C. m A. n", []), ("", [])]
    assert [r["s"] for r in got] == [[None], ["x"], ["A. m", "B. n"], ["A. m"], ["C. m A. n"], [""]]
    assert [r["o"] for r in got] == [None, None, ["A. m", "B. n"], ["A. m"], ["C. m A. n"], None]


def test_strip_leaves_what_is_before_a_line_separator(spark):
    rows = spark.createDataFrame([("\t a \u2028",), (" \n\r\f b \t\n",)], "t string")
    assert [r[0] for r in rows.select(T.strip(F.col("t"))).collect()] == ["a \u2028", "b"]
