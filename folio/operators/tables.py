"""Runs of lines, and tables in Markdown and grids of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

OPTION_CELL = r"^\**[ \t]*\(?([A-D])\**[ \t]*\\?[.):]"
STATEMENT_CELL = r"^[ \t]*\**\(?[a-d][.)]"


def islands(rows: DataFrame, keys: Sequence[str], order: str, flag: Column) -> DataFrame:
    """The rows where flag holds, with `island`: equal for consecutive ones, `order` counting without gaps."""
    kept = rows.withColumn("__flag", flag).filter("__flag").drop("__flag")
    return kept.withColumn("island", F.col(order) - F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def pipe_cells(line: Column) -> Column:
    """The cells of a pipe-table line, trimmed."""
    inner = F.regexp_replace(T.strip(line), r"^\|+|\|+$", "")
    return F.transform(F.split(inner, r"\|"), T.strip)


def is_rule(line: Column) -> Column:
    return F.regexp_replace(T.strip(line), r"^\|+|\|+$", "").rlike(r"^[ \t:|\-]+$")


def block_cells(lines: Column) -> Column:
    """All cells of a block of pipe lines in reading order, rule lines left out."""
    return F.flatten(F.transform(F.filter(lines, lambda x: ~is_rule(x)), pipe_cells))


def is_true_false_rows(rows: Column) -> Column:
    """Whether rows of cells are a true-false question: a head with the two answers in the first two rows, or two rows
    or more that begin with a statement letter."""

    def head(r: Column) -> Column:
        cells = F.transform(r, lambda c: T.strip(F.coalesce(c, F.lit(""))))
        return (F.array_contains(cells, "Đ") | F.array_contains(cells, "Đúng")) & (F.array_contains(cells, "S") | F.array_contains(cells, "Sai"))

    letters = F.filter(rows, lambda r: F.coalesce(F.get(r, F.lit(0)).rlike(r"^[ \t]*\**[a-d][.)]"), F.lit(False)))
    return F.exists(F.slice(rows, 1, 2), head) | (F.size(letters) >= 2)


def true_false_lines(lines: Column) -> Column:
    """The first cells of a true-false table as lines, without rules and the head."""
    firsts = F.transform(lines, lambda x: F.get(pipe_cells(x), F.lit(0)))
    return F.filter(firsts, lambda c: (c != "") & ~F.replace(c, F.lit(" ")).rlike(r"^:?-{2,}:?$") & ~c.rlike(r"(?iu)^(Nội dung|Phát biểu|Nhận định|Phương án)[ \t]*$"))


def consecutive(letters: Column) -> Column:
    """Whether letters follow each other in the alphabet."""
    n = F.size(letters)
    pairs = F.when(n >= 2, F.zip_with(F.slice(letters, 1, F.greatest(n - 1, F.lit(1))), F.slice(letters, 2, F.greatest(n - 1, F.lit(1))), lambda a, b: F.ascii(b) == F.ascii(a) + 1)).otherwise(F.array().cast("array<boolean>"))
    return F.forall(pairs, lambda x: x)


def option_lines(lines: Column, option: str) -> Column:
    """A block's options in order if all its filled cells, two to four, are options with different consecutive letters; else null."""
    cells = F.filter(block_cells(lines), lambda c: c != "")
    letters = F.transform(cells, lambda c: F.regexp_extract(c, option, 1))
    pairs = F.array_sort(F.zip_with(letters, cells, lambda a, c: F.struct(a.alias("letter"), c.alias("cell"))))
    fits = F.size(cells).between(2, 4) & F.forall(letters, lambda x: x != "") & (F.size(F.array_distinct(letters)) == F.size(letters)) & consecutive(F.array_sort(letters))
    return F.when(fits, F.transform(pairs, lambda p: p["cell"]))


def table_kind(cells: Column, n_rows: Column, n_cols: Column) -> Column:
    """option, ds, data or plain, for cells in reading order: array of struct(text, images)."""
    text = lambda c: T.strip(F.coalesce(c["text"], F.lit("")))
    pictured = lambda c: F.coalesce(F.size(c["images"]), F.lit(0)) > 0
    with_text, with_image = F.filter(cells, lambda c: text(c) != ""), F.filter(cells, pictured)
    filled = F.filter(cells, lambda c: (text(c) != "") | pictured(c))
    letters = F.transform(with_text, lambda c: F.regexp_extract(text(c), OPTION_CELL, 1))
    grid = ((n_rows == 2) & (n_cols == 2)) | ((n_rows == 1) & n_cols.isin(2, 4)) | (n_rows.isin(2, 4) & (n_cols == 1))
    only_images = F.exists(filled, lambda c: text(c) == "")
    is_option = grid & F.size(filled).between(2, 4) & (F.size(letters) > 0) & F.forall(letters, lambda x: x != "") & (F.size(F.array_distinct(letters)) == F.size(letters)) & (~only_images | (F.size(letters) >= 2))
    rows = F.transform(F.sequence(F.lit(0), F.greatest(n_rows, F.lit(1)) - 1), lambda r: F.slice(F.transform(cells, text), r * n_cols + 1, F.greatest(n_cols, F.lit(1))))
    heads = F.exists(F.slice(rows, 1, 2), lambda r: (F.array_contains(r, "Đ") | F.array_contains(r, "Đúng")) & (F.array_contains(r, "S") | F.array_contains(r, "Sai")))
    statements = F.size(F.filter(rows, lambda r: F.coalesce(F.get(r, F.lit(0)).rlike(STATEMENT_CELL), F.lit(False)))) >= 2
    return (
        F.when((n_rows <= 0) | (n_cols <= 0) | (F.coalesce(F.size(cells), F.lit(0)) <= 0), "plain")
        .when(is_option, "option")
        .when(heads | statements, "ds")
        .when((n_rows >= 2) & (n_cols >= 2) & (F.size(with_text) >= 2) & (F.size(with_image) == 0), "data")
        .otherwise("plain")
    )


def option_cells(cells: Column) -> Column:
    """(letter, text, images) of an option table by letter; cells without a letter take the unused ones in order."""
    text = lambda c: T.strip(F.coalesce(c["text"], F.lit("")))
    found = F.transform(
        F.filter(cells, lambda c: (text(c) != "") | (F.coalesce(F.size(c["images"]), F.lit(0)) > 0)),
        lambda c: F.struct(F.regexp_extract(text(c), OPTION_CELL, 1).alias("letter"), T.strip(F.regexp_replace(text(c), OPTION_CELL, "")).alias("text"), F.coalesce(c["images"], F.array().cast("array<string>")).alias("images")),
    )
    spare = F.array_except(F.array(*map(F.lit, "ABCD")), F.transform(found, lambda f: f["letter"]))

    def named(f: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(found, 1, i), lambda g: g["letter"] == ""))
        letter = F.when(f["letter"] != "", f["letter"]).otherwise(F.coalesce(F.get(spare, before), F.lit("")))
        return F.struct(F.when(letter == "", "Z").otherwise(letter).alias("at"), i.alias("i"), letter.alias("letter"), f["text"].alias("text"), f["images"].alias("images"))

    return F.transform(F.array_sort(F.transform(found, named)), lambda f: F.struct(f["letter"].alias("letter"), f["text"].alias("text"), f["images"].alias("images")))


def is_figure_grid(cells: Column) -> Column:
    """Whether a detected table is a plot with a grid: many cells and few filled, or no cell with three letters or digits."""
    filled = F.filter(cells, lambda c: T.strip(F.coalesce(c, F.lit(""))) != "")
    wordy = F.filter(cells, lambda c: F.length(F.regexp_replace(F.coalesce(c, F.lit("")), f"[^{T.LETTER}0-9]", "")) >= 3)
    return (F.size(cells) > 0) & (((F.size(cells) >= 12) & (F.size(filled) <= 0.25 * F.size(cells))) | (F.size(wordy) == 0))
