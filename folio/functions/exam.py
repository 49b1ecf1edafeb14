"""Column functions that classify and split the lines of exam papers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from . import text as T

# How headers of each kind of section are written, the special kinds before the general one.
SECTION_WORDS = [
    (S.TRUE_FALSE, r"ph[àầa]n[ \t]*ii[^i]|[dđ][úuu]ng[ \t]*[–—-][ \t]*sai|[dđ][úuu]ng[ \t]*sai|dung[ \t]*[-–][ \t]*sai|dung[ \t]*sai"),
    (S.SHORT_ANSWER, r"ph[àầa]n[ \t]*iii|tr[ảaa][ \t]*l[oờo]i[ \t]*ng[aắa]n|[dđ][eềe][nne][ \t]*s[oốo]|tra[ \t]*loi[ \t]*ngan"),
    (S.ESSAY, r"ph[àầa]n[ \t]*iv|t[ựuu][ \t]*lu[aậa]n|tu[ \t]*luan"),
    (S.THEORY, r"l[yýy][ \t]*thuy[eếe]t|ki[eếe]n[ \t]*th[uứu]c[ \t]*c[oơo][ \t]*b[aảa]n|t[oóo]m[ \t]*t[aắa]t|ly[ \t]*thuyet"),
    (S.MULTIPLE_CHOICE, r"ph[àầa]n[ \t]*i[^iv]|tr[áắa]c[ \t]*nghi[eệe]m"),
]
HEADER_MAX = 120
#: The mark before an option: a letter from A to D, perhaps bold or in brackets, and a sign.
MARK = r"\*{0,2}\(?([A-D])\*{0,2}(?:\)|[ \t]*\\?[.):\-])\*{0,2}"
OPTION = "^" + MARK + r"\s*((?s).*)"
SUB_ITEM = r"^([a-d])\s*\\?[.)]\s*((?s).+)"
#: A question: the word and a number, or a bare number with a dot or bracket and a letter behind.
QUESTION = r"(?iu)^(?=c[aâ]u\s*[0-9]|[0-9]+\s*[.)]\s*\S)(?:c[aâ]u\s*)?([0-9]+)\s*[.):\s]\s*((?s).*)"
PREFIXED = r"(?iu)^\s*c[aâ]u\s*[0-9]"
#: Stands for a mark while a text is cut at marks.
CUT = "\x01"


def section_type(line: Column) -> Column:
    """The kind of section that a header names, or null."""
    kind = F.lit(None).cast("string")
    for name, words in reversed(SECTION_WORDS):
        kind = F.when(line.rlike("(?iu)" + words), F.lit(name)).otherwise(kind)
    return kind


def is_question(line: Column) -> Column:
    """Whether a line opens a question. Without the word, a number must stand before a real sentence: 12 characters or
    more that don't begin with a small letter."""
    rest = T.strip(F.regexp_replace(F.regexp_extract(line, QUESTION, 2), r"^[*_ ]+", ""))
    return F.coalesce(line.rlike(QUESTION) & (line.rlike(PREFIXED) | ((F.length(rest) >= 12) & ~rest.rlike(r"^\p{Ll}"))), F.lit(False))


def question_number(line: Column) -> Column:
    return F.when(is_question(line), F.regexp_extract(line, QUESTION, 1).try_cast("int"))


def question_text(line: Column) -> Column:
    return F.when(is_question(line), T.strip(F.regexp_extract(line, QUESTION, 2)))


def clean_option(text: Column) -> Column:
    """An option's text, or '' if it is nothing but punctuation."""
    stripped = T.strip(F.coalesce(text, F.lit("")))
    return F.when(stripped.rlike(r"^[\s.:;,\-–_]*$"), "").otherwise(stripped)


def _pieces(line: Column) -> Column:
    """(letter, text) for each mark of a line, each text up to the next mark."""
    cut = F.slice(F.split(F.regexp_replace(line, MARK, f"{CUT}$1{CUT}"), CUT), 2, F.lit(1 << 20))
    pairs = F.sequence(F.lit(1), F.greatest(F.size(cut) / 2, F.lit(1)).cast("int"))
    return F.when(F.size(cut) >= 2, F.transform(pairs, lambda i: F.struct(F.get(cut, 2 * i - 2).alias("letter"), T.strip(F.get(cut, 2 * i - 1)).alias("text")))).otherwise(F.array().cast("array<struct<letter:string,text:string>>"))


def _ascending(pieces: Column) -> Column:
    from ..operators.tables import consecutive

    return consecutive(F.transform(pieces, lambda p: p["letter"]))


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f has it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _named(pieces: Column) -> Column:
    return F.transform(pieces, lambda x: F.concat(x["letter"], F.lit(". "), x["text"]))


def split_options(line: Column) -> Column:
    """'A. x B. y' as ['A. x', 'B. y'] if there are two marks or more with letters in a row; else the line alone."""
    return F.when(line.rlike(MARK), _once(_pieces(line), lambda p: F.when((F.size(p) >= 2) & _ascending(p), _named(p)).otherwise(F.array(line)))).otherwise(F.array(line))


def rescued(text: Column, options: Column) -> Column:
    """struct(text, options): options that a text without options has swallowed, from an A at its start or behind a blank on."""
    kept = F.struct(text.alias("text"), F.coalesce(options, F.array().cast("array<string>")).alias("options"))
    head = F.element_at(F.split(F.regexp_replace(text, "^((?s).*?)" + MARK, f"$1{CUT}$2"), CUT, 2), 1)

    def saved(p: Column, h: Column) -> Column:
        fits = (F.size(p) >= 2) & (F.get(p, F.lit(0))["letter"] == "A") & _ascending(p) & ((h == "") | h.rlike(r"\s$"))
        return F.when(F.coalesce(fits, F.lit(False)), F.struct(F.regexp_replace(h, r"\s+$", "").alias("text"), _named(p).alias("options"))).otherwise(kept)

    may = (F.coalesce(F.size(options), F.lit(0)) < 2) & text.rlike(MARK)
    return F.when(may, _once(F.struct(_pieces(text).alias("p"), head.alias("h")), lambda x: saved(x["p"], x["h"]))).otherwise(kept)


def option_texts(line: Column) -> Column:
    """The options of an option line with their texts cleaned, or null for other lines."""
    def cleaned(parts: Column) -> Column:
        parts = F.when((F.size(parts) >= 2) & F.forall(parts, lambda x: x.rlike(OPTION)), parts).when(line.rlike(OPTION), F.array(line))
        return F.transform(parts, lambda x: F.regexp_replace(F.concat(F.regexp_extract(x, OPTION, 1), F.lit(". "), clean_option(F.regexp_extract(x, OPTION, 2))), r"\s+$", ""))

    return F.when(line.rlike(MARK), _once(split_options(line), cleaned))
