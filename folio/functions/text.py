"""Column functions over lines and texts. Character classes are spelled out, as regex dialects differ on \\s and \\w."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[ \t\n\r\f]"
#: Letters and digits of Latin scripts with their accents, and Greek.
LETTER = "A-Za-zÀ-ÖØ-öø-ɏΑ-ωḀ-ỿ"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\r\f"))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def norm_line(c: Column) -> Column:
    """A line for comparing: trimmed, white space joined, case folded (the sharp s too)."""
    return F.replace(F.lower(F.regexp_replace(strip(c), f"{BLANK}+", " ")), F.lit("ß"), F.lit("ss"))


def is_page_number(c: Column) -> Column:
    """A line of nothing but a number or a roman numeral between dashes, dots and bars."""
    return c.rlike(r"^[ \t\-–—.|]*([0-9]{1,4}|[ivxlcdmIVXLCDM]{1,7})[ \t\-–—.|]*$")


def letters_only(c: Column) -> Column:
    """Lower-case letters and digits only, for matching two readings of a line."""
    return F.regexp_replace(F.lower(c), f"[^{LETTER}0-9]+", "")


def meaningful_text(c: Column) -> Column:
    """A Markdown text without images, comments, rules and markup."""
    steps = (r"!\[[^\]]*\]\(<[^>]*>\)", r"!\[[^\]]*\]\([^)]*\)", r"<!--(?s:.*?)-->", r"(?m)^---+$", r"[#*_`\-=|>]")
    return strip(reduce(lambda x, p: F.regexp_replace(x, p, ""), steps, F.coalesce(c, F.lit(""))))


def meaningful_length(c: Column) -> Column:
    return F.length(meaningful_text(c))


def looks_truncated(c: Column) -> Column:
    """Whether a page's Markdown seems to stop midway: an odd number of dollars, or a long last line without an end."""
    text = strip(F.coalesce(c, F.lit("")))
    last = strip(F.element_at(F.split(text, "\n"), -1))
    complete = last.rlike(r"^(\*\*)?([A-Da-d][.)]|Câu|Bài|#|\||\*|-|[0-9]+[.)])") | last.rlike(r'[.?!:)\]"”…|]$')
    return F.when(text == "", False).when(dollars(text) % 2 == 1, True).when((last == "") | complete, False).otherwise(F.length(last) > 40)


def dollars(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("$")))


def unbalanced_dollars(c: Column) -> Column:
    """0 if single and double dollars come in pairs, up to 2 if not."""
    single = dollars(F.replace(c, F.lit("$$")))
    double = (F.length(c) - F.length(F.replace(c, F.lit("$$")))) / 2
    return (single % 2 + double % 2).cast("int")


def strip_page_markers(c: Column) -> Column:
    return F.regexp_replace(c, r"<!-- p2w:page=[0-9]+ -->", "")


def strip_rule_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^[ \t]*_{5,}[ \t]*$\n?", "")


def strip_fence(c: Column) -> Column:
    """The inside of an outer code fence, or the text."""
    text = strip(F.coalesce(c, F.lit("")))
    fence = r"^```(markdown|md)?[ \t\n\r\f]*\n((?s).*?)\n?```$"
    return F.when(text.rlike(fence), strip(F.regexp_extract(text, fence, 2))).otherwise(text)


def strip_tool_images(c: Column) -> Column:
    """Without the image tags that a layout tool writes for itself."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"!\[[^\]]*\]\(<?[^)<>]*?_images[/\\]imageFile[0-9]+\.[A-Za-z]+>?\)", "")


def norm_label(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^0-9a-zà-ỹ]+", "")


def part_id(c: Column) -> Column:
    """The roman or arabic number of a part in its label, or ''."""
    return F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?iu)ph[àầa]n[ \t]*([ivx]+|[0-9]+)\b", 1))


def safe_stem(name: Column) -> Column:
    """A file name's stem with letters, digits, blanks, _ and -, at most 80 of them."""
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(.)\.[^.]*$", "$1")
    kept = F.trim(F.regexp_replace(stem, f"[^{LETTER}0-9 _-]", ""))
    return F.when(kept == "", F.lit("TaiLieu")).otherwise(F.substring(kept, 1, 80))


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_escape(c: Column) -> Column:
    """HTML escapes, but inside $...$ only of the ampersand: the text is split at math spans and put together again."""
    mark = F.split(F.regexp_replace(c, r"(\$[^$\n]+?\$)", "\x01$1\x01"), "\x01")
    return F.array_join(
        F.transform(mark, lambda x, i: F.when(i % 2 == 1, F.replace(x, F.lit("&"), F.lit("&amp;"))).otherwise(F.replace(xml_escape(x), F.lit('"'), F.lit("&quot;")))), ""
    )


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def after_answer_marker(text: Column, number: Column) -> Column:
    """A model's reply without thinking blocks, from behind the marker of question `number` on."""
    clean = strip(F.regexp_replace(text, r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", ""))
    marked = F.split(F.regexp_replace(clean, r"(?iu)\[[ \t]*c[âa]u[ \t]*([0-9]+)[ \t]*\][ \t]*:?", "\x01$1\x02"), "\x01")
    rest = F.filter(F.transform(marked, lambda p: F.split(p, "\x02", 2)), lambda p: (F.size(p) == 2) & (F.element_at(p, 1) == number.cast("string")))
    return F.when(F.size(rest) > 0, strip(F.element_at(F.element_at(rest, 1), 2))).otherwise(strip(F.regexp_replace(clean, r"(?iu)^\*{0,2}\[[ \t]*c[âa]u[ \t]*[0-9]+[ \t]*\]\*{0,2}[ \t]*:?", "")))
