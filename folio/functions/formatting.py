"""Layout of exam Markdown: a scanner names the labels in a line, and from the labels follow line breaks and bold type."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs that converters print before entries of lists, and the words that open a question or a part.
BULLETS = "-*+•·▪▸▹►➤◦‣⁃"
QUESTION_WORDS = ("Câu", "Cau", "Bài", "Bai")
PART_WORDS = ("PHẦN", "PHAN")
#: What may stand alone on a line without meaning anything.
DUST = set(".·•")
#: A text without any of these has no label.
MAY_HAVE_LABEL = re.compile(r"(?:C[âa]u|B[àa]i)\s|PH[ẦA]N|[A-Da-d][.):*\\]")


class Label(NamedTuple):
    """A label: its kind, its key (the letter of an answer), how it is printed, and the words it takes."""

    kind: str
    key: str
    shown: str
    words: int


def words_of(line: str) -> list[str]:
    """Words and the white space between them, in turn; the first and the last are words, maybe empty."""
    return re.split(r"(\s+)", line)


def label_at(words: list[str], i: int, loose: bool) -> Label | None:
    """The label that word i opens. `loose` takes answers as (A), A) and A: too."""
    bare = words[i].strip("*")
    if bare in PART_WORDS:
        return Label("part", bare, "", 1)
    if bare in QUESTION_WORDS and i + 2 < len(words):
        number = re.match(r"\**(\d+)([.:])\**$", words[i + 2])
        return Label("question", number[1], f"{bare} {number[1]}{number[2]}", 3) if number else None
    shape = bare.replace("*", "")
    opened = loose and shape.startswith("(")
    letter, mark = shape[opened : opened + 1], shape[opened + 1 :]
    if letter and letter in "ABCD" and (mark == "." or (loose and mark in (")", ":", "\\."))):
        return Label("answer", letter, f"{letter}.", 1)
    if letter and letter in "abcd" and mark == ")" and not opened:
        return Label("statement", letter, f"{letter})", 1)
    return None


def labels(words: list[str], loose: bool) -> dict[int, Label]:
    """The labels of a line by the word they begin at; an answer or a statement has white space behind it."""
    found = ((i, label_at(words, i, loose)) for i in range(0, len(words), 2) if words[i])
    return {i: x for i, x in found if x and (x.kind in ("part", "question") or i + 1 < len(words))}


def complete_runs(found: dict[int, Label]) -> set[int]:
    """Where answers A to D, or statements a to d, follow each other in order."""
    out: set[int] = set()
    for kind, wanted in (("answer", "ABCD"), ("statement", "abcd")):
        run: list[int] = []
        for i, x in found.items():
            if x.kind != kind:
                continue
            run = [*run, i] if x.key == wanted[len(run)] else [i] if x.key == wanted[0] else []
            if len(run) == len(wanted):
                out.update(run)
                run = []
    return out


def cut(line: str, loose: bool) -> Iterator[tuple[Label | None, str]]:
    """The line in parts, each with the label it begins with: a question or a part opens one, and so do whole runs of answers."""
    words = words_of(line)
    found = labels(words, loose)
    breaks = complete_runs(found) | {i for i, x in found.items() if x.kind in ("part", "question")}
    starts = sorted({0} | breaks)
    for a, b in zip(starts, [*starts[1:], len(words)], strict=True):
        part = "".join(words[a:b])
        if a or part.strip() or not breaks:
            yield found.get(a), part if b == len(words) else part.rstrip()


def bold(label: Label | None, part: str) -> str:
    """The part with its label in bold, if it isn't already."""
    if label is None or label.kind == "part" or part.startswith("**" + label.shown):
        return part
    words = words_of(part)
    if label.kind == "question":
        return f"**{label.shown}**" + "".join(words[label.words :])
    return f"**{label.shown}** " + "".join(words[label.words + 1 :])


def format_exam_text(s: str | None) -> str | None:
    """A question's text: a whole run of answers or statements on lines of their own, and labels bold."""
    if not s or not MAY_HAVE_LABEL.search(s):
        return s
    return "\n".join(bold(*part) for line in s.split("\n") for part in cut(line, loose=True))


def _tidied(line: str) -> str | None:
    """A line without bars and bullets before a header and with decimals in one piece; None if it is nothing but dust."""
    if line.strip() and set(line.strip()) <= DUST:
        return None
    words = words_of(line)
    for i in range(0, len(words) - 4, 2):
        if words[i][-1:].isdigit() and words[i + 2] == "," and words[i + 4][:1].isdigit():
            words[i + 1] = words[i + 3] = ""
    for i in range(0, len(words) - 2, 2):
        after = label_at(words, i + 2, False)
        if words[i] and set(words[i]) <= set(BULLETS + "│|–—") - {"*"} and after and after.kind in ("part", "question"):
            words[i] = words[i + 1] = ""
    return "".join(words)


def bold_labels(s: str | None) -> str | None:
    """A document's text: labels bold, each answer and statement a paragraph, dust and bullets before headers removed."""
    if not s:
        return s
    out: list[str] = []
    for line in s.split("\n"):
        tidy = _tidied(line)
        if tidy is None:
            continue
        for label, part in cut(tidy, loose=False):
            if label and label.kind in ("answer", "statement") and out and out[-1]:
                out.append("")
            out.append(bold(label, part))
    return "\n".join(out)


def strip_answer_bullets(s: str | None) -> str | None:
    """Answers and statements without a bullet, or answers without a list number, before them."""
    if not s:
        return s
    out = []
    for line in s.split("\n"):
        words = words_of(line.lstrip(" \t"))
        after = label_at(words, 2, False) if len(words) > 2 and words[2] else None
        bullet = 1 <= len(words[0]) <= 3 and set(words[0]) <= set(BULLETS)
        listed = words[0].endswith(".") and words[0][:-1].isdigit()
        drop = after and ((bullet and after.kind in ("answer", "statement")) or (listed and after.kind == "answer"))
        out.append("".join(words[2:]) if drop else line)
    return "\n".join(out)


def drop_large_images(text: Column, large: Column) -> Column:
    """A text without the tags of images whose file is in `large`, an array of names."""
    tag = lambda name: F.concat(F.lit(r"!\[[^\]]*\]\(<?[^)<>]*?\Q"), name, F.lit(r"\E>?\)"))
    return F.aggregate(F.coalesce(large, F.array().cast("array<string>")), text, lambda acc, name: F.regexp_replace(acc, tag(name), F.lit("")))
