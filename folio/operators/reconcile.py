"""Several readings of the same pages made one: sections merged, missing questions filled, overlaps dropped."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def strips(h: Column, n: int) -> Column:
    """n horizontal strips of a page of height h that reach a third of a strip over each other: array of struct(y0, y1)."""
    step = h / F.lit(float(n))
    over = F.floor(step / 3)
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.greatest(F.lit(0).cast("bigint"), F.floor(i * step) - over).alias("y0"), F.least(h.cast("bigint"), F.floor((i + 1) * step) + over).alias("y1"))
    )


def question_length(q: Column) -> Column:
    size = lambda xs: F.aggregate(F.coalesce(xs, F.array().cast("array<string>")), F.lit(0), lambda n, x: n + F.length(x))
    return F.length(F.coalesce(q["text"], F.lit(""))) + size(q["options"]) + size(q["sub_items"])


def merge_sections(sections: DataFrame, dedupe: str = "") -> DataFrame:
    """doc, sec, type, label, intro, questions of sections (doc, ord, type, label, intro, questions) in reading order.

    A section goes on the one before if its type is the same and the labels don't name different parts, or if it is
    untyped without a label. Of questions with one number 'any' keeps the longest of a section, 'last' the longer of
    neighbours. A merged section's label is its longest so far, so this is a fold over a document's few sections.
    """
    q_type = sections.schema["questions"].dataType
    stored = "struct<type:string,label:string,intro:string,questions:" + q_type.simpleString() + ">"

    def goes_on(a: Column, s: Column) -> Column:
        pa, ps, la, ls = T.part_id(a["label"]), T.part_id(s["label"]), T.norm_label(a["label"]), T.norm_label(s["label"])
        same = (s["type"] == a["type"]) & ((ls == "") | (ls == la) | (pa == "") | (ps == "") | (pa == ps))
        return same | ((s["type"] == "khac") & (ls == ""))

    def add(qs: Column, q: Column) -> Column:
        if not dedupe:
            return F.concat(qs, F.array(q))
        longer = lambda x: F.when(question_length(q) > question_length(x), q).otherwise(x)
        same = lambda x: x["number"].eqNullSafe(q["number"])
        if dedupe == "last":
            at_end = (F.size(qs) > 0) & F.coalesce(same(F.try_element_at(qs, F.lit(-1))), F.lit(False))
            return F.when(at_end, F.concat(F.slice(qs, 1, F.greatest(F.size(qs) - 1, F.lit(0))), F.array(longer(F.try_element_at(qs, F.lit(-1)))))).otherwise(F.concat(qs, F.array(q)))
        first = F.get(F.filter(F.transform(qs, lambda x, i: F.when(same(x), i)), lambda i: i.isNotNull()), F.lit(0))
        return F.when(first.isNull(), F.concat(qs, F.array(q))).otherwise(F.transform(qs, lambda x, i: F.when(i == first, longer(x)).otherwise(x)))

    def all_added(qs: Column, more: Column) -> Column:
        return F.aggregate(F.coalesce(more, F.array().cast(q_type)), qs, add)

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        label = F.trim(F.coalesce(s["label"], F.lit("")))
        cont = (F.size(acc) > 0) & F.coalesce(goes_on(last, s), F.lit(False))
        grown = F.struct(last["type"].alias("type"), F.when(F.length(label) > F.length(last["label"]), label).otherwise(last["label"]).alias("label"), F.when(last["intro"] == "", F.coalesce(s["intro"], F.lit(""))).otherwise(last["intro"]).alias("intro"), all_added(last["questions"], s["questions"]).alias("questions"))
        fresh = F.struct(s["type"].alias("type"), label.alias("label"), F.coalesce(s["intro"], F.lit("")).alias("intro"), all_added(F.array().cast(q_type), s["questions"]).alias("questions"))
        return F.when(cont, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown.cast(stored)))).otherwise(F.concat(acc, F.array(fresh.cast(stored))))

    ordered = F.array_sort(F.collect_list(F.struct("ord", F.coalesce("type", F.lit("khac")).alias("type"), "label", "intro", "questions")))
    folded = sections.groupBy("doc").agg(ordered.alias("s")).select("doc", F.aggregate("s", F.array().cast(f"array<{stored}>"), step).alias("m"))
    return folded.select("doc", F.posexplode("m").alias("sec", "s")).select("doc", "sec", "s.*")


def missing_questions(have: DataFrame, others: DataFrame) -> DataFrame:
    """Questions (doc, type, number, text) of the other reading, of 15 characters or more, whose number is not in the
    sections of that type (any section for the untyped), with `after` and `before`: their place by number."""
    target = others.filter(F.length(F.trim(F.coalesce("text", F.lit("")))) >= 15)
    typed, untyped = target.filter("type <> 'khac'"), target.filter("type = 'khac'")
    lost = typed.join(have, ["doc", "type", "number"], "left_anti").unionByName(untyped.join(have, ["doc", "number"], "left_anti").select(*target.columns))
    lost = lost.groupBy("doc", "type", "number").agg(F.min_by("text", F.length("text")).alias("text"))
    both = have.select("doc", "type", "number", F.lit("").alias("text"), F.lit(False).alias("is_lost")).unionByName(lost.withColumn("is_lost", F.lit(True)))
    # Both ways what is known is carried on; a frame that reaches to the end would be gone through anew for each row.
    up = Window.partitionBy("doc", "type").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("doc", "type").orderBy(F.desc("number")).rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(~F.col("is_lost"), F.col("number"))
    return both.withColumn("after", F.last(known, True).over(up)).withColumn("before", F.last(known, True).over(down)).filter("is_lost").select("doc", "type", "number", "text", "after", "before")


def chosen_boxes(boxes: DataFrame, keep: DataFrame) -> DataFrame:
    """boxes (doc, page, kind) of the reading that was kept for each page (doc, page, kind)."""
    return boxes.join(keep, ["doc", "page", "kind"], "left_semi")


def failure_note(page: Column, reason: Column, partial: Column) -> Column:
    """What stands for a page that can't be read: a note that names it, and what was read of it."""
    note = F.concat(F.lit("\n\n> ⚠️ **[Trang "), (page + 1).cast("string"), F.lit("]** Không đọc được chữ ("), reason, F.lit("). Ảnh gốc của trang ở dưới — hãy chuyển lại riêng trang này.\n\n"))
    rest = T.strip(F.coalesce(partial, F.lit("")))
    return F.concat(note, F.when(rest == "", "").otherwise(F.concat(rest, F.lit("\n"))))


# Where the overlap may lie (behind this part of the upper reading's lines, before that part of the lower
# one's, which is some lines at least), letters of a line that can be told apart by itself, and how alike two such are.
TAIL_FROM, HEAD_TO, HEAD_LINES = 0.4, 0.6, 4
TELLING, ALIKE = 12, 0.85


def _near_any(lines: Column, others: Column) -> Column:
    """For each of a row's lines, whether one of the others is as like as ALIKE by matching blocks."""

    def near(x: str, y: str) -> bool:
        m = SequenceMatcher(None, x, y, autojunk=False)
        return m.real_quick_ratio() >= ALIKE and m.quick_ratio() >= ALIKE and m.ratio() >= ALIKE

    @F.pandas_udf("array<boolean>")
    def compare(lines: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series([[any(near(x, y) for y in those) for x in these] for these, those in zip(lines, others, strict=True)])

    return compare(lines, others)


def _carried(marks: Column) -> Column:
    """From struct(gone, chain) in order: whether an entry is gone, or is in a chain that follows one that is."""
    step = lambda acc, m: F.concat(acc, F.array(m["gone"] | (m["chain"] & F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(False)))))
    return F.aggregate(marks, F.array().cast("array<boolean>"), step)


def drop_overlap(halves: DataFrame) -> DataFrame:
    """doc, text: the lower of two readings (doc, top, bottom) without the lines that the upper one has at its end.

    A line of TELLING letters or more goes if it is in the upper part or like a line there; a repeated heading goes; a
    shorter line goes if it is there and only such lines are between it and a line that went. A page is a row, and its
    lines are arrays in it, so nothing is shuffled; only the likeness of lines is Python.
    """
    key = lambda line: F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", "")
    heading = lambda line: F.ltrim(line).startswith("#")
    upper, lower = T.lines(F.col("top")), T.lines(F.col("bottom"))
    tail = F.slice(upper, F.floor(F.size(upper) * F.lit(TAIL_FROM)).cast("int") + 1, F.size(upper))
    reach = F.least(F.size(lower), F.greatest(F.lit(HEAD_LINES), F.floor(F.size(lower) * F.lit(HEAD_TO)).cast("int")))
    split = halves.select(
        "doc", "bottom", lower.alias("lower"), F.slice(lower, 1, reach).alias("zone"),
        F.transform(tail, key).alias("known"), F.transform(F.filter(tail, heading), key).alias("headings"),
    ).withColumn("keys", F.transform("zone", key))
    telling = F.filter("known", lambda k: F.length(k) >= TELLING)
    # Only telling lines that aren't there letter by letter are compared.
    asked = F.transform("keys", lambda k: F.when((F.length(k) >= TELLING) & ~F.array_contains("known", k), k).otherwise(""))
    split = split.withColumn("near", _near_any(asked, telling))

    def mark(k: Column, i: Column) -> Column:
        there = (k != "") & F.array_contains("known", k)
        short = F.length(k) < TELLING
        repeats = (k != "") & heading(F.get("zone", i)) & F.array_contains("headings", k)
        return F.struct((repeats | (~short & (there | F.get("near", i)))).alias("gone"), (there & short).alias("chain"))

    marked = split.withColumn("marks", F.transform("keys", mark))
    there, back = _carried(F.col("marks")), F.reverse(_carried(F.reverse("marks")))
    marked = marked.withColumn("gone", F.zip_with(there, back, lambda a, b: a | b))
    kept = F.filter("lower", lambda _, i: ~F.coalesce(F.get("gone", i), F.lit(False)))
    return marked.select("doc", F.when(F.exists("gone", lambda g: g), T.strip(F.array_join(kept, "\n"))).otherwise(F.col("bottom")).alias("text"))


ANSWER_MARK = r"(?iu)\*{0,2}\[\s*c[âa]u\s*([0-9]+)\s*\]\*{0,2}:?"


def solutions(replies: DataFrame, numbers: DataFrame) -> DataFrame:
    """doc, question_id, solution from replies (doc, text) cut at their markers; of repeated ones the last that says anything
    counts. numbers: doc, number, question_id."""
    parts = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), ANSWER_MARK, "\x01$1\x02"), "\x01")
    cut = replies.select("doc", F.posexplode(parts).alias("pos", "part")).filter("pos > 0").select("doc", "pos", F.split("part", "\x02", 2).alias("p"))
    said = cut.select("doc", "pos", F.get("p", F.lit(0)).alias("number"), T.strip(F.get("p", F.lit(1))).alias("solution")).filter("solution <> ''")
    named = said.join(numbers, ["doc", "number"])
    return named.groupBy("doc", "question_id").agg(F.max_by("solution", "pos").alias("solution"))


def fill_missing(numbers: DataFrame, first: DataFrame, ask: Callable[[DataFrame, int], DataFrame], rounds: int = 2) -> DataFrame:
    """solutions() of the first replies, and for what they lack those of up to `rounds` more: ask(missing, round) gives new
    replies. Only missing questions take an answer; a round that adds nothing is the last."""
    found = solutions(first, numbers)
    for k in range(rounds):
        lost = numbers.join(found, ["doc", "question_id"], "left_anti")
        if lost.isEmpty():
            break
        new = solutions(ask(lost, k), numbers).join(lost.select("doc", "question_id"), ["doc", "question_id"], "left_semi")
        if new.isEmpty():
            break
        found = found.unionByName(new)
    return found


# --- tolerant JSON -------------------------------------------------------------------------------------------------

ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|.)", re.S)
#: What a model never means: the escapes of backspace, form feed and vertical tab come from \beta, \frac and the like.
NEVER_MEANT = {"b", "f", "u0008", "u000b", "u000c"}
WHITE = "\t\n\r"


def _object_in(raw: str) -> str | None:
    """From the first opening to the last closing brace, of a code block if there is one with braces."""
    block = re.search(r"```(?:json)?\s*(.+?)\s*```", raw, re.S)
    for part in (block[1], raw) if block else (raw,):
        if found := re.search(r"\{.*\}", part, re.S):
            return found[0]
        if "{" in part and "}" in part:
            return ""
    return None


def _readings(text: str) -> Iterator[str]:
    """The ways to read an object whose strings hold LaTeX, the likeliest first.

    As it stands, unless an escape says that a command was taken for a control character. Then with every backslash as
    itself that isn't doubled or before a quote. Then the same without control characters, which JSON forbids.
    """
    if not any(m[1].lower() in NEVER_MEANT for m in ESCAPE.finditer(text)):
        yield text
    literal = ESCAPE.sub(lambda m: m[0] if m[1] in ("\\", '"') else "\\\\" + m[1], text)
    yield literal
    printable = "".join(c for c in literal if c in WHITE or not (c < " " or c == "\x7f"))
    if printable != literal and printable.strip("{} \t\n\r"):
        yield printable


def salvaged_json(raw: str | None) -> str | None:
    """The object in a model's reply as JSON, mended if needed, or None."""
    text = _object_in(raw or "")
    for reading in _readings(text) if text else ():
        try:
            return json.dumps(json.loads(reading), ensure_ascii=False)
        except ValueError:
            continue
    return None


def salvaged(c: Column) -> Column:
    @F.pandas_udf("string")
    def mend(s: pd.Series) -> pd.Series:
        return s.map(salvaged_json)

    return mend(c)

