"""Files as rows: dispatch by extension, DOCX and Markdown readers, page selection, and text, JSON and Parquet sinks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.office_math import OFFICE, latex_of
from ..operators import tables as G

# What may be read.
DOCUMENTS, IMAGES = ("pdf", "docx", "doc"), ("png", "jpg", "jpeg", "gif", "bmp", "webp", "tiff")
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MATH = f"{{{OFFICE}}}"
FORMULAS = {f"{MATH}oMath": "$", f"{MATH}oMathPara": "$$"}
RELATIONS = "word/_rels/document.xml.rels"
SIGNS = {f"{WORD}tab": "\t", f"{WORD}br": "\n"}
SAID, PARAGRAPH, TABLE, NUMBER = (f"{WORD}{t}" for t in ("t", "p", "tbl", "numPr"))
STYLE = f"{WORD}pPr"
STYLES = (STYLE, f"{WORD}rPr")
BLIP, VML = f"{DRAWING}blip", "{urn:schemas-microsoft-com:vml}imagedata"
#: Blocks of DOCX files that a reader gives at once, but for those of one file.
BATCH = 4096
BLOCKS = "path string, pos int, kind string, text string, images array<string>, num string, cells array<struct<text:string,images:array<string>>>, n_rows int, n_cols int"


def allowed(name: Column, extensions: tuple[str, ...] = DOCUMENTS) -> Column:
    return T.extension(name).isin(*extensions)


def route(name: Column, has_key: Column, has_text: Column) -> Column:
    """Which reader a file goes to: docx, model (a scan or an image with a key), text, placeholder or error."""
    ext = T.extension(name)
    return F.when(ext.isin("docx", "doc"), "docx").when(ext == "pdf", F.when(has_text, "text").when(has_key, "model").otherwise("text")).when(ext.isin(*IMAGES), F.when(has_key, "model").otherwise("placeholder")).otherwise("error")


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length, content of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def page_numbers(ranges: Column, total: Column) -> Column:
    """'1-3,5' (from 1) as sorted distinct numbers from 0 within total; parts that are no numbers are left out."""
    parts = F.filter(F.split(F.regexp_replace(F.coalesce(ranges, F.lit("")), " ", ""), ","), lambda p: p.rlike("^[0-9]+(-[0-9]+)?$"))
    lo = lambda p: F.get(F.split(p, "-"), F.lit(0)).try_cast("int")
    hi = lambda p: F.coalesce(F.get(F.split(p, "-"), F.lit(1)).try_cast("int"), lo(p))
    pages = F.flatten(F.transform(F.filter(parts, lambda p: F.least(hi(p), total) >= F.greatest(lo(p), F.lit(1))), lambda p: F.sequence(F.greatest(lo(p), F.lit(1)) - 1, F.least(hi(p), total) - 1)))
    return F.array_sort(F.array_distinct(pages))


def select_pages(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """pages (doc, page from 0) that ranges (doc, pages) names; a doc without a range, or an empty one, stays whole."""
    totals = pages.groupBy("doc").agg(F.count("*").cast("int").alias("n"))
    chosen = totals.join(ranges, "doc", "left").select("doc", page_numbers(F.col("pages"), F.col("n")).alias("chosen"))
    return pages.join(chosen, "doc").filter((F.size("chosen") == 0) | F.array_contains("chosen", F.col("page").cast("int"))).drop("chosen")


def _text(p: ElementTree.Element) -> str:
    """A paragraph's text; Office math as LaTeX between dollars."""
    out: list[str] = []

    def walk(e: ElementTree.Element) -> None:
        for c in e:
            tag = c.tag
            if mark := FORMULAS.get(tag):
                out.append(f"{mark}{latex_of(c)}{mark}")
            elif tag not in STYLES:
                if said := c.text if tag == SAID else SIGNS.get(tag):
                    out.append(said)
                if len(c):
                    walk(c)

    walk(p)
    return "".join(out).strip()


def _images(e: ElementTree.Element, targets: dict[str, str]) -> list[str]:
    """Files of the pictures below an element, each relation once."""
    if not targets:
        return []
    ids = [b.get(f"{RELATION}embed") or b.get(f"{RELATION}link") for b in e.iter(BLIP)] + [x.get(f"{RELATION}id") for x in e.iter(VML)]
    return [targets[i] for i in dict.fromkeys(ids) if i in targets]


def _walk(parent: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """Paragraphs and tables in document order, through content controls and the like."""
    for e in parent:
        if e.tag in (PARAGRAPH, TABLE):
            yield e
        elif e.tag not in (f"{WORD}sectPr",):
            yield from _walk(e)


def docx_blocks(content: bytes) -> list[tuple]:
    """(pos, kind p or tbl, text, images, number, cells, rows, columns) of a DOCX file, in order. A list paragraph's number
    counts those of its list and level so far."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
        pictures = body is not None and any(next(body.iter(t), None) is not None for t in (BLIP, VML))
        rels = ElementTree.fromstring(z.read(RELATIONS)) if pictures and RELATIONS in z.namelist() else []
    targets = {r.get("Id"): (r.get("Target") or "").rpartition("/")[2] for r in rels}
    out, counts = [], {}
    for pos, e in enumerate(_walk(body) if body is not None else ()):
        if e.tag == PARAGRAPH:
            style = e.find(STYLE)
            num = style.find(NUMBER) if style is not None else None
            label = None
            if num is not None:
                get = lambda tag, num=num: (x.get(f"{WORD}val") if (x := num.find(f"{WORD}{tag}")) is not None else "0")
                key = (get("numId"), get("ilvl"))
                counts[key] = counts.get(key, 0) + 1
                label = f"{counts[key]}."
            out.append((pos, "p", _text(e), _images(e, targets), label, None, None, None))
        else:
            rows = [[({"text": "\n".join(t for p in c.iter(f"{WORD}p") if (t := _text(p))), "images": _images(c, targets)}) for c in r.findall(f"{WORD}tc")] for r in e.findall(f"{WORD}tr")]
            out.append((pos, "tbl", "", [], None, [c for r in rows for c in r], len(rows), max((len(r) for r in rows), default=0)))
    return out


def read_docx(contents: DataFrame) -> DataFrame:
    """BLOCKS of DOCX files (path, content); a file that can't be read gives one row of kind error."""

    texts = pa.list_(pa.string())
    cells = pa.list_(pa.struct([("text", pa.string()), ("images", texts)]))
    schema = pa.schema([("path", pa.string()), ("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("images", texts), ("num", pa.string()), ("cells", cells), ("n_rows", pa.int32()), ("n_cols", pa.int32())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                path = path.as_py()
                try:
                    rows += [(path, *x) for x in docx_blocks(content.as_py())]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append((path, 0, "error", str(e), [], None, None, None, None))
                if len(rows) > BATCH:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    return contents.select("path", "content").mapInArrow(read, BLOCKS)


def docx_items(blocks: DataFrame) -> DataFrame:
    """Items for the structure parser: paragraphs with their numbers, option tables as cells, other tables as pipe lines."""
    kind = F.when(F.col("kind") == "tbl", G.table_kind(F.col("cells"), F.col("n_rows"), F.col("n_cols")))
    cell = lambda c: F.regexp_replace(F.coalesce(c["text"], F.lit("")), r"\s*\n\s*", " ")
    rows = F.transform(F.sequence(F.lit(0), F.greatest("n_rows", F.lit(1)) - 1), lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.slice("cells", r * F.col("n_cols") + 1, F.greatest("n_cols", F.lit(1))), cell), " | "), F.lit(" |")))
    firsts = F.transform(F.sequence(F.lit(0), F.greatest("n_rows", F.lit(1)) - 1), lambda r: cell(F.get("cells", r * F.col("n_cols"))))
    line = F.concat_ws(" ", "num", "text")
    texts = F.when(F.col("kind") == "p", F.array(line)).when(kind == "option", F.array(F.lit(""))).when(kind == "ds", firsts).otherwise(rows)
    wide = blocks.filter("kind <> 'error'").withColumns({"texts": texts, "option_cells": F.when(kind == "option", G.option_cells(F.col("cells")))})
    wide = wide.select(F.col("path").alias("doc"), "pos", "images", "option_cells", F.posexplode("texts").alias("k", "text"))
    at = F.row_number().over(Window.partitionBy("doc").orderBy("pos", "k"))
    return wide.select("doc", at.alias("pos"), "text", F.when(F.col("k") == 0, F.col("images")).otherwise(F.array().cast("array<string>")).alias("images"), "option_cells")


def placeholder(names: DataFrame) -> DataFrame:
    """A document with one question for each image file (path)."""
    name = F.element_at(F.split("path", "/"), -1)
    return names.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("title"), F.lit("khac").alias("doc_type"), F.lit(1).alias("number"), F.array(name).alias("images"))


def read_with_model(pages: DataFrame, ladder: list[Callable[[pd.DataFrame], pd.Series]]) -> DataFrame:
    """pages (doc, page, ...) with `reply` and `step`: what the first reader of the ladder that answers says. A reader takes
    a frame of pages and gives a text or None for each; later ones see only what is left."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.assign(reply=None, step=-1)
            for k, reader in enumerate(ladder):
                left = f["reply"].isna()
                if not left.any():
                    break
                got = pd.Series(list(reader(f[left])), index=f.index[left], dtype=object)
                told = got.notna()
                f.loc[got.index[told], "reply"] = got[told]
                f.loc[got.index[told], "step"] = k
            yield f

    return pages.mapInPandas(read, ", ".join(f"`{c}` {t}" for c, t in pages.dtypes) + ", reply string, step int")


# --- sinks -------------------------------------------------------------------------------------------------------


def write_text(parts: DataFrame, path: str, doc: str = "doc", order: str = "pos", separator: str = "\n") -> None:
    """One text for each document, partitioned by it, of its parts (doc, order, text) in order."""
    joined = parts.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), separator).alias("value"))
    joined.write.partitionBy(doc).text(path)


def write_many(df: DataFrame, sinks: dict[str, str]) -> None:
    """The same rows to several sinks: format to path. The rows are kept while they are written."""
    df = df.persist()
    try:
        for kind, path in sinks.items():
            df.write.format(kind).save(path)
    finally:
        df.unpersist()


def print_html(questions: DataFrame, show_solutions: bool = True) -> DataFrame:
    """doc, html: a print page of questions (doc, gnum, text, options, solution), escaped but for math."""
    e = T.html_escape
    options = F.array_join(F.transform(F.coalesce("options", F.array().cast("array<string>")), lambda o: F.concat(F.lit("<li>"), e(o), F.lit("</li>"))), "")
    solution = F.when(F.lit(show_solutions) & (F.coalesce("solution", F.lit("")) != ""), F.concat(F.lit('<div class="solution">'), e(F.col("solution")), F.lit("</div>"))).otherwise("")
    block = F.concat(F.lit("<p><b>Câu "), F.col("gnum").cast("string"), F.lit(".</b> "), e(F.coalesce("text", F.lit(""))), F.lit("</p>"), F.when(options != "", F.concat(F.lit("<ul>"), options, F.lit("</ul>"))).otherwise(""), solution)
    ordered = F.array_sort(F.collect_list(F.struct("gnum", block.alias("b"))))
    return questions.groupBy("doc").agg(F.concat(F.lit("<html><body>"), F.array_join(F.transform(ordered, lambda x: x["b"]), "\n"), F.lit("</body></html>")).alias("html"))
