"""DOCX and XLSX files as sinks: ordered blocks and rows of documents, one zip a document, written by tasks and committed at once."""

from __future__ import annotations

import contextlib
import functools
import hashlib
import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.office_math import OFFICE, formula, office_math

#: Blocks that one DOCX file holds, and rows that one XLSX file holds; a longer document goes to several files.
DOCX_BLOCKS = 20_000
XLSX_ROWS = 1_000_000
#: Bytes or characters that a file's writer gathers, and about the bytes of files that a reader gives at once.
BUFFER, BATCH = 1 << 16, 4 << 20
BLOCKS = "doc string, pos long, kind string, text string, cells array<array<string>>, right boolean"
#: Kinds of blocks: font size in half points, bold, colour, indent in twentieths of a point, shade, alignment.
LOOKS = {
    "title": (28, True, None, 0, None, "center"),
    "heading": (26, True, "0F3D8E", 0, None, None),
    "question": (24, False, None, 0, None, None),
    "option": (24, False, None, 454, None, None),
    "sub": (24, False, None, 454, None, None),
    "solution": (22, False, None, 454, "EBF4FF", None),
}
PLAIN = (24, False, None, 0, None, None)
LEAD = re.compile(r"\s*(?:\*\*)?\s*([A-Da-d][.)])\s*(?:\*\*)?\s*")
NUMBERED = re.compile(r"(Câu \d+\. |Lời giải: )")
MATH = re.compile(r"(\$\$[^$]+?\$\$|\$[^$\n]+?\$)")
MARKED = re.compile(r"(\*\*[^*\n]+?\*\*|\*[^*\n]+?\*)")
NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff\ud800-\udfff]")
WORD_NAME = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
WORD_NAMES = f'{WORD_NAME} xmlns:m="{OFFICE}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
KINDS = "application/vnd.openxmlformats-officedocument"


def run(text: str, size: int, bold: bool = False, italic: bool = False, underline: bool = False, colour: str | None = None) -> str:
    """A run of text; tabs and line ends are elements of their own, characters that XML can't hold are left out."""
    style = "<w:b/>" * bold + "<w:i/>" * italic + (f'<w:color w:val="{colour}"/>' if colour else "") + f'<w:sz w:val="{size}"/>' + '<w:u w:val="single"/>' * underline
    text = NOT_XML.sub("", text.replace("\r\n", "\n"))
    parts = re.split(r"(\n|\t)", text) if "\n" in text or "\t" in text else [text]
    inner = "".join({"\n": "<w:br/>", "\t": "<w:tab/>"}.get(p) or f'<w:t xml:space="preserve">{escape(p)}</w:t>' for p in parts if p)
    return f"<w:r><w:rPr>{style}</w:rPr>{inner}</w:r>" if inner else ""


def inline(text: str, size: int, bold: bool = False, colour: str | None = None) -> str:
    """Runs of a text: formulas as Office math, or as they stand if they aren't understood; **bold** and *italic*."""
    out = []
    for part in MATH.split(text) if "$" in text else [text]:
        if len(part) > 2 and part[0] == part[-1] == "$":
            wide = part.startswith("$$") and len(part) > 4
            tree = formula(part.strip("$"))
            if tree is not None:
                math = ET.tostring(office_math(tree), encoding="unicode")
                out.append(f"<m:oMathPara>{math}</m:oMathPara>" if wide else math)
                continue
            out.append(run(part, size, bold, colour=colour))
            continue
        for piece in MARKED.split(part) if "*" in part else [part]:
            strong, slanted = len(piece) > 4 and piece[:2] == piece[-2:] == "**", len(piece) > 2 and piece[:1] == piece[-1:] == "*"
            out.append(run(piece[2:-2] if strong else piece[1:-1] if slanted else piece, size, bold or strong, slanted and not strong, colour=colour))
    return "".join(out)


def paragraph(kind: str, text: str, right: bool = False) -> str:
    """A block as a paragraph. The letter of a right option is underlined, a question's number and a solution's label are bold."""
    size, bold, colour, indent, shade, align = LOOKS.get(kind, PLAIN)
    how = (f'<w:shd w:val="clear" w:color="auto" w:fill="{shade}"/>' if shade else "") + (f'<w:ind w:left="{indent}"/>' if indent else "") + (f'<w:jc w:val="{align}"/>' if align else "")
    lead = ""
    if right and (m := LEAD.match(text)):
        lead, text = run(m[1], size, bold, underline=True), " " + text[m.end() :]
    elif kind in ("question", "solution") and (m := NUMBERED.match(text)):
        lead, text = run(m[1], size, True), text[m.end() :]
    return f"<w:p><w:pPr>{how}</w:pPr>{lead}{inline(text, size, bold, colour)}</w:p>"


def table(cells: list[list[str | None]]) -> str:
    edges = "".join(f'<w:{e} w:val="single" w:sz="4" w:space="0" w:color="auto"/>' for e in ("top", "left", "bottom", "right", "insideH", "insideV"))
    n = max((len(r) for r in cells), default=0)
    rows = "".join("<w:tr>" + "".join(f"<w:tc><w:tcPr/>{paragraph('cell', c or '')}</w:tc>" for c in [*r, *[""] * (n - len(r))]) + "</w:tr>" for r in cells)
    return f"<w:tbl><w:tblPr><w:tblBorders>{edges}</w:tblBorders></w:tblPr><w:tblGrid>{'<w:gridCol/>' * n}</w:tblGrid>{rows}</w:tbl>"


def _relations(*of: tuple[str, str, str]) -> str:
    rows = "".join(f'<Relationship Id="{i}" Type="{RELATION}/{t}" Target="{target}"/>' for i, t, target in of)
    return f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships">{rows}</Relationships>'


def _types(*of: tuple[str, str]) -> str:
    rows = "".join(f'<Override PartName="{p}" ContentType="{KINDS}.{t}+xml"/>' for p, t in of)
    return f'{HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{rows}</Types>'


class Package:
    """What all files of a job share: parts that are zipped once and stand at the front of each file, and what is around the
    rows in the part of their own."""

    def __init__(self, parts: dict[str, str], last: str, head: str, tail: str) -> None:
        self.last, self.head, self.tail, out = last, head, tail, io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in parts.items():
                z.writestr(Zip.info(name), text)
            self.entries, size = z.infolist(), out.tell()
        self.front = out.getvalue()[:size]


class Zip:
    """A zip whose last part is written piece by piece, so that a document is never held whole. Dates are fixed: the same rows
    give the same bytes, whichever attempt writes them."""

    def __init__(self, out, package: Package) -> None:
        out.write(package.front)
        self.zip, self.tail = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), package.tail
        self.zip.filelist.extend(package.entries)
        self.last = self.zip.open(self.info(package.last), "w", force_zip64=True)
        self.texts, self.size = [package.head], 0

    @staticmethod
    def info(name: str) -> zipfile.ZipInfo:
        i = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
        i.compress_type = zipfile.ZIP_DEFLATED
        return i

    def write(self, text: str) -> None:
        self.texts.append(text)
        self.size += len(text)
        if self.size > BUFFER:
            self.flush()

    def flush(self) -> None:
        self.last.write("".join(self.texts).encode("utf-8", "replace"))
        self.texts, self.size = [], 0

    def close(self) -> None:
        self.write(self.tail)
        self.flush()
        self.last.close()
        self.zip.close()


@functools.lru_cache(8)
def docx_package(teacher: str, school: str) -> Package:
    left, right = NOT_XML.sub("", teacher), NOT_XML.sub("", school)
    header = f"{HEAD}<w:hdr {WORD_NAME}><w:p>{run(left, 22, True)}<w:r><w:tab/><w:tab/></w:r>{run(right, 22, True)}</w:p></w:hdr>"
    page = '<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText xml:space="preserve"> PAGE </w:instrText></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r>'
    footer = f'{HEAD}<w:ftr {WORD_NAME}><w:p><w:pPr><w:jc w:val="center"/></w:pPr>{page}</w:p></w:ftr>'
    font = '<w:rFonts w:ascii="Times New Roman" w:hAnsi="Times New Roman" w:cs="Times New Roman"/><w:sz w:val="24"/>'
    styles = f'{HEAD}<w:styles {WORD_NAME}><w:docDefaults><w:rPrDefault><w:rPr>{font}</w:rPr></w:rPrDefault><w:pPrDefault><w:pPr><w:spacing w:before="0" w:after="40" w:line="240" w:lineRule="auto"/></w:pPr></w:pPrDefault></w:docDefaults></w:styles>'
    word = "wordprocessingml"
    parts = {
        "[Content_Types].xml": _types(*[(f"/word/{p}.xml", f"{word}.{t}") for p, t in (("document", "document.main"), ("styles", "styles"), ("header1", "header"), ("footer1", "footer"))]),
        "_rels/.rels": _relations(("rId1", "officeDocument", "word/document.xml")),
        "word/_rels/document.xml.rels": _relations(("rId1", "styles", "styles.xml"), ("rId2", "header", "header1.xml"), ("rId3", "footer", "footer1.xml")),
        "word/styles.xml": styles, "word/header1.xml": header, "word/footer1.xml": footer,
    }
    margins = '<w:pgMar w:top="850" w:right="850" w:bottom="850" w:left="1134" w:header="500" w:footer="500" w:gutter="0"/>'
    end = f'<w:sectPr><w:headerReference w:type="default" r:id="rId2"/><w:footerReference w:type="default" r:id="rId3"/>{margins}</w:sectPr></w:body></w:document>'
    return Package(parts, "word/document.xml", f"{HEAD}<w:document {WORD_NAMES}><w:body>", end)


def docx_file(out, options: dict[str, str]) -> Zip:
    return Zip(out, docx_package(options.get("teacher", ""), options.get("school", "")))


def docx_block(b: dict) -> str:
    return table(b["cells"]) + "<w:p/>" if b["kind"] == "table" and b["cells"] else paragraph(b["kind"] or "", b["text"] or "", bool(b["right"]))


@functools.lru_cache(8)
def xlsx_package(sheet: str, columns: str) -> Package:
    main, name = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", NOT_XML.sub("", sheet)[:31]
    parts = {
        "[Content_Types].xml": _types(("/xl/workbook.xml", "spreadsheetml.sheet.main"), ("/xl/worksheets/sheet1.xml", "spreadsheetml.worksheet")),
        "_rels/.rels": _relations(("rId1", "officeDocument", "xl/workbook.xml")),
        "xl/_rels/workbook.xml.rels": _relations(("rId1", "worksheet", "worksheets/sheet1.xml")),
        "xl/workbook.xml": f'{HEAD}<workbook xmlns="{main}" xmlns:r="{RELATION}"><sheets><sheet name={quoteattr(name)} sheetId="1" r:id="rId1"/></sheets></workbook>',
    }
    return Package(parts, "xl/worksheets/sheet1.xml", f'{HEAD}<worksheet xmlns="{main}"><sheetData>' + xlsx_row(columns.split("\x1f"), ()), "</sheetData></worksheet>")


def xlsx_file(out, options: dict[str, str]) -> Zip:
    return Zip(out, xlsx_package(options.get("sheet") or "Sheet1", options["columns"]))


def xlsx_row(cells: list[str | None], numbers: tuple[int, ...]) -> str:
    def cell(i: int, c: str | None) -> str:
        if c is None:
            return "<c/>"
        return f"<c><v>{c}</v></c>" if i in numbers else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(NOT_XML.sub("", c))}</t></is></c>'

    return "<row>" + "".join(cell(i, c) for i, c in enumerate(cells)) + "</row>"


def file_name(doc: str, part: int, kind: str) -> str:
    """A name that other documents don't have: what is plain of the document's, a digest of it, and the part if there are several."""
    stem = re.sub(r"[^\w-]+", "_", doc).strip("_")[:60]
    return f"{stem}-{hashlib.sha256(doc.encode('utf-8', 'replace')).hexdigest()[:12]}" + (f".part-{part:05d}" if part else "") + f".{kind}"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path there. Whatever has a scheme goes to that scheme's store."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class OfficeWriter(DataSourceArrowWriter):
    """Tasks write below a folder of their attempt, which the commit moves into place as a whole; what failed or second attempts
    leave is deleted with the job's staging folder. The driver learns one folder name of each task."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.options, self.overwrite, self.job = options, overwrite, uuid.uuid4().hex

    @property
    def staging(self) -> str:
        return f"{self.options['path'].rstrip('/')}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        folder = f"part-{context.partitionId():05d}-{uuid.uuid4().hex}" if context else f"part-{uuid.uuid4().hex}"
        store, base = file_system(f"{self.staging}/{folder}")
        kind, numbers = self.options["kind"], tuple(int(i) for i in self.options.get("numbers", "").split(",") if i)
        begin, row = (docx_file, docx_block) if kind == "docx" else (xlsx_file, lambda r: xlsx_row(r["cells"], numbers))
        last, zipped, stream, n = None, None, None, 0
        try:
            for batch in iterator:
                for r in batch.to_pylist():
                    if (r["doc"], r["part"]) != last:
                        if zipped:
                            zipped.close()
                            stream.close()
                        elif not n:
                            store.create_dir(base, recursive=True)
                        last, n = (r["doc"], r["part"]), n + 1
                        stream = store.open_output_stream(f"{base}/{file_name(r['doc'], r['part'], kind)}", buffer_size=BUFFER)
                        zipped = begin(stream, self.options)
                    zipped.write(row(r))
            if zipped:
                zipped.close()
        finally:
            if stream and not stream.closed:
                with contextlib.suppress(Exception):  # of an attempt that failed
                    zipped.close()
                stream.close()
        return Written(folder, n)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = file_system(self.options["path"].rstrip("/"))
        store.create_dir(base, recursive=True)
        before = [i for i in store.get_file_info(fs.FileSelector(base)) if not i.base_name.startswith("_staging-")] if self.overwrite else []
        for m in messages:
            if m is not None and m.files:
                store.move(f"{base}/_staging-{self.job}/{m.folder}", f"{base}/{m.folder}")
        for i in before:
            store.delete_dir(i.path) if i.type == fs.FileType.Directory else store.delete_file(i.path)
        self.clear()
        with store.open_output_stream(f"{base}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()

    def clear(self) -> None:
        store, base = file_system(self.staging)
        if store.get_file_info(base).type == fs.FileType.Directory:
            store.delete_dir(base)


class OfficeReader(DataSourceReader):
    """Committed files, a task for each folder that a task wrote. The driver lists these folders and not their files, of which
    there is one for each document."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"].rstrip("/")

    def partitions(self) -> list[InputPartition]:
        store, base = file_system(self.path)
        found = store.get_file_info(fs.FileSelector(base))
        return [InputPartition(i.base_name) for i in found if i.type == fs.FileType.Directory and not i.base_name.startswith("_")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's way to ask for a folder without any
            return
        store, base = file_system(f"{self.path}/{partition.value}")
        paths, contents, size = [], [], 0
        for i in store.get_file_info(fs.FileSelector(base)):
            with store.open_input_file(i.path) as f:
                content = f.read()
            paths.append(i.path)
            contents.append(content)
            size += len(content)
            if size > BATCH:
                yield self.batch(paths, contents)
                paths, contents, size = [], [], 0
        if paths:
            yield self.batch(paths, contents)

    @staticmethod
    def batch(paths: list[str], contents: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])


class OfficeFiles(DataSource):
    """Format "folio_office": rows (doc, part, ...) of each document and part together and in order, as files of kind docx or xlsx;
    read, path and content of the files."""

    @classmethod
    def name(cls) -> str:
        return "folio_office"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema: StructType) -> OfficeReader:
        return OfficeReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> OfficeWriter:
        return OfficeWriter(dict(self.options), overwrite)


def _write(rows: DataFrame, path: str, mode: str, size: int, **options: str) -> None:
    """rows (doc, pos from 0, ...): files of up to `size` rows, so that no task holds or orders more than that of a document."""
    rows.sparkSession.dataSource.register(OfficeFiles)
    parts = rows.filter("doc IS NOT NULL").withColumn("part", F.floor(F.col("pos") / size).cast("int"))
    # A number that is given isn't lowered to what few bytes need: a file costs time whatever its size, and a reader's task is a writer's.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.repartition(n, "doc", "part").sortWithinPartitions("doc", "part", "pos")
    dealt.write.format("folio_office").mode(mode).options(**{k: v for k, v in options.items() if v}).save(path)


def write_docx(blocks: DataFrame, path: str, mode: str = "append", teacher: str = "", school: str = "", size: int = DOCX_BLOCKS) -> None:
    """BLOCKS as DOCX files below a folder, one a document (several of a long one), with `pos` counting a document's blocks from 0.

    Formulas between dollars become Office math if their LaTeX is understood, and stay as they are if not. A null text is an
    empty paragraph; rows without a document are left out. Whoever reads the folder sees whole jobs, told by _SUCCESS.
    """
    _write(blocks.select("doc", "pos", "kind", "text", "cells", "right"), path, mode, size, kind="docx", teacher=teacher, school=school)


def write_xlsx(rows: DataFrame, path: str, mode: str = "append", sheet: str = "Sheet1", size: int = XLSX_ROWS) -> None:
    """rows (doc, pos from 0, other columns) as XLSX files, one a document, with a row of column names and one for each row.
    Numbers stay numbers, other columns are text; nulls and what is no number to a sheet (NaN, infinities) are empty cells."""
    names = [c for c in rows.columns if c not in ("doc", "pos")]
    kinds = dict(rows.dtypes)
    number = lambda c: kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal")
    text = lambda c: F.when(~F.col(c).cast("string").isin("NaN", "Infinity", "-Infinity"), F.col(c).cast("string")) if number(c) else F.col(c).cast("string")
    cells = rows.select("doc", F.col("pos").cast("long").alias("pos"), F.array(*map(text, names)).alias("cells"))
    _write(cells, path, mode, size, kind="xlsx", sheet=sheet, columns="\x1f".join(names), numbers=",".join(str(i) for i, c in enumerate(names) if number(c)))


def written(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the files that write_docx() or write_xlsx() left below a folder."""
    spark.dataSource.register(OfficeFiles)
    return spark.read.format("folio_office").load(path)


def xlsx_cells(content: bytes) -> list[list[str | None]]:
    """The cells of an XLSX file's first sheet as text, as write_xlsx() puts them."""
    out, tag = [], lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(content)) as z, z.open("xl/worksheets/sheet1.xml") as f:
        for _, e in ET.iterparse(f):
            if tag(e) == "row":
                out.append([None if not len(c) else "".join(x.text or "" for x in c.iter() if tag(x) in ("v", "t")) for c in e])
                e.clear()
    return out


def read_xlsx(contents: DataFrame) -> DataFrame:
    """path, pos, cells of XLSX files (path, content); the first row has the column names."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, i, r) for p, c in zip(f["path"], f["content"], strict=True) for i, r in enumerate(xlsx_cells(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "pos", "cells"])

    return contents.select("path", "content").mapInPandas(read, "path string, pos long, cells array<string>")
