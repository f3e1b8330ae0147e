"""Workbooks (.xlsx and relatives): cells of many files, sheet choice, canonical rows.

A workbook is one zip archive and is opened by one task; files are spread over
tasks. From the cells on, everything is joins and grouping.
"""

from __future__ import annotations

import datetime
import functools
import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree
from xml.sax import saxutils

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from limnos.session import cut_lineage
from limnos.sources.headers import file_formats, head, to_canonical
from limnos.sources.records import name_pattern

# Recognised extensions, built-in date formats, spreadsheet epoch.
SUFFIXES = (".xlsx", ".xlsm", ".xltx", ".xltm")
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}
_EPOCH = datetime.datetime(1899, 12, 30)
_LETTERS, _DIGITS = re.compile("[A-Z]+"), re.compile(r"\d+")

CELLS = "file string, sheet string, sheet_pos int, row long, col int, text string"
_BATCH = 20_000


@functools.cache
def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _tag(node) -> str:
    return _local(node.tag)


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter() if _tag(t) == "t")


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles that show a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {
        int(n.get("numFmtId")) for n in root.iter()
        if _tag(n) == "numFmt" and re.search("[dy]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", n.get("formatCode", "").lower()))
    }
    formats = [n for n in root if _tag(n) == "cellXfs"]
    return {i for f in formats for i, x in enumerate(f) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | custom}


@functools.lru_cache(16_384)
def _column(letters: str) -> int:
    n = 0
    for letter in letters:
        n = n * 26 + ord(letter) - 64
    return n - 1


def _book_cells(name: str, content: bytes) -> Iterator[tuple]:
    book = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = [_text(n) for n in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if _tag(n) == "si"]
    dates = _date_styles(book)
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = [n for n in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _tag(n) == "sheet"]
    for pos, sheet in enumerate(sheets):
        target = links[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        title = sheet.get("name")
        for _, node in ElementTree.iterparse(book.open(part)):
            if _tag(node) != "row":
                continue
            for cell in node:
                kind, values = cell.get("t"), {_tag(v): v for v in cell}
                text = _text(values["is"]) if "is" in values else (values["v"].text if "v" in values else None)
                if text is None or kind == "e":
                    continue
                if kind == "s":
                    text = shared[int(text)]
                elif kind in (None, "n") and int(cell.get("s", 0)) in dates:
                    text = (_EPOCH + datetime.timedelta(days=float(text))).isoformat(sep=" ")
                ref = cell.get("r")
                yield name, title, pos, int(_DIGITS.search(ref).group()) - 1, _column(_LETTERS.match(ref).group()), text
            node.clear()


def _cells(batches):
    names = [c.split()[0] for c in CELLS.split(", ")]
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            rows = []
            for row in _book_cells(path, content):
                rows.append(row)
                if len(rows) == _BATCH:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)


def book_cells(books: DataFrame) -> DataFrame:
    """Every non-empty cell of workbooks (``path, content``): ``file, sheet, sheet_pos, row, col, text``."""
    return books.select("path", "content").mapInPandas(_cells, CELLS)


def read_cells(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Every non-empty cell of the workbooks in folders."""
    return book_cells(spark.read.format("binaryFile").option("pathGlobFilter", name_pattern(SUFFIXES)).load(paths))


def sheet_lines(cells: DataFrame) -> DataFrame:
    """Cells to lines of a tab-separated file per sheet (``file`` is ``<path>#<sheet>``)."""
    # Tabs, breaks and quotes would look like layout.
    clean = F.regexp_replace("text", '[\\t\\r\\n"]+', " ")
    rows = cells.groupBy("file", "sheet", "sheet_pos", "row").agg(
        F.map_from_entries(F.collect_list(F.struct("col", clean.alias("t")))).alias("m")
    )
    last = F.array_max(F.map_keys("m"))
    filled = F.transform(F.sequence(F.lit(0), last), lambda i: F.coalesce(F.element_at("m", i), F.lit("")))
    return rows.select(
        F.concat("file", F.lit("#"), "sheet").alias("file"), F.col("file").alias("book"), "sheet", "sheet_pos", "row",
        F.lit(True).alias("in_head"), F.array_join(filled, "\t").alias("text"),
    )


def best_sheets(lines: DataFrame) -> DataFrame:
    """``book, sheet, file, score``: the sheet whose best row knows most headers, the earlier one on ties."""
    scores = file_formats(head(lines)).select("file", "score")
    sheets = lines.select("book", "sheet", "sheet_pos", "file").distinct().join(scores, "file")
    first = Window.partitionBy("book").orderBy(F.desc("score"), "sheet_pos")
    return sheets.withColumn("k", F.row_number().over(first)).filter("k = 1").select("book", "sheet", "file", "score")


def canonical_cells(cells: DataFrame) -> DataFrame:
    """Canonical text table from the best sheet of every workbook's cells."""
    # Written once: the choice of sheets, the formats, the filled columns and the rows all read it.
    lines = cut_lineage(sheet_lines(cells))
    chosen = best_sheets(lines).select("file")
    return to_canonical(lines.join(chosen, "file", "left_semi").select("file", "row", "in_head", "text"))


def read_workbooks(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Canonical text table from the best sheet of every workbook."""
    return canonical_cells(read_cells(spark, paths))


# Parts that every written workbook has.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_STYLES = f'<styleSheet xmlns="{_MAIN}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'


def _sheet(rows: Sequence[Sequence[object]], shared: dict[str, int]) -> str:
    """A sheet of rows of texts (shared), numbers, days and gaps."""
    out = []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, value in enumerate(row):
            ref = f"{chr(65 + c)}{r}"
            if isinstance(value, str):
                cells.append(f'<c r="{ref}" t="s"><v>{shared.setdefault(value, len(shared))}</v></c>')
            elif isinstance(value, datetime.date):
                cells.append(f'<c r="{ref}" s="1"><v>{(datetime.datetime.combine(value, datetime.time()) - _EPOCH).days}</v></c>')
            elif value is not None and not pd.isna(value):
                cells.append(f'<c r="{ref}"><v>{value!r}</v></c>')
        out.append(f'<row r="{r}">{"".join(cells)}</row>')
    return f'<worksheet xmlns="{_MAIN}"><sheetData>{"".join(out)}</sheetData></worksheet>'


def workbook_bytes(sheets: dict[str, Sequence[Sequence[object]]]) -> bytes:
    """A workbook of named sheets of at most 26 columns."""
    shared: dict[str, int] = {}
    parts = [_sheet(rows, shared) for rows in sheets.values()]
    names = "".join(f'<sheet name="{saxutils.escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
    links = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(parts) + 1))
    texts = "".join(f'<si><t xml:space="preserve">{saxutils.escape(t)}</t></si>' for t in shared)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_RELATIONS}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{_MAIN}">{texts}</sst>')
        z.writestr("xl/styles.xml", _STYLES)
        for i, part in enumerate(parts, 1):
            z.writestr(f"xl/worksheets/s{i}.xml", part)
    return held.getvalue()


def workbooks(samples: DataFrame, columns: dict[str, str], key: str = "sample_seq", rows: int = 2000) -> DataFrame:
    """``path, content`` of workbooks of about ``rows`` samples each: a sheet of notes, then the data under a title line (columns: source column, header)."""
    n = samples.count()
    heads = list(columns.values())

    def build(number: tuple, part: pd.DataFrame) -> pd.DataFrame:
        body = part.sort_values(key)[list(columns)].astype(object).to_numpy().tolist()
        notes = [["about this book"], ["made for", float(len(body)), "samples"]]
        content = workbook_bytes({"notes": notes, "data": [["Campaign sheet"], [], heads, *body]})
        return pd.DataFrame({"path": [f"book-{number[0]}.xlsx"], "content": [content]})

    book = F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // rows))))
    return samples.select(key, *columns, book.alias("book")).groupBy("book").applyInPandas(build, "path string, content binary")
