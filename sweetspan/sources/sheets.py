"""Spreadsheets (.xlsx) as tables, read by tasks: a zip of XML parts, streamed row by row.

Files come as binary rows, so any file system that Spark reads will do, and a
folder of workbooks is read by many tasks; one workbook is one task's, which is
bounded by the format (1,048,576 rows a sheet).  Numbers, shared and inline texts,
booleans and the last results of formulas are read; cells with a date format
become texts as the CSV exports have them (``M/d/yyyy``, ``H:mm:ss``, or both);
error cells are null.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.workers import ship

#: Namespaces of the format, and its built-in numbers of date and time formats.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATES, TIMES, BOTH = {14, 15, 16, 17}, {18, 19, 20, 21, 45, 46, 47}, {22}
#: Rows of an Arrow batch.
ROWS = 4096


class SheetError(ValueError):
    """A file that isn't a workbook, or lacks the sheet."""


def _kinds(book: zipfile.ZipFile) -> list[str]:
    """What each cell style shows: a date, a time, both or a plain value."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.parse(book.open("xl/styles.xml")).getroot()
    own = {}
    for f in root.iter(f"{MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", "")).lower()
        day, hour = bool(re.search("[yd]", code)), bool(re.search("[hs]", code))
        own[int(f.get("numFmtId"))] = "both" if day and hour else "date" if day else "time" if hour else ""
    out = []
    styles = root.find(f"{MAIN}cellXfs")
    for x in styles if styles is not None else ():
        k = int(x.get("numFmtId", 0))
        out.append(own.get(k, "date" if k in DATES else "time" if k in TIMES else "both" if k in BOTH else ""))
    return out


def _shown(value: str, kind: str, early: bool) -> str:
    """A serial number as the text of a date, a time or both; ``early``: days count from 1904."""
    seconds = round(float(value) * 86_400)
    at = dt.datetime(1904, 1, 1) if early else dt.datetime(1899, 12, 30)
    at += dt.timedelta(seconds=seconds)
    day, time = f"{at.month}/{at.day}/{at.year}", f"{at.hour}:{at.minute:02}:{at.second:02}"
    if kind == "time" or kind == "both" and seconds < 86_400:
        return time
    return day if kind == "date" else f"{day} {time}"


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _text(node: ElementTree.Element) -> str:
    """The text of a string item, without its phonetic parts."""
    return "".join(t.text or "" for part in node if part.tag != f"{MAIN}rPh" for t in ([part] if part.tag == f"{MAIN}t" else part.iter(f"{MAIN}t")))


def rows_of(content: bytes, path: str, sheet: int | str = 0) -> Iterator[list[str | None]]:
    """The rows of a sheet (by place or name) as texts; rows without cells are left out."""
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        root = ElementTree.parse(book.open("xl/workbook.xml")).getroot()
        links = {r.get("Id"): r.get("Target") for r in ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()}
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as broken:
        raise SheetError(f"{path!r} is no .xlsx workbook: {broken}") from broken
    sheets = [(s.get("name"), links.get(s.get(LINK), "")) for s in root.iter(f"{MAIN}sheet")]
    found = [t for k, (name, t) in enumerate(sheets) if sheet in (k, name)]
    if not found:
        raise SheetError(f"{path!r} has no sheet {sheet!r}, only {[name for name, _ in sheets]}")
    part = found[0].lstrip("/") if found[0].startswith("/") else f"xl/{found[0]}"
    if part not in book.namelist():
        raise SheetError(f"{path!r} lacks the part {part!r} of sheet {sheet!r}")
    settings = root.find(f"{MAIN}workbookPr")
    early = settings is not None and settings.get("date1904") in ("1", "true")
    kinds, shared = _kinds(book), []
    if "xl/sharedStrings.xml" in book.namelist():
        for _, node in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
            if node.tag == f"{MAIN}si":
                shared.append(_text(node))
                node.clear()
    try:
        for _, node in ElementTree.iterparse(book.open(part)):
            if node.tag != f"{MAIN}row":
                continue
            row: list[str | None] = []
            for cell in node.iter(f"{MAIN}c"):
                at = _column(cell.get("r", "")) if cell.get("r") else len(row)
                row += [None] * (at + 1 - len(row))
                value, kind = cell.findtext(f"{MAIN}v"), cell.get("t", "n")
                if kind == "inlineStr":
                    inner = cell.find(f"{MAIN}is")
                    value = _text(inner) if inner is not None else None
                elif value is not None and kind == "s":
                    value = shared[int(value)]
                elif value is not None and kind == "b":
                    value = "true" if value == "1" else "false"
                elif kind == "e":
                    value = None
                elif value is not None and kind == "n":
                    style = int(cell.get("s", 0))
                    value = _shown(value, kinds[style], early) if style < len(kinds) and kinds[style] else value
                row[at] = value
            node.clear()
            if any(v is not None for v in row):
                yield row
    except (ElementTree.ParseError, IndexError, ValueError) as broken:
        raise SheetError(f"{path!r}, sheet {sheet!r}: {broken}") from broken


def read_sheet(spark: SparkSession, path: str, schema: StructType | None = None, sheet: int | str = 0) -> DataFrame:
    """A sheet whose first row is the header; ``path`` is a file or a pattern of files with equal headers.

    With a schema its columns are taken by name, wherever they stand; cells that
    don't fit are null, and a column that a file lacks is an error.  Without one,
    columns are double if all their cells are numbers, else text.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def heads(batches):
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield pa.RecordBatch.from_pylist([{"path": p, "head": next(rows_of(content.as_py(), p, sheet), [])}], schema=pa.schema([("path", pa.string()), ("head", pa.list_(pa.string()))]))

    head = files.mapInArrow(heads, "path string, head array<string>").select("head").distinct().limit(2).collect()
    if len(head) > 1 and schema is None:
        raise SheetError(f"the workbooks of {path!r} have different headers")
    known = [c for c in (head[0]["head"] if head else []) if c]
    names = [f.name for f in schema] if schema else list(dict.fromkeys(known))

    def read(batches):
        shape = pa.schema([(f"c{k}", pa.string()) for k in range(len(names))])
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = rows_of(content.as_py(), p, sheet)
                own = next(rows, [])
                lacking = [c for c in names if c not in own]
                if lacking:
                    raise SheetError(f"{p!r} has no column {lacking}")
                places, some = [own.index(c) for c in names], []
                for row in rows:
                    some.append([row[k] if k < len(row) else None for k in places])
                    if len(some) == ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some, strict=True)], schema=shape)
                        some = []
                if some and names:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some, strict=True)], schema=shape)

    if not names:
        raise SheetError(f"sheet {sheet!r} of {path!r} has no header")
    df = files.mapInArrow(read, ", ".join(f"c{k} string" for k in range(len(names))))
    if schema:
        return df.select(*(F.col(f"c{k}").try_cast(f.dataType).alias(f.name) for k, f in enumerate(schema)))
    plain = df.agg(*(F.count_if(F.col(f"c{k}").isNotNull() & F.col(f"c{k}").try_cast("double").isNull()).alias(f"c{k}") for k in range(len(names)))).first()
    return df.select(*((F.col(f"c{k}").cast("double") if plain[f"c{k}"] == 0 else F.col(f"c{k}")).alias(c) for k, c in enumerate(names)))
