"""Spreadsheet files as long rows (file, sheet, sheet_idx, row_idx, cells), row 0 the header; and back.

csv and tsv are parsed by whole files as workbooks of one sheet; xlsx and xlsm are zip archives of XML, ods likewise, read with the standard library; the binary formats xls and
xlsb are in ``binary_sheets``. A sheet without rows is one row whose row_idx and cells are null, so that it is written again. A file is read by one task, since its rows depend on what stands before; large flat data belongs in ``read_delimited``, which Spark splits.
"""

from __future__ import annotations

import csv
import io
import re
import struct
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrel.operators.uploads import LARGEST, is_allowed_size, is_spreadsheet
from carrel.sources.binary_sheets import COMPOUND, ods_bytes, xls_bytes, xls_sheets, xlsb_bytes, xlsb_sheets

ROWS = "file string, sheet string, sheet_idx int, row_idx long, cells array<string>"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
OFFICE = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"
TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
#: Built-in number formats that are dates.
DATE_FORMATS = frozenset({14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47})
#: Repeats of empty cells and rows that are taken as padding.
PADDING = 1000

Sheets = list[tuple[str, list[list[str | None]]]]


def column_of(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def number_text(v: str) -> str:
    """As a spreadsheet shows it: 7.0 as 7."""
    try:
        x = float(v)
    except ValueError:
        return v
    return str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)


def date_text(v: str) -> str:
    t = datetime(1899, 12, 30) + timedelta(days=float(v))
    return (t + timedelta(microseconds=500)).replace(microsecond=0).isoformat(sep=" ")


def is_date(place: int, pattern: str | None) -> bool:
    """Whether a number format shows dates: a built-in one by its place, another by its pattern."""
    return place in DATE_FORMATS if pattern is None else re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", pattern), re.I) is not None and pattern.lower() != "general"


def shown(x: float, date: bool) -> str:
    return date_text(repr(x)) if date else number_text(repr(x))


def xlsx_sheets(data: bytes) -> Sheets:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        xml = lambda n: ElementTree.fromstring(z.read(n))
        shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in xml("xl/sharedStrings.xml").iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        dates: set[int] = set()
        if "xl/styles.xml" in names:
            styles = xml("xl/styles.xml")
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{MAIN}numFmt")}
            cells = styles.find(f"{MAIN}cellXfs")
            formats = [int(x.get("numFmtId", 0)) for x in (cells if cells is not None else [])]
            dates = {i for i, f in enumerate(formats) if is_date(f, own.get(f))}
        targets = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels")}
        out: Sheets = []
        for s in xml("xl/workbook.xml").iter(f"{MAIN}sheet"):
            target = targets[s.get(f"{REL}id")].lstrip("/")
            rows: list[list[str | None]] = []
            for r in xml(target if target.startswith("xl/") else f"xl/{target}").iter(f"{MAIN}row"):
                at = int(r.get("r", len(rows) + 1)) - 1
                rows += [[] for _ in range(at - len(rows))]
                cells_: list[str | None] = []
                for c in r.iter(f"{MAIN}c"):
                    k = column_of(c.get("r")) if c.get("r") else len(cells_)
                    cells_ += [None] * (k - len(cells_))
                    v, kind = c.find(f"{MAIN}v"), c.get("t")
                    if kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                    elif v is None or v.text is None:
                        value = None
                    elif kind == "s":
                        value = shared[int(v.text)]
                    elif kind == "b":
                        value = "true" if v.text == "1" else "false"
                    elif kind in ("str", "e", "d"):
                        value = v.text
                    else:
                        value = date_text(v.text) if int(c.get("s", 0)) in dates else number_text(v.text)
                    cells_.append(value)
                rows.append(cells_)
            out.append((s.get("name"), rows))
        return out


def paragraph(p: ElementTree.Element) -> str:
    """The text of a paragraph of an OpenDocument file, whose runs of spaces, tabs and breaks are elements."""
    marks = {f"{TEXT}s": " ", f"{TEXT}tab": "\t", f"{TEXT}line-break": "\n"}
    inner = lambda e: marks[e.tag] * int(e.get(f"{TEXT}c", 1)) if e.tag in marks else paragraph(e)
    return (p.text or "") + "".join(inner(e) + (e.tail or "") for e in p)


def ods_sheets(data: bytes) -> Sheets:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    out: Sheets = []
    for t in root.iter(f"{TABLE}table"):
        rows: list[list[str | None]] = []
        for r in t.iter(f"{TABLE}table-row"):
            cells: list[str | None] = []
            for c in r:
                if c.tag not in (f"{TABLE}table-cell", f"{TABLE}covered-table-cell"):
                    continue
                kind = c.get(f"{OFFICE}value-type")
                text = "\n".join(paragraph(p) for p in c.iter(f"{TEXT}p"))
                value = None if kind is None and not text else number_text(c.get(f"{OFFICE}value")) if kind == "float" else c.get(f"{OFFICE}date-value") if kind == "date" else text
                n = int(c.get(f"{TABLE}number-columns-repeated", 1))
                cells += [value] * (n if value is not None or n < PADDING else 0)
            while cells and cells[-1] is None:
                cells.pop()
            n = int(r.get(f"{TABLE}number-rows-repeated", 1))
            rows += [list(cells) for _ in range(n if cells or n < PADDING else 0)]
        while rows and not rows[-1]:
            rows.pop()
        out.append((t.get(f"{TABLE}name"), rows))
    return out


def delimited_sheets(data: bytes, sep: str) -> Sheets:
    return [("Sheet1", [list(r) for r in csv.reader(io.StringIO(data.decode("utf-8-sig")), delimiter=sep)])]


def sheets(name: str, data: bytes) -> Sheets:
    """The sheets of a file, its format told by content first, then by name."""
    ext = name.rpartition(".")[2].lower()
    if data[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
        if "content.xml" in names:
            return ods_sheets(data)
        if "xl/workbook.bin" in names:
            return xlsb_sheets(data, shown, is_date)
        return xlsx_sheets(data)
    if data[:8] == COMPOUND:
        try:
            return xls_sheets(data, shown, is_date)
        except (struct.error, IndexError) as e:
            raise ValueError(f"{name}: damaged") from e
    if ext in ("csv", "tsv", "txt"):
        return delimited_sheets(data, "\t" if ext != "csv" else ",")
    raise ValueError(f"{name}: not a spreadsheet")


def read_workbooks(spark: SparkSession, path: str, largest: int = LARGEST) -> DataFrame:
    """ROWS of all spreadsheets below a path. Files of another type, or above the limit, are left out; ``refused_files`` names them."""
    files = spark.read.format("binaryFile").load(path)
    files = files.filter(is_spreadsheet(F.col("path"), F.lit(None).cast("string")) & is_allowed_size(F.col("length"), largest)).select("path", "content")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, data in zip(b.path, b.content, strict=True):
                for k, (sheet, rows) in enumerate(sheets(p, bytes(data))):
                    if not rows:
                        yield pd.DataFrame({"file": [p], "sheet": [sheet], "sheet_idx": [k], "row_idx": pd.array([None], "Int64"), "cells": [None]})
                    for at in range(0, len(rows), 10_000):
                        part = rows[at : at + 10_000]
                        n = len(part)
                        yield pd.DataFrame({"file": [p] * n, "sheet": [sheet] * n, "sheet_idx": [k] * n, "row_idx": pd.array(range(at, at + n), "Int64"), "cells": part})

    return files.mapInPandas(task, ROWS)


def refused_files(spark: SparkSession, path: str, largest: int = LARGEST) -> DataFrame:
    """(file, length, error) of the files below a path that ``read_workbooks`` leaves out: ``type`` or ``size``. Contents are not read."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    error = F.when(~is_spreadsheet(F.col("file"), F.lit(None).cast("string")), "type").when(~is_allowed_size(F.col("length"), largest), "size")
    return files.withColumn("error", error).filter("error IS NOT NULL")


def sheet_shapes(rows: DataFrame) -> DataFrame:
    """(file, sheet, sheet_idx, total_rows, total_columns) of ROWS: rows without the header, and headers; 0 and 0 for an empty sheet."""
    columns = F.max(F.when(F.col("row_idx") == 0, F.size("cells")))
    g = rows.groupBy("file", "sheet", "sheet_idx").agg(F.count_if(F.col("row_idx") > 0).alias("total_rows"), columns.alias("total_columns"))
    return g.withColumn("total_columns", F.coalesce("total_columns", F.lit(0)))


def with_headers(rows: DataFrame) -> DataFrame:
    """ROWS with the header row of their sheet beside each row. Headers are one row for each sheet."""
    heads = rows.filter("row_idx = 0").select("file", "sheet_idx", F.col("cells").alias("headers"))
    return rows.join(heads, ["file", "sheet_idx"], "left")


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A large csv or tsv with a header, all columns text, split by Spark. Empty cells and those absent at the end of a row are ''."""
    return spark.read.csv(path, sep=sep, header=True, inferSchema=False, emptyValue="", nullValue="\u0000", multiLine=False).na.fill("")


def xlsx_bytes(book: Sheets) -> bytes:
    """A workbook with inline strings."""
    letters = lambda k: (letters(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        part = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        over = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="{part}.worksheet+xml"/>' for i in range(len(book)))
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" '
                   f'ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{part}.sheet.main+xml"/>{over}</Types>')
        rels = "http://schemas.openxmlformats.org/package/2006/relationships"
        kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{rels}"><Relationship Id="r1" Type="{kind}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{rels}">' + "".join(
            f'<Relationship Id="r{i + 1}" Type="{kind}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(book))) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{MAIN[1:-1]}" xmlns:r="{REL[1:-1]}"><sheets>' + "".join(
            f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="r{i + 1}"/>' for i, (n, _) in enumerate(book)) + "</sheets></workbook>")
        for i, (_, rows) in enumerate(book):
            body = "".join(
                f'<row r="{r + 1}">' + "".join(
                    f'<c r="{letters(k)}{r + 1}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for k, v in enumerate(row) if v is not None) + "</row>"
                for r, row in enumerate(rows))
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<?xml version="1.0"?><worksheet xmlns="{MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def file_bytes(name: str, book: Sheets) -> bytes:
    """A workbook in the format of its name; xlsx where that is not known."""
    ext = name.rpartition(".")[2].lower()
    if ext in ("csv", "tsv"):
        out = io.StringIO()
        w = csv.writer(out, delimiter="," if ext == "csv" else "\t", lineterminator="\n")
        for r in book[0][1] if book else []:
            w.writerow(["" if v is None else v for v in r])
        return out.getvalue().encode()
    return {"xls": xls_bytes, "xlsb": xlsb_bytes, "ods": ods_bytes}.get(ext, xlsx_bytes)(book)


def workbook_files(rows: DataFrame) -> DataFrame:
    """(file, content): ROWS put together to one file each, in sheet and row order; sheets without rows too."""

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sheet_idx", "row_idx"])
        book = [(g.sheet.iloc[0], [list(c) if c is not None else [] for c in g.cells[g.row_idx.notna()]]) for _, g in pdf.groupby("sheet_idx")]
        return pd.DataFrame({"file": [pdf.file.iloc[0]], "content": [file_bytes(pdf.file.iloc[0], book)]})

    return rows.groupBy("file").applyInPandas(task, "file string, content binary")
