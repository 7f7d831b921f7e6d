"""XLSX files as rows, by the standard library alone, and as a Python data source ``xlsx_rows``.

One row per sheet row: path, sheet, sheet_no, row (from 0), cells (array of strings, merged
areas filled with their first cell's value).  Hidden sheets are left out.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .office import _each

MAX_ROWS, MAX_COLUMNS = 20_000, 80
SCHEMA = "path string, sheet string, sheet_no int, row int, cells array<string>"
#: Built-in number formats that show a date or a time.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


def format_value(value: float, is_date: bool) -> str:
    """A number as the reader shows it: dates in ISO form, whole numbers without a point."""
    if is_date:
        stamp = dt.datetime(1899, 12, 30) + dt.timedelta(seconds=round(value * 86400))
        return stamp.date().isoformat() if stamp.time() == dt.time() else stamp.isoformat(sep=" ", timespec="seconds")
    return str(int(value)) if value == int(value) else f"{value:g}"


def read_workbook(data: bytes, as_is: bool = False):
    """(sheet, sheet number, row number, cells) of every visible sheet.

    Rows are numbered among those that hold anything, and a merged range shows its text in every cell; ``as_is``, rows keep
    their place in the sheet, however many there are, and only the first cell of a merged range shows its text.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = [_text(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        dates: list[bool] = []
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            custom = {int(n.get("numFmtId")): n.get("formatCode", "") for n in styles.iter() if _local(n.tag) == "numFmt"}
            for group in styles:
                if _local(group.tag) == "cellXfs":
                    for xf in group:
                        k = int(xf.get("numFmtId", 0))
                        dates.append(k in DATE_FORMATS or bool(re.search("[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", custom.get(k, "")), re.I)))
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        for number, s in enumerate(n for n in book.iter() if _local(n.tag) == "sheet"):
            if s.get("state", "visible") != "visible":
                continue
            target = rels[next(v for k, v in s.attrib.items() if _local(k) == "id")]
            root = ElementTree.fromstring(z.read("xl/" + target.lstrip("/").removeprefix("xl/")))
            grid: dict[int, dict[int, str]] = {}
            for row in root.iter():
                if _local(row.tag) != "row":
                    continue
                r = int(row.get("r", len(grid) + 1)) - 1
                if r >= MAX_ROWS and not as_is:
                    break
                for c in row:
                    col = _column(c.get("r", "")) if c.get("r") else len(grid.get(r, {}))
                    if col >= MAX_COLUMNS:
                        continue
                    raw = next((v.text or "" for v in c if _local(v.tag) == "v"), "")
                    formula = next((v.text or "" for v in c if _local(v.tag) == "f"), "")
                    kind = c.get("t", "n")
                    if kind == "s" and raw:
                        value = shared[int(raw)]
                    elif kind == "inlineStr":
                        value = _text(c)
                    elif kind == "b":
                        value = "是" if raw == "1" else "否"
                    elif kind == "n" and raw:
                        style = int(c.get("s", 0))
                        value = format_value(float(raw), style < len(dates) and dates[style])
                    else:
                        value = raw or (f"={formula}" if formula else "")
                    grid.setdefault(r, {})[col] = " ".join(value.split())
            for m in root.iter():
                if _local(m.tag) == "mergeCell" and not as_is:
                    a, _, b = m.get("ref").partition(":")
                    top, left = int(re.sub(r"\D", "", a)) - 1, _column(a)
                    bottom, right = int(re.sub(r"\D", "", b or a)) - 1, _column(b or a)
                    value = grid.get(top, {}).get(left, "")
                    for r in range(top, min(bottom, MAX_ROWS - 1) + 1):
                        for c in range(left, min(right, MAX_COLUMNS - 1) + 1):
                            grid.setdefault(r, {})[c] = value
            for i, r in enumerate(sorted(k for k, v in grid.items() if any(v.values()))):
                cells = grid[r]
                yield s.get("name"), number, r if as_is else i, [cells.get(c, "") for c in range(max(cells) + 1)]


def write_workbook(sheets: dict[str, list[list[object]]]) -> bytes:
    """A plain workbook of text and number cells."""
    from xml.sax.saxutils import escape

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1)) + "</Types>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            body = []
            for r, row in enumerate(rows, 1):
                cells = "".join(f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) and not isinstance(v, bool) else f'<c t="inlineStr"><is><t>{escape("" if v is None else str(v))}</t></is></c>' for v in row)
                body.append(f'<row r="{r}">{cells}</row>')
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(body)}</sheetData></worksheet>')
    return out.getvalue()


def rows_of(files: DataFrame, as_is: bool = False) -> DataFrame:
    """Rows of all workbooks of a ``binaryFile`` DataFrame (path, content), as ``read_workbook`` gives them; files that are no workbooks, or broken ones, give none."""

    def parse(content):
        return read_workbook(content, as_is) if content[:2] == b"PK" else ()

    return _each(files, parse, SCHEMA)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            for sheet, number, row, cells in read_workbook(f.read()):
                yield partition.path, sheet, number, row, cells


class XlsxRows(DataSource):
    """``spark.read.format("xlsx_rows").load(path)`` for files that executors can open; else use :func:`rows_of`."""

    @classmethod
    def name(cls):
        return "xlsx_rows"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


#: Reader by extension; the others need a service or a parser that is not here.
FORMATS = {"xlsx": "workbook", "md": "markdown", "txt": "text", "csv": "csv", "json": "json", "html": "html", "htm": "html", "zip": "archive", "pdf": "pdf", "docx": "docx", "pptx": "external", "png": "external", "jpg": "external", "jpeg": "external"}


def reader_for(path) -> "F.Column":
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit("unsupported")
    for e, r in FORMATS.items():
        out = F.when(ext == e, F.lit(r)).otherwise(out)
    return out


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content, reader of all files under a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", "content", reader_for(F.col("path")).alias("reader"))
