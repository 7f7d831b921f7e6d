"""Readers of DOCX files, HTML pages, conversion archives and attendance ledgers, with the standard library only.

A file is one row of a ``binaryFile`` DataFrame (path, content) and is parsed where it lies; what is broken or of another kind
gives no rows, whatever it is that fails.  The helpers take one file's bytes and yield its rows; a task holds the rows of one file, or of some small ones.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from .records import parse_date

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
BLOCKS = "path string, seq int, type string, text string, level int, rows array<array<string>>, image string"
IMAGES = "path string, name string, mime string, page int, caption string, heading string, bytes binary"
#: fixed values: image types by extension, the marks of a ledger sheet
MIME = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp", ".bmp": "image/bmp"}
#: Columns that a word processor allows a table, the most a merged cell can span.
MOST_COLUMNS = 63
#: Rows, and bytes of files, that a task reads before it hands on what it has.
HELD_ROWS, HELD_BYTES = 1024, 1 << 20
SEQ, IN, OUT = "序号", "上班", ("下班", "下")
HEADINGS = ("中心", "岗位", "姓名")
SYMBOLS = {"√": "√✓☑", "￥": "￥¥", "＄": "＄$", "×": "×xX✕", "★": "★*"}


def _each(files: DataFrame, parse: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    kinds = to_arrow_schema(DataType.fromDDL(schema))
    return files.select("path", "content").mapInArrow(lambda batches: _parsed(batches, parse, kinds), schema)


def _parsed(batches: Iterator, parse: Callable[[bytes], Iterator[tuple]], kinds) -> Iterator:
    """Batches of the files' rows, handed on as soon as HELD_ROWS rows or HELD_BYTES bytes of files were read."""
    import pyarrow as pa

    out, read = [], 0
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)
    for b in batches:
        for path, content in zip(b.column(0), b.column(1)):
            path, content = path.as_py(), content.as_py() or b""
            try:
                out += [(path, *r) for r in parse(content)]
            except Exception:  # whatever a broken, encrypted or odd file raises is that file's alone
                continue
            read += len(content)
            if out and (len(out) >= HELD_ROWS or read >= HELD_BYTES):
                yield pack(out)
                out, read = [], 0
    if out:
        yield pack(out)


def _style_level(name: str, key: str) -> int:
    hit = re.search(r"(?:heading|标题)\s*([1-6])", f"{name}\n{key}", re.I)
    return int(hit[1]) if hit else int(name.strip().lower() in ("title", "标题"))


def _words(node) -> str:
    got = {W + "t": lambda n: n.text or "", W + "tab": lambda n: "\t", W + "br": lambda n: "\n"}
    return "".join(got[n.tag](n) for n in node.iter() if n.tag in got)


def _grid(table) -> list[list[str]]:
    """Cell texts; a cell merged over columns or rows shows its text once."""
    out = []
    for tr in table.iter(W + "tr"):
        row = []
        for tc in tr.findall(W + "tc"):
            pr = tc.find(W + "tcPr")
            span = None if pr is None else pr.find(W + "gridSpan")
            down = None if pr is None else pr.find(W + "vMerge")
            goes_on = down is not None and down.get(W + "val", "continue") == "continue"
            text = "" if goes_on else " ".join(_words(p) for p in tc.findall(W + "p")).replace("\n", " ").strip()
            wide = "1" if span is None else span.get(W + "val", "1")
            row += [text] + [""] * (min(int(wide), MOST_COLUMNS) - 1 if wide.isdigit() else 0)
        out.append(row)
    return out


def parse_docx(data: bytes) -> Iterator[tuple]:
    """seq, type (heading, paragraph, list, table, image), text, level, rows, image part, in order of the body."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(W + "body")
        names, parts = {}, {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(W + "style"):
                name = s.find(W + "name")
                names[s.get(W + "styleId")] = "" if name is None else name.get(W + "val", "")
        if "word/_rels/document.xml.rels" in z.namelist():
            parts = {r.get("Id"): posixpath.normpath(posixpath.join("word", r.get("Target", ""))) for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))}
    seq = 0
    for node in [] if body is None else body:
        found = []
        if node.tag == W + "tbl":
            rows = _grid(node)
            if any(c for r in rows for c in r):
                found.append(("table", "", 0, rows, None))
        elif node.tag == W + "p":
            style = node.find(f"{W}pPr/{W}pStyle")
            key = "" if style is None else style.get(W + "val", "")
            name, text = names.get(key, ""), _words(node).strip()
            level = _style_level(name, key)
            listed = node.find(f"{W}pPr/{W}numPr") is not None or name.lower().startswith("list") or "列表" in name
            if text:
                found.append(("heading" if level else "list" if listed else "paragraph", text, level, None, None))
            held = dict.fromkeys(parts.get(b.get(REL + "embed") or b.get(REL + "link")) for b in node.iter(A + "blip"))
            found += [("image", "", 0, None, p) for p in held if p]
        for f in found:
            seq += 1
            yield seq, *f


class _Page(HTMLParser):
    """Markdown lines of a page: headings, list items, table rows; scripts and styles left out."""

    BREAKS = {"p", "div", "br", "section", "article", "ul", "ol", "table", "blockquote", "pre", "title"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.now, self.mark, self.skip, self.cells, self.width = [], [], "", 0, None, 0

    def end_line(self):
        text = re.sub(r"\s+", " ", "".join(self.now)).strip()
        if text:
            self.lines.append(self.mark + text)
        self.now, self.mark = [], ""

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.end_line()
            self.mark = "#" * int(tag[1]) + " "
        elif tag == "li":
            self.end_line()
            self.mark = "- "
        elif tag == "table":
            self.end_line()
            self.width = 0
        elif tag == "tr":
            self.end_line()
            self.cells = []
        elif tag in self.BREAKS and self.cells is None:
            self.end_line()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append(re.sub(r"\s+", " ", "".join(self.now)).strip().replace("|", r"\|"))
            self.now = []
        elif tag == "tr" and self.cells is not None:
            if self.cells:
                self.lines.append("| " + " | ".join(self.cells) + " |")
                if not self.width:
                    self.lines.append("|" + " --- |" * len(self.cells))
                self.width = self.width or len(self.cells)
            self.cells, self.now = None, []
        elif (re.fullmatch("h[1-6]", tag) or tag == "li" or tag in self.BREAKS) and self.cells is None:
            self.end_line()

    def handle_data(self, data):
        if not self.skip:
            self.now.append(data)


def parse_html(data: bytes) -> Iterator[tuple]:
    page = _Page()
    page.feed(data.decode("utf-8", "replace"))
    page.close()
    page.end_line()
    yield ("\n".join(page.lines),)


def parse_csv(data: bytes) -> Iterator[tuple]:
    import csv

    csv.field_size_limit((1 << 31) - 1)  # a cell can be as long as its file
    rows = [r for r in csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"))) if any(c.strip() for c in r)]
    line = lambda r: "| " + " | ".join(c.strip().replace("|", r"\|").replace("\n", " ") for c in r) + " |"
    yield ("\n".join([line(rows[0]), "|" + " --- |" * len(rows[0]), *map(line, rows[1:])]) if rows else "",)


def parse_archive(data: bytes) -> Iterator[tuple]:
    """name, mime, page (from 1; 0 unknown), caption, heading, bytes of the images of a conversion archive.

    Its content list names the pictures in reading order; the last title before one is its heading.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names, known, heading = z.namelist(), {}, ""
        lists = [n for n in names if n.lower().endswith("content_list.json")]
        try:
            items = json.loads(z.read(lists[0]).decode("utf-8", "replace")) if lists else []
        except ValueError:
            items = []
        for item in items if isinstance(items, list) else []:
            if not isinstance(item, dict):
                continue
            if item.get("text_level"):
                heading = str(item.get("text") or "").strip()
            elif item.get("img_path"):
                said = " ".join(map(str, item.get("image_caption") or [])) or " ".join(map(str, item.get("image_footnote") or []))
                known[posixpath.basename(str(item["img_path"]))] = (int(item.get("page_idx") or 0) + 1, said.strip(), heading)
        for n in names:
            mime = MIME.get(posixpath.splitext(n)[1].lower())
            if mime and ("/images/" in n or n.startswith("images/")):
                yield n, mime, *known.get(posixpath.basename(n), (0, "", "")), z.read(n)


def docx_blocks(files: DataFrame) -> DataFrame:
    """path, seq, type, text, level, rows, image of every DOCX."""
    return _each(files, parse_docx, BLOCKS)


def archive_images(files: DataFrame) -> DataFrame:
    return _each(files, parse_archive, IMAGES)


def html_markdown(files: DataFrame) -> DataFrame:
    """path and markdown of every page, empty for an empty one."""
    return _each(files, parse_html, "path string, markdown string")


def csv_markdown(files: DataFrame) -> DataFrame:
    """path and one markdown table of every CSV file; for data, not for text to be chunked, use ``spark.read.csv``."""
    return _each(files, parse_csv, "path string, markdown string")


def blocks_markdown(blocks: DataFrame) -> DataFrame:
    """path and markdown of a file's blocks, for the chunkers; a table's first row is its header."""
    bar = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.regexp_replace(c, r"\|", r"\\|")), " | "), F.lit(" |"))
    lines = F.transform("rows", bar)
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.col("rows")[0])))
    table = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, 1 << 20)), "\n")
    text = F.when(F.col("type") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "text")).when(F.col("type") == "list", F.concat(F.lit("- "), "text")).when(F.col("type") == "table", table).when(F.col("type") == "image", F.concat(F.lit("![]("), "image", F.lit(")"))).otherwise(F.col("text"))
    return blocks.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", text.alias("t")))), lambda x: x["t"]), "\n\n").alias("markdown"))


def symbol(text: Column) -> Column:
    """A day's mark in its one form; other texts stay, trimmed."""
    t = F.trim(F.coalesce(text, F.lit("")))
    out = t
    for one, forms in SYMBOLS.items():
        out = F.when(t.isin(*forms), one).otherwise(out)
    return out


def ledger_days(rows: DataFrame, first: int = 10) -> DataFrame:
    """path, person, day, in, out from attendance ledgers: two rows per person, one column per day.

    Rows are those of a workbook (path, sheet, sheet_no, row, cells), which number the rows that hold anything.  The sheet is the first whose name has ``考勤``, else the
    first; its header is the first of ``first`` rows with ``序号`` and a date.  Day columns are headed by a date or one or two
    digits.  The out row is the next or the one after it, whichever says so; else the next.  The person's name is left of the
    side column, without blanks and without a note of having left; of two entries of one name the later counts.
    """
    rank = F.struct((~F.col("sheet").contains("考勤")).alias("a"), F.col("sheet_no"))
    pick = rows.groupBy("path").agg(F.min_by("sheet_no", rank).alias("sheet_no"))
    s = rows.join(pick, ["path", "sheet_no"], "left_semi").withColumn("cells", F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))))
    dated = lambda c: c.rlike(r"^\d{4}[-/年]\d{1,2}[-/月]\d{1,2}")
    head = s.where((F.col("row") < first) & F.array_contains("cells", SEQ) & F.exists("cells", dated))
    head = head.groupBy("path").agg(F.min(F.struct("row", "cells")).alias("h")).select("path", F.col("h.row").alias("_r"), F.col("h.cells").alias("_c"))
    days = F.filter(F.transform("_c", lambda c, i: F.struct(F.when(dated(c), F.dayofmonth(parse_date(c))).when(c.rlike(r"^\d{1,2}$"), c.cast("int")).alias("day"), i.alias("at"))), lambda d: d["day"].isNotNull())
    below = s.join(head.select("path", "_r", days.alias("_days")), "path").where(F.col("row") > F.col("_r"))
    side = F.array_position(F.slice("cells", 1, 7), IN).cast("int") - 1
    word = lambda c: (c != "") & ~c.isin(*HEADINGS)
    left = F.array_max(F.filter(F.transform(F.slice("cells", 1, F.greatest(F.col("_side"), F.lit(0))), lambda c, i: F.when(word(c), i)), lambda i: i.isNotNull()))
    near = below.where(F.col("row") <= F.col("_r") + 7).withColumn("_side", side).where("_side >= 0").withColumn("_name", left).where("_name is not null")
    near = near.groupBy("path").agg(F.min(F.struct("row", "_side", "_name")).alias("n")).select("path", F.col("n._side").alias("_side"), F.col("n._name").alias("_name"))
    b = below.join(near, "path", "left").withColumns({"_side": F.coalesce("_side", F.lit(4)), "_name": F.coalesce("_name", F.lit(3))})
    cell = lambda c, at: F.coalesce(F.get(c, at), F.lit(""))
    w = Window.partitionBy("path").orderBy("row")
    nexts = [F.when(F.lead("row", k).over(w) == F.col("row") + k, F.lead("cells", k).over(w)) for k in (1, 2)]
    b = b.withColumns({"_1": nexts[0], "_2": nexts[1]})
    says = lambda c: F.coalesce(cell(c, F.col("_side")).isin(*OUT), F.lit(False))
    out = F.when(says(F.col("_1")), F.col("_1")).when(says(F.col("_2")), F.col("_2")).otherwise(F.col("_1"))
    person = F.regexp_replace(F.regexp_replace(cell("cells", F.col("_name")), "[（(].*?离职.*?[）)]", ""), r"(?U)\s+", "")
    b = b.withColumn("_out", out).where((cell("cells", F.col("_side")) == IN) & (cell("cells", F.col("_name")) != "")).withColumn("person", person)
    last = b.withColumn("_k", F.row_number().over(Window.partitionBy("path", "person").orderBy(F.col("row").desc()))).where("_k = 1")
    d = last.select("path", "person", "cells", "_out", F.explode("_days").alias("d"))
    return d.select("path", "person", F.col("d.day").alias("day"), symbol(F.get("cells", F.col("d.at"))).alias("in"), symbol(F.get("_out", F.col("d.at"))).alias("out"))
