"""Queries over PDF files, which are made from the tables' rows, one file a row, and read back."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from ..sources import office, pdf
from .files import _files, _spread
from .inputs import table

_CMAP = b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange endcmap"


def write_pdf(pages: list[list[tuple[float, float, float, str]]]) -> bytes:
    """A file with the given (left, distance from the top, size, text) on each page of 600 by 800."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>", b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /X /DW 500 >>"]

    def stream(data: bytes) -> int:
        packed = zlib.compress(data)
        objects.append(b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(packed), packed))
        return len(objects)

    stream(_CMAP)
    kids = []
    for page in pages:
        lines = b"\n".join(b"BT /F1 %g Tf %g %g Td <%s> Tj ET" % (size, x, 800 - y, text.encode("utf-16-be").hex().encode()) for x, y, size, text in page)
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >> >>" % stream(lines))
        kids.append(len(objects))
    objects[1] = b"<< /Type /Pages /MediaBox [0 0 600 800] /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1))
    return b"%PDF-1.5\n" + body + b"trailer << /Root 1 0 R >>\n%%EOF"


def sheet(rows: list[list], y: float, x: float = 50) -> list[tuple]:
    """Rows of cells, 120 apart."""
    return [(x + 120 * k, y + 14 * i, 10, str(c)) for i, r in enumerate(rows) for k, c in enumerate(r) if str(c)]


def _letter(name, segment, key, nation) -> bytes:
    text = [(50, 60, 18, name), (50, 90, 10, f"segment {segment} of the customer with"), (50, 102, 10, "the nation below"), (50, 140, 12, "Keys")]
    return write_pdf([text + sheet([["key", "nation"], [key, nation], ["none", ""], ["", "last"]], 170), [(50, 60, 10, "second page")], []])


def _letters(spark, d):
    c = _spread(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), "c_custkey")
    f = _files(c, F.concat(F.lit("c"), "c_custkey"), _letter, "c_name", "c_mktsegment", "c_custkey", "c_nationkey")
    odd = spark.createDataFrame([("no pdf", b"PK"), ("cut", b"%PDF-1.5\n1 0 obj\n<< /Type /Catalog"), ("locked", b"%PDF-1.5\n1 0 obj\n<< /Type /Catalog >>\nendobj\ntrailer << /Root 1 0 R /Encrypt 2 0 R >>"), ("empty", None)], "path string, content binary")
    return pdf.pages(f.unionByName(odd))


def pdf_blocks(spark, d):
    b = pdf.blocks(_letters(spark, d))
    return b.select("path", "seq", "page", "type", "text", "level", F.array_join(F.flatten("rows"), "|").alias("cells"))


def pdf_markdown(spark, d):
    return office.blocks_markdown(pdf.blocks(_letters(spark, d)))


def pdf_page_texts(spark, d):
    return pdf.page_texts(_letters(spark, d))


def _report(keys, dates, states) -> bytes:
    rows = [[d, f"no {k}", s, ""] for k, d, s in sorted(zip(keys, dates, states))]
    head = [["Report", "of", "orders"], ["日期", "订单", "状态"]]
    return write_pdf([[(50, 40, 10, "Daily")] + sheet(head + rows[i : i + 25], 60) for i in range(0, len(rows), 25)])


def pdf_grid(spark, d):
    """Order reports of forty days each, over two pages that repeat the header."""
    o = table(spark, d, "orders").select((F.col("o_orderkey") / 160).cast("long").alias("g"), F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.col("o_orderstatus").alias("s"))
    files = _spread(o, "g").groupBy("g").agg(F.collect_list("k").alias("k"), F.collect_list("d").alias("d"), F.collect_list("s").alias("s"))
    g = pdf.grid(pdf.pages(_files(files, F.col("g").cast("string"), _report, "k", "d", "s")))
    return g.select("path", "row", F.array_join("cells", "|").alias("cells"))


QUERIES = {f.__name__: f for f in (pdf_blocks, pdf_markdown, pdf_page_texts, pdf_grid)}

_PARTS = "SELECT 'c' || c_custkey path, c_name h, 'segment ' || c_mktsegment || ' of the customer with the nation below' p, c_custkey k, c_nationkey n FROM customer"
ORACLE_SQL = {
    "pdf_blocks": f"SELECT path, u.s seq, u.g page, u.t AS type, u.x AS text, u.l AS level, u.c cells FROM (SELECT path, unnest([{{'s': 1, 'g': 1, 't': 'heading', 'x': h, 'l': 1, 'c': NULL}}, {{'s': 2, 'g': 1, 't': 'paragraph', 'x': p, 'l': 0, 'c': NULL}}, {{'s': 3, 'g': 1, 't': 'heading', 'x': 'Keys', 'l': 3, 'c': NULL}}, {{'s': 4, 'g': 1, 't': 'table', 'x': '', 'l': 0, 'c': 'key|nation|' || k || '|' || n || '|none|||last'}}, {{'s': 5, 'g': 2, 't': 'paragraph', 'x': 'second page', 'l': 0, 'c': NULL}}]) u FROM ({_PARTS}))",
    "pdf_markdown": f"SELECT path, '# ' || h || chr(10) || chr(10) || p || chr(10) || chr(10) || '### Keys' || chr(10) || chr(10) || '| key | nation |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || k || ' | ' || n || ' |' || chr(10) || '| none |  |' || chr(10) || '|  | last |' || chr(10) || chr(10) || 'second page' markdown FROM ({_PARTS})",
    "pdf_page_texts": "SELECT path, 1 page, concat_ws(chr(10), h, replace(p, ' the nation below', chr(10) || 'the nation below'), 'Keys', 'key nation', k || ' ' || n, 'none', 'last', 'key | nation', k || ' | ' || n, 'none | ', ' | last') AS text FROM (" + _PARTS + ") UNION ALL SELECT 'c' || c_custkey, 2, 'second page' FROM customer",
    "pdf_grid": """WITH o AS (SELECT o_orderkey // 160 g, o_orderkey k, strftime(o_orderdate, '%Y-%m-%d') || '|no ' || o_orderkey || '|' || o_orderstatus c FROM orders),
r AS (SELECT CAST(g AS VARCHAR) path, 2 + row_number() OVER (PARTITION BY g ORDER BY k) AS row, c FROM o)
SELECT path, CAST(row AS INT) AS row, c cells FROM r UNION ALL SELECT DISTINCT path, 1, 'Report|of|orders' FROM r UNION ALL SELECT DISTINCT path, 2, '日期|订单|状态' FROM r""",
}
