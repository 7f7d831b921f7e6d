"""Queries over readers: the files are made from the tables' rows, one file a row, and read back."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..sources import daily as D
from ..sources import ledger_sheet as L
from ..sources import office as O
from ..sources import workbook as W
from . import timeline
from .inputs import table

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_STYLES = f'<w:styles {_NS}><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style><w:style w:styleId="L"><w:name w:val="List Bullet"/></w:style></w:styles>'
_RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="media/a.png"/></Relationships>'


def pack(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx(title: str, item: str, cell: str) -> bytes:
    """A heading, a list item with a picture, and a table whose first cell spans two columns and the last goes on from above."""
    p = lambda style, text, more="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t>{more}</w:r></w:p>'
    c = lambda text, pr="": f"<w:tc><w:tcPr>{pr}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"
    grid = f'<w:tbl><w:tr>{c("head", "<w:gridSpan w:val=\"2\"/>")}</w:tr><w:tr>{c("k")}{c(cell, "<w:vMerge w:val=\"restart\"/>")}</w:tr><w:tr>{c("m")}{c("hidden", "<w:vMerge/>")}</w:tr></w:tbl>'
    body = p("H2", title) + p("L", item, '<w:drawing><a:blip r:embed="r1"/></w:drawing>') + p("", "") + grid
    return pack({"word/document.xml": f"<w:document {_NS}><w:body>{body}</w:body></w:document>", "word/styles.xml": _STYLES, "word/_rels/document.xml.rels": _RELS})


def archive(title: str, n: int) -> bytes:
    items = f'[{{"text_level": 1, "text": " {title} "}}, {{"img_path": "images/a.png", "page_idx": {n}, "image_caption": ["fig", "{n}"]}}, 3, {{"img_path": "x/b.JPG", "image_footnote": ["note"]}}]'
    return pack({"auto/images/a.png": title, "auto/images/b.JPG": "b", "auto/images/c.txt": "", "a.png": "", "auto/x_content_list.json": items})


def _files(df, path, make, *cols):
    build = F.pandas_udf(lambda *c: pd.Series([make(*v) for v in zip(*c)], dtype=object), "binary")
    return df.select(path.alias("path"), build(*cols).alias("content"))


def _spread(df, *keys):
    """Rows dealt by key: a table of a few megabytes is one task's, but each of its rows is a file to be written and parsed."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def docx_blocks(spark, d):
    c = table(spark, d, "customer")
    f = _files(c, F.concat(F.lit("c"), "c_custkey"), docx, "c_name", "c_mktsegment", F.col("c_custkey").cast("string"))
    b = O.docx_blocks(f.unionByName(c.select(F.lit("broken").alias("path"), F.lit(b"PK").alias("content")).limit(1)))
    return b.select("path", "seq", "type", "text", "level", "image", F.array_join(F.flatten("rows"), "|").alias("cells"))


def docx_markdown(spark, d):
    f = _files(table(spark, d, "customer"), F.concat(F.lit("c"), "c_custkey"), docx, "c_name", "c_mktsegment", F.col("c_custkey").cast("string"))
    return O.blocks_markdown(O.docx_blocks(f))


def archive_images(spark, d):
    f = _files(table(spark, d, "customer"), F.concat(F.lit("c"), "c_custkey"), archive, "c_name", "c_nationkey")
    return O.archive_images(f).select("path", "name", "mime", "page", "caption", "heading", F.length("bytes").alias("n"))


def html_markdown(spark, d):
    page = "concat('<html><head><title>t</title><style>p {}</style></head><body><h2>', source, '</h2><p>a &amp; <b>b</b><script>1 < 2</script></p><ul><li>', lang, '<li>x</ul><table><tr><th>id</th><th>p|q</th></tr><tr><td>', doc_id, '</td><td></td></tr></table></body>')"
    return O.html_markdown(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode(F.expr(page), "UTF-8").alias("content")))


def csv_markdown(spark, d):
    text = "concat('﻿id,name\r\n\r\n', o_orderkey, ',\"a, \"\"', o_orderpriority, '\"\"\"\n')"
    return O.csv_markdown(table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.encode(F.expr(text), "UTF-8").alias("content")))


def ledger_sheet_days(spark, d):
    """Attendance ledgers of fifty people, one workbook each, from workbook bytes to marks per day."""
    c = table(spark, d, "customer").select((F.col("c_custkey") / 50).cast("long").alias("g"), F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))

    def build(keys, nations):
        rows = [["x"], ["序号", "中心", "岗位", "姓名", "", "2024-01-01", "2", "调休"]]
        for k, n in sorted(zip(keys, nations)):
            rows += [[k, "c", "j", f"n {k}（已离职）" if k % 3 == 0 else f"n{k}", "上班", "✓", "*", n]] + [["", "", "", "", "备注", "", ""]] * (k % 2) + [["", "", "", "", "下班", "X", f"t{n}"]]
        return W.write_workbook({"first": [["y"]], "8月考勤": rows})

    sheets = c.groupBy("g").agg(F.collect_list("k").alias("k"), F.collect_list("n").alias("n"))
    return O.ledger_days(W.rows_of(_files(sheets, F.col("g").cast("string"), build, "k", "n")))


def _daily_sheet(keys, nations, names, others) -> bytes:
    rows = [["日报"], ["", "日期", "当前阶段", "我司人员", "", "现场施工人员"], ["", "", "", "工种", "姓名", ""]]
    for k, n, name, other in sorted(zip(keys, nations, names, others)):
        rows.append([k, f"2024-03-{1 + k % 10:02}", f"s{k % 3}", "", f"{name}、{other}", f"【公司人员】：{name} 1人【外包人员】：{other}"])
    return W.write_workbook({"日报": rows})


def _daily(spark, d):
    """Daily reports of twenty customers each, two rows a day, from workbook bytes."""
    han = lambda c: F.concat(F.lit("人"), F.translate(F.lpad((F.col(c) % 1000).cast("string"), 3, "0"), "0123456789", "赵钱孙李周吴郑王冯陈"))
    c = table(spark, d, "customer").select((F.col("c_custkey") / 20).cast("long").alias("g"), F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), han("c_custkey").alias("a"), han("c_nationkey").alias("b"))
    sheets = c.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("k", "n", "a", "b"))).alias("s")).select("g", *(F.col(f"s.{x}").alias(x) for x in ("k", "n", "a", "b")))
    return D.report(W.rows_of(_files(sheets, F.col("g").cast("string"), _daily_sheet, "k", "n", "a", "b"), as_is=True))


def daily_report_days(spark, d):
    return _daily(spark, d)[0].withColumn("work_date", F.col("work_date").cast("string"))


def daily_report_warnings(spark, d):
    return _daily(spark, d)[1]


def ledger_round_trip(spark, d):
    """The ledger, exported as one workbook a department, read back from their bytes."""
    made = timeline._ledger(spark, d).withColumn("department", F.coalesce("department", F.lit("")))
    read = L.imported(W.rows_of(L.export(made, F.col("department")), as_is=True))
    dates = F.array_join(F.transform("ot_days", lambda x: F.concat(x["date"], F.when(x["holiday"], "(法定)").otherwise(""))), "、")
    ends = [F.coalesce(f(F.transform("travel_segments", lambda s: s[c])), F.lit("")).alias(n) for f, c, n in ((F.array_min, "system_start", "system_travel_start"), (F.array_max, "system_end", "system_travel_end"), (F.array_min, "actual_start", "actual_travel_start"), (F.array_max, "actual_end", "actual_travel_end"))]
    leaves = [F.coalesce(f(F.transform("leave_segments", lambda s: s[c])), F.lit("")).alias(n) for f, c, n in ((F.array_min, "start", "leave_start"), (F.array_max, "end", "leave_end"))]
    return read.select("person_name", "center", "department", *ends, "travel_comp_days", dates.alias("ot_dates"), "ot_comp_days", "total_comp_days", *leaves, "used_comp_days", "remaining_comp_days", "remark")


QUERIES = {f.__name__: f for f in (docx_blocks, docx_markdown, archive_images, html_markdown, csv_markdown, ledger_sheet_days, daily_report_days, daily_report_warnings, ledger_round_trip)}

_HAN = "'人' || translate(lpad(CAST({} % 1000 AS VARCHAR), 3, '0'), '0123456789', '赵钱孙李周吴郑王冯陈')"
_DAILY = f"""WITH c AS (SELECT CAST(c_custkey // 20 AS VARCHAR) path, c_custkey k, {_HAN.format("c_custkey")} a, {_HAN.format("c_nationkey")} b, '2024-03-' || lpad(CAST(1 + c_custkey % 10 AS VARCHAR), 2, '0') dt, 's' || (c_custkey % 3) st, CAST(3 + row_number() OVER (PARTITION BY c_custkey // 20 ORDER BY c_custkey) AS INT) r FROM customer),
d AS (SELECT *, first_value(st) OVER w fs, min(r) OVER (PARTITION BY path, dt) fr, count(*) OVER (PARTITION BY path, dt) n FROM c WINDOW w AS (PARTITION BY path, dt ORDER BY r)),
p AS (SELECT DISTINCT path, dt work_date, u.n person_name, u.k person_kind, fs stage, fr source_row FROM (SELECT *, unnest([{{'n': a, 'k': 'internal_formal'}}, {{'n': a, 'k': 'internal_contract'}}, {{'n': b, 'k': 'internal_contract'}}]) u FROM d))"""
ORACLE_SQL = {
    "ledger_round_trip": timeline.ORACLE_SQL["ledger_full"],
    "daily_report_days": _DAILY + " SELECT * FROM p",
    "daily_report_warnings": _DAILY + """ SELECT path, 'same_day_stage_conflict' code, r AS row, dt subject FROM d WHERE st != fs UNION ALL SELECT path, 'same_day_conflict', NULL, dt FROM d WHERE n > 1 AND r = fr
UNION ALL SELECT path, 'name_kind_collision', NULL, person_name FROM p GROUP BY path, person_name HAVING count(DISTINCT person_kind) > 1""",
    "docx_blocks": "SELECT 'c' || c_custkey path, u.s seq, u.t AS type, u.x AS text, u.l AS level, u.i image, u.c cells FROM (SELECT c_custkey, unnest([{'s': 1, 't': 'heading', 'x': c_name, 'l': 2, 'i': NULL, 'c': NULL}, {'s': 2, 't': 'list', 'x': c_mktsegment, 'l': 0, 'i': NULL, 'c': NULL}, {'s': 3, 't': 'image', 'x': '', 'l': 0, 'i': 'word/media/a.png', 'c': NULL}, {'s': 4, 't': 'table', 'x': '', 'l': 0, 'i': NULL, 'c': 'head||k|' || c_custkey || '|m|'}]) u FROM customer)",
    "docx_markdown": "SELECT 'c' || c_custkey path, '## ' || c_name || chr(10) || chr(10) || '- ' || c_mktsegment || chr(10) || chr(10) || '![](word/media/a.png)' || chr(10) || chr(10) || '| head |  |' || chr(10) || '| --- | --- |' || chr(10) || '| k | ' || c_custkey || ' |' || chr(10) || '| m |  |' markdown FROM customer",
    "archive_images": "SELECT 'c' || c_custkey path, 'auto/images/a.png' AS name, 'image/png' mime, CAST(c_nationkey + 1 AS INT) page, 'fig ' || c_nationkey caption, c_name heading, CAST(length(c_name) AS INT) n FROM customer UNION ALL SELECT 'c' || c_custkey, 'auto/images/b.JPG', 'image/jpeg', 1, 'note', c_name, 1 FROM customer",
    "html_markdown": "SELECT CAST(doc_id AS VARCHAR) path, concat_ws(chr(10), 't', '## ' || source, 'a & b', '- ' || lang, '- x', '| id | p\\|q |', '| --- | --- |', '| ' || doc_id || ' |  |') markdown FROM documents",
    "csv_markdown": "SELECT CAST(o_orderkey AS VARCHAR) path, '| id | name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || o_orderkey || ' | a, \"' || o_orderpriority || '\" |' markdown FROM orders",
    "ledger_sheet_days": "SELECT CAST(c_custkey // 50 AS VARCHAR) path, 'n' || c_custkey person, 1 AS day, '√' AS \"in\", '×' AS out FROM customer UNION ALL SELECT CAST(c_custkey // 50 AS VARCHAR), 'n' || c_custkey, 2, '★', 't' || c_nationkey FROM customer",
}
