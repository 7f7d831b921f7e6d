"""Queries over spreadsheet-like rows and parsing functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import records as R
from ..sources import workbook as W
from .inputs import table

S = F.col


def _pick(i, *values):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (i % len(values) + 1).cast("int"))


def datetime_parse(spark, d):
    o = table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy/MM/dd")
    t = F.element_at(F.array(day, F.date_format("o_orderdate", "yyyy-MM-dd 08:05"), F.concat(F.date_format("o_orderdate", "yyyy年M月d日"), F.lit(" 上午")), F.concat(F.lit("at "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" or so")), F.lit("n/a"), F.datediff("o_orderdate", F.lit("1899-12-30").cast("date")).cast("string")), (S("o_orderkey") % 6 + 1).cast("int"))
    return o.select("o_orderkey", R.parse_datetime(t).cast("string").alias("at"))


def date_ranges(spark, d):
    o = table(spark, d, "orders")
    t = F.when(S("o_orderkey") % 2 == 0, F.concat(F.date_format("o_orderdate", "yyyy/M/d"), F.lit(" 至 "), F.date_format(F.date_add(F.to_date("o_orderdate"), 3), "yyyy-MM-dd"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    a, b = R.parse_range(t)
    return o.select("o_orderkey", a.cast("string").alias("start"), b.cast("string").alias("end"))


def overtime_explode(spark, d):
    o = table(spark, d, "orders")
    rows = o.select("o_orderkey", F.when(S("o_orderkey") % 3 == 0, F.concat(F.date_format("o_orderdate", "yyyy/M/d"), F.lit(" 8小时；"), F.date_format(F.date_add(F.to_date("o_orderdate"), 1), "yyyy-MM-dd"), F.lit(" 2.5 小时"))).otherwise("").alias("detail"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("start"), F.lit("4小时").alias("hours_text"))
    return R.overtime_days(rows, "detail", "start", "hours_text").select("o_orderkey", S("work_date").cast("string").alias("work_date"), "hours")


def source_roles(spark, d):
    n = table(spark, d, "nation")
    name = _pick(S("n_nationkey"), "出差申请.xlsx", "加班2024.xlsx", "请假申请.xlsx", "上下班.xlsx", "加班出差.xlsx", "x.xlsx")
    headers = F.element_at(F.array(F.array(F.lit("加班明细"), F.lit("加班时长(时)")), F.array(F.lit("出差类别"), F.lit("假种")), F.array(F.lit("打卡地址"))), (S("n_nationkey") % 3 + 1).cast("int"))
    return n.select("n_nationkey", R.role_by_name(name).alias("by_name"), R.role_by_headers(headers).alias("by_headers"))


def roster_dedupe(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("n"), S("c_custkey") % 100).alias("name"), (S("c_custkey") % 3 == 0).alias("left"), S("c_custkey").alias("seq"))
    return R.roster_rows(c)


def export_person_fill(spark, d):
    li = table(spark, d, "lineitem").select(S("l_orderkey").cast("string").alias("path"), S("l_linenumber").alias("row"), F.when((S("l_linenumber") - 1) % 3 == 0, F.concat(F.lit("p"), S("l_linenumber"))).otherwise("").alias("person")).distinct()
    return R.filled_persons(li)


def header_inference(spark, d):
    n = table(spark, d, "nation")
    first = F.when(S("n_nationkey") % 3 == 0, F.array(F.lit("name"), F.lit("key"))).when(S("n_nationkey") % 3 == 1, F.array(F.lit("title only"), F.lit(""))).otherwise(F.array(F.lit("7"), F.lit("x")))
    h = R.infer_header(first, F.array(S("n_name"), S("n_nationkey").cast("string")), F.lit(3))
    return n.select("n_nationkey", h["is_header"].alias("is_header"), F.array_join(h["header"], ",").alias("header"))


def dominant_fonts(spark, d):
    s = table(spark, d, "lineitem").select(S("l_orderkey").alias("doc_id"), (S("l_quantity") % 5).alias("size"), S("l_returnflag").alias("text"))
    return R.dominant_font(s)


def tool_routing(spark, d):
    n = table(spark, d, "nation")
    text = _pick(S("n_nationkey"), "调休 汇总", "日报", "hello", "加班")
    name = _pick(S("n_nationkey"), "a.xlsx", "日报.xlsx", "", "x.pdf", "y.txt")
    leave = R.match_score(text, name, "调休|加班", "出差|加班|调休", r"\.xlsx?$")
    daily = R.match_score(text, name, "日报", "日报", r"\.(xlsx?|pdf)$")
    return n.select("n_nationkey", leave.alias("leave"), daily.alias("daily"), R.best_tool({"leave_ledger": leave, "staffing": daily}).alias("tool"))


def name_tokens(spark, d):
    n = table(spark, d, "nation")
    t = F.concat(F.lit("【公司人员】甲乙、丙丁戊（组长） 2人，甲乙 "), _pick(S("n_nationkey"), "己庚", "abc", ""), F.lit("【外包人员】辛壬"))
    return n.select("n_nationkey", F.array_join(R.person_names(R.labelled_block(t, "公司人员", "外包人员")), ",").alias("names"), F.array_join(R.project_codes(F.concat(F.lit("p1234-99 12345 1234 "), S("n_nationkey") + 100)), ",").alias("codes"))


def file_readers(spark, d):
    return table(spark, d, "nation").select("n_nationkey", W.reader_for(F.concat(S("n_name"), _pick(S("n_nationkey"), ".XLSX", ".md", ".pdf", "", ".tar.gz"))).alias("reader"))



QUERIES = {f.__name__: f for f in (datetime_parse, date_ranges, overtime_explode, source_roles, roster_dedupe, export_person_fill, header_inference, dominant_fonts, tool_routing, name_tokens, file_readers)}

ORACLE_SQL = {
    "datetime_parse": "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d 08:05:00') WHEN 4 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d 00:00:00') END AS at FROM orders",
    "date_ranges": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS start, strftime(o_orderdate + INTERVAL (CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 0 END) DAY, '%Y-%m-%d') AS \"end\" FROM orders",
    "overtime_explode": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') work_date, CASE WHEN o_orderkey % 3 = 0 THEN 8.0 ELSE 4.0 END::DOUBLE AS hours FROM orders UNION ALL SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d'), 2.5::DOUBLE FROM orders WHERE o_orderkey % 3 = 0",
    "source_roles": "SELECT n_nationkey, ['travel', 'overtime', 'leave', 'punch', NULL, NULL][n_nationkey % 6 + 1] by_name, ['overtime', NULL, 'punch'][n_nationkey % 3 + 1] by_headers FROM nation",
    "roster_dedupe": "SELECT 'n' || (c_custkey % 100) AS name, c_custkey % 3 = 0 AS \"left\", c_custkey seq FROM customer QUALIFY row_number() OVER (PARTITION BY c_custkey % 100 ORDER BY c_custkey % 3 = 0, c_custkey) = 1",
    "export_person_fill": "WITH r AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS path, l_linenumber AS row FROM lineitem) SELECT path, row, last_value(CASE WHEN (row - 1) % 3 = 0 THEN 'p' || row END IGNORE NULLS) OVER (PARTITION BY path ORDER BY row) person FROM r",
    "header_inference": "SELECT n_nationkey, n_nationkey % 3 = 0 is_header, CASE WHEN n_nationkey % 3 = 0 THEN 'name,key,列3' ELSE '列1,列2,列3' END header FROM nation",
    "dominant_fonts": "WITH s AS (SELECT l_orderkey doc_id, l_quantity % 5 AS size, sum(length(l_returnflag)) n FROM lineitem GROUP BY ALL) SELECT doc_id, size FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, size DESC) = 1",
    "tool_routing": "WITH x AS (SELECT n_nationkey, ['调休 汇总', '日报', 'hello', '加班'][n_nationkey % 4 + 1] t, ['a.xlsx', '日报.xlsx', '', 'x.pdf', 'y.txt'][n_nationkey % 5 + 1] f FROM nation), s AS (SELECT n_nationkey, CASE WHEN regexp_matches(f, '\\.xlsx?$') AND regexp_matches(t || f, '调休|加班') THEN 2 WHEN regexp_matches(f, '\\.xlsx?$') OR regexp_matches(t, '调休|加班') THEN 1 ELSE 0 END l, CASE WHEN regexp_matches(f, '\\.(xlsx?|pdf)$') AND (contains(t, '日报') OR contains(f, '日报')) THEN 2 WHEN regexp_matches(f, '\\.(xlsx?|pdf)$') OR contains(t, '日报') THEN 1 ELSE 0 END d FROM x) SELECT n_nationkey, ['none', 'weak', 'strong'][l + 1] leave, ['none', 'weak', 'strong'][d + 1] daily, CASE WHEN l = 0 AND d = 0 THEN NULL WHEN l = d THEN 'clarify' WHEN l > d THEN 'leave_ledger' ELSE 'staffing' END tool FROM s",
    "name_tokens": "SELECT n_nationkey, '甲乙,丙丁戊' || CASE WHEN n_nationkey % 3 = 0 THEN ',己庚' ELSE '' END names, '1234,12345,' || (n_nationkey + 100) codes FROM nation",
    "file_readers": "SELECT n_nationkey, ['workbook', 'markdown', 'pdf', 'unsupported', 'unsupported'][n_nationkey % 5 + 1] reader FROM nation",
}
