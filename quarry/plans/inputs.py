"""Ledger, staffing and chat inputs derived from the star-schema tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    start = F.expr("date_add(date '2024-01-01', cast(o_orderkey * 7 % 90 as int))")
    return o.select(
        F.col("o_orderkey").alias("seq"),
        F.expr("concat('p', o_custkey % 400)").alias("applicant"),
        F.expr("concat('c', o_custkey % 3, '/d', o_custkey % 7)").alias("department"),
        F.expr("concat('c', o_custkey % 3)").alias("center"),
        F.expr("case when o_orderkey % 5 < 3 then '项目出差' when o_orderkey % 5 = 3 then '非项目出差' else '其他' end").alias("category"),
        start.alias("start"),
        F.when(F.expr("o_orderkey % 50 != 0"), F.date_add(start, F.expr("cast((o_custkey + o_orderkey) % 45 as int)"))).alias("end"),
        F.expr("case o_orderstatus when 'F' then '已通过' when 'O' then '通过' else '审批中' end").alias("status"),
        F.col("o_orderkey").cast("string").alias("approval_id"),
    )


def overtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.select(
        F.col("event_id").alias("seq"),
        F.expr("concat('p', user_id % 400)").alias("applicant"),
        F.expr("concat('c', user_id % 3, '/e', user_id % 5)").alias("department"),
        F.lit("").alias("center"),
        F.to_date("ts").alias("work_date"),
        F.expr("cast(event_id % 12 as double)").alias("hours"),
        F.expr("case when event_id % 4 = 0 then '审批中' else '已通过' end").alias("status"),
        F.col("event_id").cast("string").alias("approval_id"),
    )


def leave(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return e.select(
        F.col("event_id").alias("seq"),
        F.expr("concat('p', user_id % 400)").alias("applicant"),
        F.lit("").alias("department"),
        F.lit("").alias("center"),
        F.expr("case when event_id % 2 = 0 then '调休' else '年假' end").alias("leave_kind"),
        F.to_date("ts").alias("start"),
        F.expr("case when event_id % 7 != 0 then date_add(to_date(ts), cast(event_id % 3 as int)) end").alias("end"),
        F.expr("case when event_id % 3 = 0 then '2.5天' else '' end").alias("duration_text"),
        F.lit("已通过").alias("status"),
        F.col("event_id").cast("string").alias("approval_id"),
    )


def punch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type in ('view', 'click')")
    return e.select(
        F.col("event_id").alias("seq"),
        F.expr("concat('p', user_id % 400)").alias("person_name"),
        F.to_date("ts").alias("work_date"),
        F.col("ts").alias("punch_time"),
        F.expr("case event_id % 10 when 0 then '总部大厦' when 1 then '' else 'site' end").alias("address"),
    )


def holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("select explode(sequence(date '2024-01-01', date '2024-01-03')) as day")


HQ = ["总部"]

SQL = {
    "travel": """travel AS (SELECT o_orderkey seq, 'p' || (o_custkey % 400) applicant, 'c' || (o_custkey % 3) || '/d' || (o_custkey % 7) department, 'c' || (o_custkey % 3) center,
CASE WHEN o_orderkey % 5 < 3 THEN '项目出差' WHEN o_orderkey % 5 = 3 THEN '非项目出差' ELSE '其他' END category,
DATE '2024-01-01' + CAST(o_orderkey * 7 % 90 AS INT) s, CASE WHEN o_orderkey % 50 != 0 THEN DATE '2024-01-01' + CAST(o_orderkey * 7 % 90 + (o_custkey + o_orderkey) % 45 AS INT) END e,
CASE o_orderstatus WHEN 'F' THEN '已通过' WHEN 'O' THEN '通过' ELSE '审批中' END status FROM orders)""",
    "overtime": """overtime AS (SELECT event_id seq, 'p' || (user_id % 400) applicant, 'c' || (user_id % 3) || '/e' || (user_id % 5) department, CAST(ts AS DATE) work_date, CAST(event_id % 12 AS DOUBLE) AS hours,
CASE WHEN event_id % 4 = 0 THEN '审批中' ELSE '已通过' END status FROM events WHERE event_type = 'purchase')""",
    "leave": """leave AS (SELECT event_id seq, 'p' || (user_id % 400) applicant, CASE WHEN event_id % 2 = 0 THEN '调休' ELSE '年假' END leave_kind, CAST(ts AS DATE) s,
CASE WHEN event_id % 7 != 0 THEN CAST(ts AS DATE) + CAST(event_id % 3 AS INT) END e, CASE WHEN event_id % 3 = 0 THEN 2.5 END said FROM events WHERE event_type = 'signup')""",
    "punch": """punch AS (SELECT event_id seq, 'p' || (user_id % 400) person, CAST(ts AS DATE) work_date, ts, CASE event_id % 10 WHEN 0 THEN '总部大厦' WHEN 1 THEN '' ELSE 'site' END address FROM events WHERE event_type IN ('view', 'click'))""",
    "holidays": "holidays AS (SELECT unnest([DATE '2024-01-01', DATE '2024-01-02', DATE '2024-01-03']) d)",
    "pday": "pday AS (SELECT person, work_date, bool_or(address LIKE '%总部%') hq, bool_and(address = '') blank, count(*) n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 span FROM punch GROUP BY ALL)",
    "trips": """ok AS (SELECT * FROM travel WHERE status LIKE '%通过%'),
trips AS (SELECT seq, applicant person, s, e, least(e, coalesce(min(work_date) FILTER (hq), e)) ae, coalesce(bool_or(blank), false) unknown FROM ok LEFT JOIN pday ON person = applicant AND work_date BETWEEN s AND e WHERE e IS NOT NULL AND category = '项目出差' GROUP BY seq, applicant, s, e)""",
    "merged": """isl AS (SELECT *, sum(CASE WHEN s <= reach + 2 THEN 0 ELSE 1 END) OVER (PARTITION BY person ORDER BY s, ae, seq ROWS UNBOUNDED PRECEDING) island FROM (SELECT *, max(ae) OVER (PARTITION BY person ORDER BY s, ae, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) reach FROM trips)),
segs AS (SELECT person, island, min(s) ss, max(e) se, min(s) a, max(ae) b, max(ae) - min(s) + 1 AS days, floor((max(ae) - min(s) + 1) / 30) * 2.0 credit FROM isl GROUP BY person, island)""",
    "credits": """credits AS (SELECT o.seq, o.applicant person, o.work_date, h.d IS NOT NULL holiday, CASE WHEN p.n IS NULL THEN 'ot_missing_punch' WHEN hours >= 8 AND span < 4 THEN 'ot_half_day_mismatch' ELSE 'credited' END reason
FROM overtime o LEFT JOIN holidays h ON h.d = o.work_date LEFT JOIN pday p ON p.person = o.applicant AND p.work_date = o.work_date
WHERE status = '已通过' AND NOT (h.d IS NULL AND EXISTS (SELECT 1 FROM segs WHERE segs.person = o.applicant AND o.work_date BETWEEN a AND b)))""",
}


def ctes(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
