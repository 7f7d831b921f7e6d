"""Queries over day intervals and the leave ledger."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import intervals, ledger
from ..operators.shared import cut
from ..sources import records
from . import inputs
from .inputs import ctes, table


def _user_days(spark, d):
    return table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", "event_id")


def stints_by_user(spark, d):
    s = intervals.stints(_user_days(spark, d), ["user_id"], "day")
    return s.select("user_id", "index", F.col("entry_date").cast("string").alias("entry_date"), F.col("exit_date").cast("string").alias("exit_date"), "days")


def _first_stage(spark, d):
    e = _user_days(spark, d)
    return e.groupBy("user_id", "day").agg(F.min_by("event_type", "event_id").alias("stage"))


def stint_stage_labels(spark, d):
    s = intervals.stints_with_stages(_first_stage(spark, d), ["user_id"], "day", "stage")
    return s.select("user_id", "index", F.col("entry_date").cast("string").alias("entry_date"), "days", "stage_label")


def stint_stage_counts(spark, d):
    return intervals.stage_counts(_first_stage(spark, d), ["user_id"], "stage")


def stint_texts(spark, d):
    return intervals.stints_text(intervals.stints(_user_days(spark, d), ["user_id"], "day"), ["user_id"])


def interval_merge_credit(spark, d):
    t = inputs.travel(spark, d).where("end is not null")
    m = intervals.merge_intervals(t, ["applicant"], "start", "end", 1)
    days = intervals.day_count(F.col("start"), F.col("end"))
    return m.select("applicant", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), days.cast("long").alias("days"), intervals.block_credit(days).alias("credit"))


def interval_truncate_by_punch(spark, d):
    t = inputs.travel(spark, d).where("end is not null")
    t = ledger.truncated_travel(t, inputs.punch(spark, d), inputs.HQ)
    return t.select("seq", F.col("actual_end").cast("string").alias("actual_end"), "unknown_address")


def first_day_in_span(spark, d):
    t = inputs.travel(spark, d).where("end is not null").select("seq", F.col("applicant").alias("person_name"), "start", "end")
    f = intervals.first_day_inside(t, inputs.punch(spark, d), ["person_name"], "seq", "start", "end", "work_date", F.col("address") == "site")
    return f.select("seq", F.col("first_day").cast("string").alias("first_day"), "n_points")


def interval_membership(spark, d):
    o = inputs.overtime(spark, d)
    return intervals.inside_any(o, inputs.travel(spark, d).where("end is not null"), ["applicant"], "work_date", "start", "end").select("seq", "applicant")


def _segments(spark, d):
    t = inputs.travel(spark, d).where(ledger.approved(F.col("status")) & ledger.is_project(F.col("category"))).where("end is not null")
    t = ledger.truncated_travel(t, inputs.punch(spark, d), inputs.HQ)
    return ledger.travel_segments(t.select(F.col("applicant").alias("person_name"), F.col("start").alias("system_start"), F.col("end").alias("system_end"), F.col("start").alias("actual_start"), "actual_end"))


def travel_segments(spark, d):
    return _segments(spark, d).select("person_name", *(F.col(c).cast("string").alias(c) for c in ("system_start", "system_end", "actual_start", "actual_end")), F.col("days").cast("long").alias("days"), "credit")


def ot_credit_rules(spark, d):
    c = ledger.overtime_credits(inputs.overtime(spark, d).where("status = '已通过'"), _segments(spark, d), inputs.punch(spark, d), inputs.holidays(spark, d), None)
    return c.select("seq", "person_name", "reason", "credit", "holiday")


def punch_span(spark, d):
    p = ledger.punch_spans(inputs.punch(spark, d))
    return p.select("person_name", F.col("work_date").cast("string").alias("work_date"), "punches", F.round("span_hours", 6).alias("span_hours"))


def leave_bounds(spark, d):
    v = inputs.leave(spark, d)
    days = ledger.leave_days(F.col("duration_text"), F.col("start"), F.col("end"))
    s, e = ledger.complete_bounds(F.col("start"), F.col("end"), days)
    return v.select("seq", days.alias("used_days"), s.cast("string").alias("start"), e.cast("string").alias("end"))


SCALARS = ["person_name", "center", "department", "system_travel_start", "system_travel_end", "actual_travel_start", "actual_travel_end", "travel_comp_days", "ot_dates", "ot_comp_days", "total_comp_days", "leave_start", "leave_end", "used_comp_days", "remaining_comp_days", "remark"]


def _ledger(spark, d):
    return ledger.compute_ledger(inputs.travel(spark, d), inputs.overtime(spark, d), inputs.leave(spark, d), inputs.punch(spark, d), inputs.HQ, inputs.holidays(spark, d))


def ledger_full(spark, d):
    return _ledger(spark, d).select(*SCALARS)


def _sheet(df, name, header, *cells):
    """Rows as a workbook reader gives them: a header, then a row of texts for each record."""
    say = lambda c: F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit(""))
    head = df.sparkSession.range(1).select(F.lit(name).alias("path"), F.lit(1).alias("sheet_no"), F.lit(0).cast("long").alias("row"), F.array(*map(F.lit, header)).alias("cells"))
    return head.unionByName(df.select(F.lit(name).alias("path"), F.lit(1).alias("sheet_no"), (F.col("seq") + 1).cast("long").alias("row"), F.array(*map(say, cells)).alias("cells")))


def sheet_ledger(spark, d):
    """The ledger from the cells of four sheets: readers and computation end to end."""
    who, day = ["申请人", "申请人部门", "当前审批状态"], lambda c: F.date_format(c, "yyyy/MM/dd")
    t = _sheet(inputs.travel(spark, d), "出差.xlsx", ["审批编号", *who, "出差类别", "开始时间", "结束时间"], "approval_id", "applicant", "department", "status", "category", day("start"), day("end"))
    o = _sheet(inputs.overtime(spark, d), "加班.xlsx", [*who, "开始时间", "结束时间", "加班明细", "审批编号"], "applicant", "department", "status", day("work_date"), day("work_date"), F.concat(day("work_date"), F.lit(" "), F.col("hours").cast("string"), F.lit("小时")), "approval_id")
    v = _sheet(inputs.leave(spark, d), "请假.xlsx", [*who, "假种", "开始时间", "结束时间", "请假时长"], "applicant", "department", "status", "leave_kind", day("start"), day("end"), "duration_text")
    p = _sheet(inputs.punch(spark, d), "打卡.xlsx", ["日期", "姓名", "打卡时间", "打卡地址"], day("work_date"), "person_name", F.date_format("punch_time", "yyyy/MM/dd HH:mm:ss"), "address")
    # the ledger reads each source several times: sheets are parsed once
    parsed = [cut(read(x)) for read, x in ((records.travel_records, t), (records.overtime_records, o), (records.leave_records, v), (records.punch_records, p))]
    got = ledger.compute_ledger(*parsed, inputs.HQ, inputs.holidays(spark, d))
    return got.select(*(c for c in SCALARS if c != "center"))


def ledger_totals(spark, d):
    return ledger.totals(_ledger(spark, d))


def ledger_export_rows(spark, d):
    return ledger.export_rows(_ledger(spark, d))


def ledger_warnings(spark, d):
    w = ledger.warnings(inputs.travel(spark, d), inputs.overtime(spark, d), inputs.leave(spark, d), inputs.punch(spark, d), inputs.HQ, inputs.holidays(spark, d))
    return w.groupBy("code", "blocking").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("person").alias("people"))


def ledger_merge_prior(spark, d):
    turn = F.lit("2024-02-01").cast("date")
    tr, ot, lv, pu, ho = (f(spark, d) for f in (inputs.travel, inputs.overtime, inputs.leave, inputs.punch, inputs.holidays))
    part = lambda early: ledger.compute_ledger(tr.where((F.col("start") < turn) == early), ot.where((F.col("seq") % 2 == 0) == early), lv.where((F.col("seq") % 4 == 0) == early), pu, inputs.HQ, ho)
    m = ledger.merge_ledgers(part(F.lit(True)), part(F.lit(False)), ho)
    return m.select("person_name", "actual_travel_start", "actual_travel_end", "travel_comp_days", "ot_dates", "ot_comp_days", "leave_start", "leave_end", "used_comp_days", "remaining_comp_days")


def ledger_prior_keys(spark, d):
    return ledger.prior_keys(_ledger(spark, d))


def missing_source_roles(spark, d):
    have = table(spark, d, "events").select(F.when(F.col("event_type") == "purchase", "overtime").when(F.col("event_type") == "signup", "leave").when(F.col("event_type") == "view", "punch").alias("role")).where("role is not null").distinct()
    return ledger.missing_roles(have)


def longest_name_match(spark, d):
    texts = table(spark, d, "benchmark").select(F.col("item_id").alias("text_id"), F.lower("text").alias("text"))
    names = table(spark, d, "nation").select(F.lower(F.substring("n_name", 1, 3)).alias("name")).union(table(spark, d, "nation").select(F.lower(F.substring("n_name", 1, 2)).alias("name")))
    return ledger.longest_named(texts, names)


def longest_name_match_whole(spark, d):
    """Whole documents against whole names: nations in both cases and the benchmark's passages."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text").where("text is not null")
    n = table(spark, d, "nation")
    return ledger.longest_named(texts, n.select(F.col("n_name").alias("name")).union(n.select(F.lower("n_name"))).union(table(spark, d, "benchmark").select("text")))


def open_blocking_warnings(spark, d):
    w = ledger.warnings(inputs.travel(spark, d), inputs.overtime(spark, d), inputs.leave(spark, d), inputs.punch(spark, d), inputs.HQ, inputs.holidays(spark, d)).where("code like 'ot_%'")
    done = w.where(F.crc32("person") % 2 == 0).select("code", F.concat_ws(":", "person", "date").alias("key"))
    return ledger.open_warnings(w, done).select("code", "person", "date")


QUERIES = {f.__name__: f for f in (sheet_ledger, stints_by_user, stint_stage_labels, stint_stage_counts, stint_texts, interval_merge_credit, interval_truncate_by_punch, first_day_in_span, interval_membership, travel_segments, ot_credit_rules, punch_span, leave_bounds, ledger_full, ledger_totals, ledger_export_rows, ledger_warnings, ledger_merge_prior, ledger_prior_keys, missing_source_roles, longest_name_match, longest_name_match_whole, open_blocking_warnings)}

_RUNS = """days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) run FROM (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY user_id ORDER BY day) = 1 THEN 0 ELSE 1 END opens FROM days))"""
_STAGE = "stage AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_min(event_type, event_id) stage FROM events GROUP BY ALL)"
_BASE = ("travel", "overtime", "leave", "punch", "holidays", "pday", "trips", "merged", "credits")
_LEDGER = """used AS (SELECT seq, applicant person, coalesce(said, CASE WHEN e IS NOT NULL THEN e - s + 1 ELSE 1 END) AS days, s, coalesce(e, s + CAST(ceil(coalesce(said, 1.0)) AS INT) - 1) e FROM leave WHERE leave_kind = '调休'),
t AS (SELECT person, min(ss) ss, max(se) se, min(a) a, max(b) b, sum(credit) c, string_agg(CASE WHEN days >= 30 THEN '项目出差' || days || '天→' || CAST(credit AS INT) || '天' ELSE '项目出差' || days || '天不足30不计' END, '；' ORDER BY island) rem FROM segs GROUP BY person),
o AS (SELECT person, sum(CASE WHEN reason = 'credited' THEN 1.0 ELSE 0.0 END) c, string_agg(CASE WHEN reason = 'credited' THEN CAST(work_date AS VARCHAR) || CASE WHEN holiday THEN '(法定)' ELSE '' END END, '、' ORDER BY seq) d FROM credits GROUP BY person),
u AS (SELECT person, sum(days) c, min(s) s, max(e) e FROM used WHERE days > 0 GROUP BY person),
prof AS (SELECT person, coalesce(arg_min(center, k) FILTER (center != ''), '') center, coalesce(arg_min(dep, k) FILTER (dep != ''), '') department FROM (SELECT applicant person, center, department dep, seq::DOUBLE k FROM travel UNION ALL SELECT applicant, '', department, 1e12 + seq FROM overtime) GROUP BY person),
people AS (SELECT person FROM trips UNION SELECT applicant FROM overtime WHERE status = '已通过' UNION SELECT person FROM used),
ledger AS (SELECT people.person person_name, coalesce(center, '') center, coalesce(department, '') department, coalesce(CAST(ss AS VARCHAR), '') system_travel_start, coalesce(CAST(se AS VARCHAR), '') system_travel_end, coalesce(CAST(a AS VARCHAR), '') actual_travel_start, coalesce(CAST(b AS VARCHAR), '') actual_travel_end,
coalesce(t.c, 0.0) travel_comp_days, coalesce(o.d, '') ot_dates, coalesce(o.c, 0.0)::DOUBLE ot_comp_days, (coalesce(t.c, 0.0) + coalesce(o.c, 0.0))::DOUBLE total_comp_days, coalesce(CAST(u.s AS VARCHAR), '') leave_start, coalesce(CAST(u.e AS VARCHAR), '') leave_end, coalesce(u.c, 0.0)::DOUBLE used_comp_days, (coalesce(t.c, 0.0) + coalesce(o.c, 0.0) - coalesce(u.c, 0.0))::DOUBLE remaining_comp_days, coalesce(rem, '') remark
FROM people LEFT JOIN prof USING (person) LEFT JOIN t USING (person) LEFT JOIN o USING (person) LEFT JOIN u USING (person))"""
_WARN = """w AS (SELECT 'approval_not_passed' code, applicant person, NULL date, true blocking FROM travel WHERE status NOT LIKE '%通过%' UNION ALL SELECT 'approval_not_passed', applicant, NULL, true FROM overtime WHERE status NOT LIKE '%通过%'
UNION ALL SELECT 'travel_missing_dates', applicant, NULL, true FROM ok WHERE e IS NULL UNION ALL SELECT 'travel_category_unknown', applicant, NULL, false FROM ok WHERE e IS NOT NULL AND category = '其他'
UNION ALL SELECT 'hq_address_unknown', person, CAST(s AS VARCHAR), true FROM trips WHERE unknown UNION ALL SELECT reason, person, CAST(work_date AS VARCHAR), true FROM credits WHERE reason != 'credited')"""


def _of_period(number: int, early: str) -> str:
    """The tables of one of two periods, each with its number at its name."""
    parts = [f"{n}_ AS (SELECT * FROM {n} WHERE {w} = {early})" for n, w in (("travel", "(s < DATE '2024-02-01')"), ("overtime", "(seq % 2 = 0)"), ("leave", "(seq % 4 = 0)"))]
    names = re.compile(r"\b(travel|overtime|leave|ok|trips|isl|segs|credits|used)\b(?!_)")
    steps = [names.sub(r"\1_", inputs.SQL[k]) for k in ("trips", "merged", "credits")] + [names.sub(r"\1_", _LEDGER.split(",\nt AS")[0])]
    return re.sub(r"\b(travel|overtime|leave|ok|trips|isl|segs|credits|used)_(?![a-z])", rf"\g<1>{number}", ",\n".join(parts + steps))


_MERGED = f"""{ctes("travel", "overtime", "leave", "punch", "holidays", "pday")},
{_of_period(0, "true")},
{_of_period(1, "false")},
who AS (SELECT person FROM trips0 UNION SELECT applicant FROM overtime WHERE status = '已通过' UNION SELECT person FROM used0 UNION SELECT person FROM trips1 UNION SELECT person FROM used1),
ms AS (SELECT person, a s, b ae FROM segs0 UNION ALL SELECT person, a, b FROM segs1),
mi AS (SELECT *, sum(CASE WHEN s <= reach + 2 THEN 0 ELSE 1 END) OVER (PARTITION BY person ORDER BY s, ae ROWS UNBOUNDED PRECEDING) island FROM (SELECT *, max(ae) OVER (PARTITION BY person ORDER BY s, ae ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) reach FROM ms)),
mg AS (SELECT person, min(s) a, max(ae) b, floor((max(ae) - min(s) + 1) / 30) * 2.0 credit FROM mi GROUP BY person, island),
d AS (SELECT * FROM (SELECT 0 p, * FROM credits0 UNION ALL SELECT 1, * FROM credits1) QUALIFY row_number() OVER (PARTITION BY person, work_date ORDER BY p, seq) = 1),
dk AS (SELECT * FROM d WHERE holiday OR NOT EXISTS (SELECT 1 FROM mg WHERE mg.person = d.person AND work_date BETWEEN a AND b)),
v AS (SELECT * FROM (SELECT 0 p, * FROM used0 UNION ALL SELECT 1, * FROM used1) WHERE days > 0 QUALIFY row_number() OVER (PARTITION BY person, s, e ORDER BY p, seq) = 1),
mt AS (SELECT person, min(a) a, max(b) b, sum(credit) c FROM mg GROUP BY person),
md AS (SELECT person, sum(CASE WHEN reason = 'credited' THEN 1.0 ELSE 0.0 END) c, string_agg(CASE WHEN reason = 'credited' THEN CAST(work_date AS VARCHAR) || CASE WHEN holiday THEN '(法定)' ELSE '' END END, '、' ORDER BY work_date) d FROM dk GROUP BY person),
mv AS (SELECT person, sum(days) c, min(s) s, max(e) e FROM v GROUP BY person)
SELECT who.person person_name, coalesce(CAST(mt.a AS VARCHAR), '') actual_travel_start, coalesce(CAST(mt.b AS VARCHAR), '') actual_travel_end, coalesce(mt.c, 0.0)::DOUBLE travel_comp_days, coalesce(md.d, '') ot_dates, coalesce(md.c, 0.0)::DOUBLE ot_comp_days,
coalesce(CAST(mv.s AS VARCHAR), '') leave_start, coalesce(CAST(mv.e AS VARCHAR), '') leave_end, coalesce(mv.c, 0.0)::DOUBLE used_comp_days, (coalesce(mt.c, 0.0) + coalesce(md.c, 0.0) - coalesce(mv.c, 0.0))::DOUBLE remaining_comp_days
FROM who LEFT JOIN mt USING (person) LEFT JOIN md USING (person) LEFT JOIN mv USING (person)"""
_CRC = "list_reduce(list_concat([4294967295], flatten(list_transform(string_split(person, ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)"

ORACLE_SQL = {
    "ledger_merge_prior": _MERGED,
    "ledger_export_rows": ctes(*_BASE) + f""",
{_LEDGER},
xa AS (SELECT person, row_number() OVER (PARTITION BY person ORDER BY island) - 1 k, a, b FROM segs), xb AS (SELECT person, row_number() OVER (PARTITION BY person ORDER BY seq) - 1 k, work_date FROM credits WHERE reason = 'credited'),
xc AS (SELECT person, row_number() OVER (PARTITION BY person ORDER BY seq) - 1 k, s FROM used WHERE days > 0), ks AS (SELECT person, k FROM xa UNION SELECT person, k FROM xb UNION SELECT person, k FROM xc UNION SELECT person_name, 0 FROM ledger)
SELECT ks.person person_name, CAST(k AS INT) AS row, CAST(a AS VARCHAR) travel_start, CAST(b AS VARCHAR) travel_end, CAST(work_date AS VARCHAR) ot_date, CAST(s AS VARCHAR) leave_start, CASE WHEN k = 0 THEN total_comp_days END total_comp_days, CASE WHEN k = 0 THEN used_comp_days END used_comp_days, CASE WHEN k = 0 THEN remaining_comp_days END remaining_comp_days
FROM ks LEFT JOIN xa USING (person, k) LEFT JOIN xb USING (person, k) LEFT JOIN xc USING (person, k) JOIN ledger ON person_name = ks.person""",
    "open_blocking_warnings": ctes(*_BASE) + f" SELECT reason code, person, CAST(work_date AS VARCHAR) date FROM credits WHERE reason != 'credited' AND xor({_CRC}, 4294967295) & 1 = 1",
    "stints_by_user": f"WITH {_RUNS} SELECT user_id, CAST(run AS INT) AS \"index\", CAST(min(day) AS VARCHAR) entry_date, CAST(max(day) AS VARCHAR) exit_date, count(*) AS days FROM runs GROUP BY user_id, run",
    "stint_stage_counts": f"WITH {_STAGE} SELECT user_id, stage, count(*) AS days FROM stage WHERE trim(stage) != '' GROUP BY ALL",
    "stint_stage_labels": f"WITH {_RUNS}, {_STAGE}, s AS (SELECT user_id, run, min(day) entry_date, count(*) AS days FROM runs GROUP BY ALL), c AS (SELECT user_id, run, stage, count(*) n FROM runs JOIN stage USING (user_id, day) GROUP BY ALL) SELECT user_id, CAST(run AS INT) AS \"index\", CAST(any_value(entry_date) AS VARCHAR) entry_date, any_value(days) AS days, string_agg(CASE WHEN n = days THEN stage ELSE stage || '(' || n || '天)' END, '、' ORDER BY stage) stage_label FROM s JOIN c USING (user_id, run) GROUP BY user_id, run",
    "stint_texts": f"WITH {_RUNS}, s AS (SELECT user_id, run, min(day) a, max(day) b, count(*) n FROM runs GROUP BY ALL) SELECT user_id, string_agg(run || ': ' || strftime(a, '%m-%d') || '~' || strftime(b, '%m-%d'), '; ' ORDER BY run) compact, string_agg('第' || run || '次 ' || a || '入→' || b || '出（' || n || '天）', '；' ORDER BY run) summary FROM s GROUP BY user_id",
    "interval_merge_credit": ctes("travel") + ", i AS (SELECT *, sum(CASE WHEN s <= reach + 2 THEN 0 ELSE 1 END) OVER (PARTITION BY applicant ORDER BY s, e, seq ROWS UNBOUNDED PRECEDING) g FROM (SELECT *, max(e) OVER (PARTITION BY applicant ORDER BY s, e, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) reach FROM travel WHERE e IS NOT NULL)) SELECT applicant, CAST(min(s) AS VARCHAR) AS start, CAST(max(e) AS VARCHAR) AS \"end\", CAST(max(e) - min(s) + 1 AS BIGINT) AS days, floor((max(e) - min(s) + 1) / 30) * 2.0 credit FROM i GROUP BY applicant, g",
    "interval_truncate_by_punch": ctes("travel", "punch", "pday") + " SELECT t.seq, CAST(least(e, coalesce(min(work_date) FILTER (hq), e)) AS VARCHAR) actual_end, coalesce(bool_or(blank), false) unknown_address FROM travel t LEFT JOIN pday ON person = applicant AND work_date BETWEEN s AND e WHERE e IS NOT NULL GROUP BY t.seq, e",
    "first_day_in_span": ctes("travel", "punch") + " SELECT t.seq, CAST(min(work_date) FILTER (address = 'site') AS VARCHAR) first_day, count(*) n_points FROM travel t JOIN punch ON person = applicant AND work_date BETWEEN s AND e GROUP BY t.seq",
    "interval_membership": ctes("travel", "overtime") + " SELECT seq, applicant FROM overtime o WHERE EXISTS (SELECT 1 FROM travel t WHERE t.applicant = o.applicant AND work_date BETWEEN s AND e)",
    "travel_segments": ctes("travel", "punch", "pday", "trips", "merged") + " SELECT person person_name, CAST(ss AS VARCHAR) system_start, CAST(se AS VARCHAR) system_end, CAST(a AS VARCHAR) actual_start, CAST(b AS VARCHAR) actual_end, days, credit FROM segs",
    "ot_credit_rules": ctes(*(x for x in _BASE if x != "leave")) + " SELECT seq, person person_name, reason, CASE WHEN reason = 'credited' THEN 1.0 ELSE 0.0 END::DOUBLE credit, holiday FROM credits",
    "punch_span": ctes("punch", "pday") + " SELECT person person_name, CAST(work_date AS VARCHAR) work_date, n punches, round(span, 6) span_hours FROM pday",
    "leave_bounds": ctes("leave") + " SELECT seq, coalesce(said, CASE WHEN e IS NOT NULL THEN e - s + 1 ELSE 1 END)::DOUBLE used_days, CAST(s AS VARCHAR) AS start, CAST(coalesce(e, s + CAST(ceil(coalesce(said, 1.0)) AS INT) - 1) AS VARCHAR) AS \"end\" FROM leave",
    "ledger_full": ctes(*_BASE) + f",\n{_LEDGER} SELECT * FROM ledger",
    "sheet_ledger": ctes(*_BASE) + f",\n{_LEDGER} SELECT * EXCLUDE (center) FROM ledger",
    "ledger_totals": ctes(*_BASE) + f",\n{_LEDGER} SELECT count(*) person_count, sum(total_comp_days) total_comp_days, sum(used_comp_days) used_comp_days FROM ledger",
    "ledger_warnings": ctes(*_BASE) + f",\n{_WARN} SELECT code, blocking, count(*) n, count(DISTINCT person) people FROM w GROUP BY ALL",
    "ledger_prior_keys": ctes(*_BASE) + " SELECT DISTINCT person, CAST(work_date AS VARCHAR) date FROM credits",
    "missing_source_roles": "SELECT 'missing_source_' || role code, role FROM (SELECT unnest(['travel', 'overtime', 'leave', 'punch']) role) WHERE role NOT IN (SELECT CASE event_type WHEN 'purchase' THEN 'overtime' WHEN 'signup' THEN 'leave' WHEN 'view' THEN 'punch' ELSE '' END FROM events)",
    "longest_name_match": "WITH n AS (SELECT DISTINCT lower(substr(n_name, 1, k)) AS name FROM nation, (SELECT unnest([2, 3]) k)), h AS (SELECT item_id text_id, name, rank() OVER (PARTITION BY item_id ORDER BY length(name) DESC) r FROM benchmark JOIN n ON contains(lower(text), name)) SELECT text_id, name FROM h WHERE r = 1",
    "longest_name_match_whole": "WITH n AS (SELECT n_name AS name FROM nation UNION SELECT lower(n_name) FROM nation UNION SELECT text FROM benchmark), h AS (SELECT doc_id text_id, name, rank() OVER (PARTITION BY doc_id ORDER BY length(name) DESC) r FROM documents JOIN n ON contains(text, name)) SELECT text_id, name FROM h WHERE r = 1",
}
