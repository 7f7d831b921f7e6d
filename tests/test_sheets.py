import datetime as dt

from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import retrieval
from quarry.sources import records as R

WHO = ["申请人", "申请人部门", "当前审批状态"]


def sheet(spark, path, rows):
    return spark.createDataFrame([(path, 1, i, r) for i, r in enumerate(rows)], "path string, sheet_no int, row long, cells array<string>")


def test_layouts_of_sheets(spark):
    a = sheet(spark, "a", [["标题"], ["审批编号", *WHO, "假种", "开始时间", "结束时间"], ["7", "x", "c/d", "已通过", "调休", "2024/1/2", "2024-01-03"], ["8", "", "", "", "", "", ""]])
    b = sheet(spark, "b", [[*WHO, "假种", "请假时间", "请假时长"], ["y", "c", "已通过", "年假", "2024/2/1 至 2024/2/3", "2.5天"]])
    c = sheet(spark, "c", [[*WHO, "请假类型", "起止"], ["z", "", "", "年假", "2024年3月1日"]])
    got = {r.applicant: r for r in R.leave_records(a.union(b).union(c)).collect()}
    day = dt.date
    assert {k: (r.start, r.end, r.duration_text, r.approval_id, r.center) for k, r in got.items()} == {
        "x": (day(2024, 1, 2), day(2024, 1, 3), "", "7", "c"),
        "y": (day(2024, 2, 1), day(2024, 2, 3), "2.5天", "", "c"),
        "z": (day(2024, 3, 1), day(2024, 3, 1), "", "", ""),
    }
    o = sheet(spark, "o", [[*WHO, "开始时间", "结束时间", "加班明细", "加班事由（必填）"], ["x", "c", "已通过", "2024/1/5", "", "2024/1/6 3小时\n2024-01-07 2.5小时", "r"], ["x", "c", "已通过", "2024/1/5", "", "", ""]])
    assert sorted((r.work_date.day, r.hours, r.reason) for r in R.overtime_records(o).collect()) == [(5, 0.0, ""), (6, 3.0, "r"), (7, 2.5, "r")]
    p = sheet(spark, "p", [["打卡详情"], ["2026/06/30 星期二", "n", "08:05", "正常", "--"], ["2026/06/30 星期二", "n", "--", "缺卡", "hq"], ["x", "n"]])
    q = sheet(spark, "q", [["日期", "姓名", "时间", "地点", "状态"], ["2026/7/1", "m", "2026/7/1 9:10", "there", "迟到"], ["", "m", "", "", ""]])
    got = {(r.path, r.seq): (r.person_name, r.work_date, r.punch_time, r.status, r.address) for r in R.punch_records(p.union(q)).collect()}
    assert got == {
        ("p", 1): ("n", day(2026, 6, 30), dt.datetime(2026, 6, 30, 8, 5), "正常", ""),
        ("p", 2): ("n", day(2026, 6, 30), None, "缺卡", "hq"),
        ("q", 1): ("m", day(2026, 7, 1), dt.datetime(2026, 7, 1, 9, 10), "迟到", "there"),
    }
    t = sheet(spark, "t", [[*WHO, "出差类别", "开始时间", "结束时间"], ["x", "c/d", "已通过", "项目出差", "45292", "2024/1/9"]])
    r = R.travel_records(t).first()
    assert (r.start, r.end, r.approval_id) == (day(2024, 1, 1), day(2024, 1, 9), "")


def test_numbers_in_six_digits(spark):
    values = [0.0, 1e-7, 1234567.5, 1.0, 2.5, 100.0, 0.1 + 0.2, 123456.0, 999999.6, 1e-5, 0.0001, -3.25, 1e20, 12345.678]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", text.format_number(F.col("x")).alias("s")).collect()
    assert {r.x: r.s for r in got} == {v: f"{v:g}" for v in values}


def test_bm25_in_blocks_matches_a_loop(spark):
    import math
    import random

    rng = random.Random(1)
    docs = {i: " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))) for i in range(300)}
    queries = {i: " ".join(rng.choice("abcdefgxyz") for _ in range(rng.randint(0, 4))) for i in range(7)}
    toks = {i: t.split() for i, t in docs.items()}
    avg = sum(map(len, toks.values())) / len(docs)
    df = {w: sum(w in t for t in toks.values()) for w in "abcdefghxyz"}

    def score(q, t):
        return sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / avg)) for w in q.split())

    want = set()
    for q, text_ in queries.items():
        every = [(-round(score(text_, t), 9), i) for i, t in toks.items() if score(text_, t) > 0]
        want |= {(q, i) for _, i in sorted(every)[:5]}
    c = spark.createDataFrame(list(docs.items()), "id long, text string").repartition(3)
    q = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    for block in (1024, 2):
        assert {(r.query_id, r.id) for r in retrieval.bm25_top(c, q, 5, block=block).collect()} == want
    assert retrieval.bm25_top(c, q.limit(0), 5).count() == 0 and retrieval.bm25_top(c.limit(0), q, 5).count() == 0
