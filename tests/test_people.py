import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.operators import access, attendance, memory, reconcile, retrieval, staffing
from quarry.streaming import jobs


@pytest.mark.parametrize("units, projects, domains, clearance, want", [([], [], [], "core", []), (["o"], [], [], "general", [1]), (["o"], [], [], "core", [1, 2]), ([], ["p"], ["d"], "general", [3]), ([], ["p"], [], "core", []), ([], [""], ["d"], "core", [])])
def test_visibility(spark, units, projects, domains, clearance, want):
    rows = [(1, "o", "", "", "general"), (2, "o", "", "", "core"), (3, "x", "p", "d", "core"), (4, None, None, None, None), (5, "x", "", "d", "general")]
    df = spark.createDataFrame(rows, "id int, org_unit_id string, project_id string, domain string, classification string")
    assert sorted(r.id for r in df.where(access.visible(units, projects, domains, clearance)).collect()) == want


def test_closure_ends_on_cycles(spark):
    u = spark.createDataFrame([("1", "3", "a"), ("2", "1", "b"), ("3", "2", "c"), ("4", None, "d")], "id string, parent_id string, code string")
    got = access.descendants(u, spark.createDataFrame([("a",), ("d",)], "code string")).collect()
    assert sorted((r.root, r.id) for r in got) == [("a", "1"), ("a", "2"), ("a", "3"), ("d", "4")]


def test_name_resolution(spark):
    roster = spark.createDataFrame([("王小明",), ("李王小",), ("张三丰",)], "name string")
    tokens = spark.createDataFrame([("王小",), ("三丰",), ("张三丰",), ("赵",), ("",)], "token string")
    got = {r.token: (r.status, r.to_name) for r in staffing.classify_names(tokens, roster).collect()}
    assert got == {"王小": ("unresolved", None), "三丰": ("auto", "张三丰"), "张三丰": ("exact", "张三丰"), "赵": ("unresolved", None), "": ("exact", "")}
    assert staffing.classify_names(tokens, roster.limit(0)).where("status != 'unavailable'").count() == 0


def test_memory_split(spark):
    rows = [("a", i, "user", "x" * 100, False, 0) for i in range(6)] + [("b", i, "user", "x" * 10, False, 0) for i in range(3)] + [("c", i, "user", "x" * 400, False, 0) for i in range(2)]
    m = spark.createDataFrame(rows, "conversation_id string, id int, role string, content string, compressed boolean, token_count int")
    got = {(r.conversation_id, r.id): r.action for r in memory.compression_split(m, 100, 2, "conversation_id", ["id"]).collect()}
    assert [got["a", i] for i in range(6)] == ["compress"] * 2 + ["retain"] * 4
    assert {got["b", i] for i in range(3)} == {"none"} and (got["c", 0], got["c", 1]) == ("compress", "retain")


def test_parent_budget_is_shared(spark):
    hits = spark.createDataFrame([(1, 1, "a", "p1", "child"), (1, 2, "b", "p2", "table_row"), (1, 3, "c", "p2", "child"), (1, 4, "d", "p9", "child"), (1, 5, "e", None, "child")], "query_id int, rank int, text string, parent_id string, chunk_kind string")
    parents = spark.createDataFrame([("p1", "x" * 2000), ("p2", "y" * 10)], "id string, text string")
    got = {r["rank"]: (r.context_source, len(r.context_text)) for r in retrieval.expand_parents(hits, parents, 600, 5).collect()}
    assert got == {1: ("parent", 400), 2: ("parent", 10), 3: ("parent", 10), 4: ("child", 1), 5: ("child", 1)}


def test_symbol_variants_and_numbers(spark):
    df = spark.createDataFrame([(" ✓ ", "1,200"), ("¥", ""), (None, "x")], "s string, n string")
    assert [(r.a, r.b) for r in df.select(reconcile.symbol(F.col("s")).alias("a"), reconcile.number(F.col("n")).alias("b")).collect()] == [("√", 1200.0), ("￥", 0.0), ("", None)]


def test_month_grid_rules(spark):
    d = lambda n: dt.date(2024, 1, n)
    places = attendance.Places(labels={"n": ["NCO"]}, overseas=["泰国"], default_site="n")
    f = spark.createDataFrame
    roster = f([("ann", "c", ""), ("bob（离职）", "c", "n")], "name string, center string, base_site string")
    days = f([(d(n),) for n in (2, 3, 4, 5)], "day date")
    travel = f([(1, "ann", "出差", "town", d(2), d(5), "已通过")], "seq long, applicant string, category string, location string, start date, end date, status string")
    leave = f([("bob", "年假", d(3), d(3), "下午", None, "已通过")], "applicant string, leave_kind string, start date, end date, start_half string, end_half string, status string")
    P = "seq long, person_name string, work_date date, side string, status string, address string, leave_apply string"
    punch = f([(1, "ann", d(2), "in", "正常", "site", ""), (2, "ann", d(3), "in", "正常", "site", ""), (3, "ann", d(3), "out", "正常", "NCO", ""), (4, "ann", d(4), "in", "迟到", "NCO", ""), (5, "bob", d(3), "in", "正常", "NCO", "")], P)
    g = attendance.month_grid(roster, days, travel, leave, punch, "2024-01-01", "2024-01-31", places)
    got = {(r.person, r.day.day, r.side): r.symbol for r in g.collect()}
    assert got["ann", 2, "in"] == "￥" and got["ann", 2, "out"] == "×" and got["ann", 3, "in"] == "￥"
    assert got["ann", 4, "in"] == "√" and got["ann", 5, "in"] == "×"
    assert got["bob", 3, "out"] == "假" and ("bob", 4, "in") not in got
    t = {r.person: r for r in attendance.month_tallies(g).collect()}
    assert t["ann"].late == 1 and t["ann"].absent == 1 and t["bob"]["leave"] == 0.5


def test_lockout_and_memory_streams(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("u", at(s), False) for s in (0, 10, 20, 30)] + [("u", at(40), True), ("u", at(50), False), ("v", at(0), False), ("v", at(400), False), ("v", at(401), False), ("v", at(402), False)]
    spark.createDataFrame(rows, "username string, ts timestamp, success boolean").coalesce(1).write.parquet(f"{tmp_path}/attempts.parquet")
    s = jobs.read_table(spark, str(tmp_path), "attempts")
    assert [(r.username, r.locked_at) for r in jobs.run_available(jobs.lockouts(s, 3, 300, 300)).orderBy("username").collect()] == [("u", at(20)), ("v", at(402))]
