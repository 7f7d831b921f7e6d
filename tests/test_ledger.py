import datetime as dt

import pytest

from quarry.operators import ledger

D = lambda s: dt.date.fromisoformat(s)
TRAVEL = "seq int, applicant string, department string, center string, category string, start date, end date, status string, approval_id string"
OT = "seq int, applicant string, department string, center string, work_date date, hours double, status string, approval_id string"
LEAVE = "seq int, applicant string, department string, center string, leave_kind string, start date, end date, duration_text string, status string, approval_id string"
PUNCH = "seq int, person_name string, work_date date, punch_time timestamp_ntz, address string"


def run(spark, travel=(), overtime=(), leave=(), punch=(), holidays=(), **more):
    trip = [(i, "ann", "c/d", "c", cat, D(a), D(b), status, f"t{i}") for i, (cat, a, b, status) in enumerate(travel)]
    ot = [(i, "ann", "", "", D(d), h, "已通过", f"o{i}") for i, (d, h) in enumerate(overtime)]
    lv = [(i, "ann", "", "", "调休", D(a) if a else None, D(b) if b else None, t, "已通过", f"l{i}") for i, (a, b, t) in enumerate(leave)]
    pu = [(i, "ann", D(d), dt.datetime.fromisoformat(f"{d} {t}") if t else None, adr) for i, (d, t, adr) in enumerate(punch)]
    f = spark.createDataFrame
    args = f(trip, TRAVEL), f(ot, OT), f(lv, LEAVE), f(pu, PUNCH), ["HQ"], f([(D(h),) for h in holidays], "day date")
    return ledger.compute_ledger(*args, **more)


@pytest.mark.parametrize(
    "trips, credit",
    [
        ([("项目出差", "2024-01-01", "2024-01-29", "已通过")], 0.0),
        ([("项目出差", "2024-01-01", "2024-01-30", "通过")], 2.0),
        ([("项目出差", "2024-01-01", "2024-01-29", "已通过"), ("项目出差", "2024-01-31", "2024-02-01", "已通过")], 2.0),
        ([("项目出差", "2024-01-01", "2024-01-29", "已通过"), ("项目出差", "2024-02-01", "2024-02-01", "已通过")], 0.0),
        ([("非项目出差", "2024-01-01", "2024-02-29", "已通过"), ("项目出差", "2024-01-01", "2024-01-01", "已通过")], 0.0),
    ],
)
def test_credit_is_per_merged_segment(spark, trips, credit):
    assert run(spark, trips).first().travel_comp_days == credit


def test_headquarters_punch_cuts_the_trip_and_frees_later_overtime(spark):
    r = run(spark, [("项目出差", "2024-01-01", "2024-03-30", "已通过")], [("2024-01-20", 8.0), ("2024-02-10", 8.0)], punch=[("2024-02-05", "09:00", "HQ tower"), ("2024-02-10", "08:00", "x"), ("2024-02-10", "18:00", "x")]).first()
    assert (r.actual_travel_end, r.travel_comp_days, r.ot_dates, r.ot_comp_days) == ("2024-02-05", 2.0, "2024-02-10", 1.0)


def test_overtime_rules_and_resolutions(spark):
    days = [("2024-01-01", 8.0), ("2024-01-02", 8.0), ("2024-01-03", 9.0), ("2024-01-04", 9.0), ("2024-01-05", 3.0)]
    punches = [("2024-01-01", "08:00", "a"), ("2024-01-01", "17:00", "a"), ("2024-01-03", "08:00", "a"), ("2024-01-03", "10:00", "a"), ("2024-01-04", None, "a"), ("2024-01-05", "08:00", "a")]
    r = run(spark, overtime=days, punch=punches).first()
    assert [d.credit for d in r.ot_days] == [1.0, 0.0, 0.0, 1.0, 1.0] and r.ot_comp_days == 3.0
    res = spark.createDataFrame([("ann", D("2024-01-02"), "accept_half"), ("ann", D("2024-01-01"), "exclude")], "person string, date date, action string")
    r = run(spark, overtime=days, punch=punches, resolutions=res).first()
    assert [d.credit for d in r.ot_days] == [0.0, 0.5, 0.0, 1.0, 1.0]


def test_holiday_inside_a_trip_counts_and_is_marked(spark):
    r = run(spark, [("项目出差", "2024-01-01", "2024-01-10", "已通过")], [("2024-01-02", 8.0), ("2024-01-03", 8.0)], punch=[("2024-01-02", "08:00", "a"), ("2024-01-02", "17:00", "a")], holidays=["2024-01-02"]).first()
    assert (r.ot_dates, len(r.ot_days)) == ("2024-01-02(法定)", 1)


def test_leave_days_and_bounds(spark):
    r = run(spark, leave=[("2024-01-01", "2024-01-03", "2.5天"), ("2024-01-05", None, ""), (None, "2024-01-20", "3天"), ("2024-02-01", "2024-02-02", "")]).first()
    assert (r.used_comp_days, r.remaining_comp_days, r.leave_start, r.leave_end) == (8.5, -8.5, "2024-01-01", "2024-02-02")
    assert [(s.start, s.end) for s in r.leave_segments][2] == ("2024-01-18", "2024-01-20")


def test_merge_unites_trips_and_drops_overtime_inside(spark):
    a = run(spark, [("项目出差", "2024-01-01", "2024-01-20", "已通过")], [("2024-01-25", 8.0)], punch=[("2024-01-25", "08:00", "a")])
    b = run(spark, [("项目出差", "2024-01-22", "2024-01-31", "已通过")])
    m = ledger.merge_ledgers(a, b, spark.createDataFrame([], "day date")).first()
    assert (m.travel_comp_days, m.ot_comp_days, m.actual_travel_end) == (2.0, 0.0, "2024-01-31")


def test_resolutions_merge_shallow_or_deep(spark):
    old = spark.createDataFrame([("c", {"a": "1", "b": "2"})], "code string, actions map<string,string>")
    new = spark.createDataFrame([("c", {"b": "3"})], "code string, actions map<string,string>")
    assert ledger.merge_resolutions(old, new, False).first().actions == {"b": "3"}
    assert ledger.merge_resolutions(old, new, True).first().actions == {"a": "1", "b": "3"}
