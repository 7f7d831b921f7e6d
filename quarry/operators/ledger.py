"""Compensatory-leave ledger: travel, overtime and leave against punches, and its merge across periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import block_credit, day_count, days_between, inside_any, merge_intervals

ROLES = ("travel", "overtime", "leave", "punch")
#: Credits of the review's decisions on an overtime day.
OT_ACTIONS = {"exclude": 0.0, "accept_half": 0.5, "accept_full": 1.0}


def approved(status: Column) -> Column:
    return F.coalesce(status.contains("已通过") | (status == "通过"), F.lit(False))


def is_project(category: Column) -> Column:
    c = F.coalesce(category, F.lit(""))
    return c.contains("项目") & ~c.contains("非项目")


def is_non_project(category: Column) -> Column:
    return F.coalesce(category, F.lit("")).contains("非项目")


def center_of(department: Column) -> Column:
    """What stands before the first ``/``."""
    return F.split(department, "/")[0]


def matches_keyword(address: Column, keywords: list[str]) -> Column:
    a = F.coalesce(address, F.lit(""))
    hit = F.lit(False)
    for k in keywords:
        hit = hit | a.contains(k)
    return hit


def leave_days(text: Column, start: Column, end: Column) -> Column:
    """``N天`` in the text; else inclusive days; else 1 if one bound is known; else 0."""
    said = F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d+(?:\.\d+)?)\s*天", 1)
    return F.when(said != "", said.cast("double")).when(start.isNotNull() & end.isNotNull(), day_count(start, end).cast("double")).when(start.isNotNull() | end.isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))


def complete_bounds(start: Column, end: Column, days: Column) -> tuple[Column, Column]:
    """The missing bound from the number of days, rounded up."""
    span = F.greatest(F.ceil(days).cast("int") - 1, F.lit(0))
    return F.coalesce(start, F.date_sub(end, span)), F.coalesce(end, F.date_add(start, span))


def punch_spans(punch: DataFrame) -> DataFrame:
    """Per person and day: number of punches and hours from first to last (one time: 0; none: null)."""
    seconds = F.unix_micros(F.max("punch_time").cast("timestamp")) - F.unix_micros(F.min("punch_time").cast("timestamp"))
    return punch.groupBy("person_name", "work_date").agg(F.count(F.lit(1)).alias("punches"), (seconds / 3.6e9).alias("span_hours"))


def profiles(*sources: DataFrame) -> DataFrame:
    """Person with the first non-blank center and department, in order of the sources and of ``seq``."""
    rows = None
    for i, s in enumerate(sources):
        part = s.select(F.col("applicant").alias("person_name"), "center", "department", F.struct(F.lit(i).alias("source"), "seq").alias("_o"))
        rows = part if rows is None else rows.unionByName(part)
    first = lambda c: F.coalesce(F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("_o"))), F.lit("")).alias(c)
    return rows.groupBy("person_name").agg(first("center"), first("department"))


def truncated_travel(travel: DataFrame, punch: DataFrame, hq_keywords: list[str]) -> DataFrame:
    """Project trips with ``actual_end``: the first day with a punch at headquarters; and ``unknown_address``: some day has only punches without address."""
    at_hq = matches_keyword(F.col("address"), hq_keywords) & (F.coalesce("address", F.lit("")) != "")
    p = punch.select(F.col("person_name").alias("applicant"), F.col("work_date").alias("_day"), "address")
    by_day = p.groupBy("applicant", "_day").agg(F.max(at_hq).alias("_hq"), F.min(F.coalesce("address", F.lit("")) == "").alias("_blank"))
    days = travel.select("seq", "applicant", F.explode(days_between(F.col("start"), F.col("end"))).alias("_day"))
    seen = days.join(by_day, ["applicant", "_day"]).groupBy("seq").agg(F.min(F.when(F.col("_hq"), F.col("_day"))).alias("_hq_day"), F.max("_blank").alias("unknown_address"))
    return travel.join(seen, "seq", "left").withColumn("actual_end", F.least("end", F.coalesce("_hq_day", "end"))).withColumn("unknown_address", F.coalesce("unknown_address", F.lit(False))).drop("_hq_day")


def travel_segments(trips: DataFrame, gap_days: int = 1) -> DataFrame:
    """Merged actual trips per person with credit per merged segment, and the system bounds of what was merged."""
    merged = merge_intervals(trips, ["person_name"], "actual_start", "actual_end", gap_days, [F.min("system_start").alias("system_start"), F.max("system_end").alias("system_end")])
    return merged.withColumn("days", day_count(F.col("actual_start"), F.col("actual_end"))).withColumn("credit", block_credit(F.col("days")))


def overtime_credits(overtime: DataFrame, segments: DataFrame, punch: DataFrame, holidays: DataFrame, resolutions: DataFrame | None, full_day: float = 8.0, half_day: float = 4.0) -> DataFrame:
    """Approved overtime days with ``credit`` and ``reason``; days of a trip that are no holidays are dropped.

    Order of the rules: the review's decision; in a trip and no holiday; no punch; a full-day
    claim with a short span of punches; else one day.
    """
    days = segments.select("person_name", F.explode(days_between(F.col("actual_start"), F.col("actual_end"))).alias("work_date")).distinct().withColumn("in_travel", F.lit(True))
    o = overtime.select(F.col("applicant").alias("person_name"), "work_date", "hours", "seq")
    o = o.join(days, ["person_name", "work_date"], "left").join(holidays.select(F.col("day").alias("work_date"), F.lit(True).alias("holiday")).distinct(), "work_date", "left")
    o = o.join(punch_spans(punch), ["person_name", "work_date"], "left")
    if resolutions is not None:
        o = o.join(resolutions.select(F.col("person").alias("person_name"), F.col("date").alias("work_date"), "action"), ["person_name", "work_date"], "left")
    else:
        o = o.withColumn("action", F.lit(None).cast("string"))
    o = o.na.fill(False, ["in_travel", "holiday"])
    decided = F.coalesce(F.col("action").isin(*OT_ACTIONS), F.lit(False))
    granted = F.lit(0.0)
    for a, c in OT_ACTIONS.items():
        granted = F.when(F.col("action") == a, F.lit(c)).otherwise(granted)
    reason = (
        F.when(decided, "resolved")
        .when(F.col("in_travel") & ~F.col("holiday"), "in_travel")
        .when(F.col("punches").isNull(), "ot_missing_punch")
        .when((F.coalesce("hours", F.lit(0.0)) >= full_day) & F.col("span_hours").isNotNull() & (F.col("span_hours") < half_day), "ot_half_day_mismatch")
        .otherwise("credited")
    )
    o = o.withColumn("reason", reason).where("reason != 'in_travel'")
    return o.withColumn("credit", F.when(F.col("reason") == "resolved", granted).when(F.col("reason") == "credited", F.lit(1.0)).otherwise(F.lit(0.0)))


def overtime_labels(days: Column) -> Column:
    """Dates with positive credit, holidays marked, in the order of the array."""
    kept = F.filter(days, lambda d: d["credit"] > 0)
    return F.array_join(F.transform(kept, lambda d: F.concat(d["date"], F.when(d["holiday"], F.lit("(法定)")).otherwise(F.lit("")))), "、")


def compute_ledger(travel: DataFrame, overtime: DataFrame, leave: DataFrame, punch: DataFrame, hq_keywords: list[str], holidays: DataFrame, include: DataFrame | None = None, resolutions: DataFrame | None = None, gap_days: int = 1, full_day: float = 8.0, half_day: float = 4.0) -> DataFrame:
    """One row per person with any trip, overtime or leave: segments, credits, days used and days left.

    ``include`` (key) names unapproved records that the review counts all the same.
    """
    iso = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    trips = _counted(travel, F.concat_ws(":", F.lit("travel"), "applicant", F.coalesce(F.when(F.col("approval_id") != "", F.col("approval_id")), F.col("start").cast("string"), F.lit("None")), "status"), include)
    trips = trips.where("start is not null and end is not null").where(is_project(F.col("category")))
    trips = truncated_travel(trips, punch, hq_keywords).select(F.col("applicant").alias("person_name"), F.col("start").alias("system_start"), F.col("end").alias("system_end"), F.col("start").alias("actual_start"), "actual_end")
    segments = travel_segments(trips, gap_days)
    ot = _counted(overtime, F.concat_ws(":", F.lit("ot"), "applicant", F.col("work_date").cast("string"), "approval_id"), include)
    credits = overtime_credits(ot, segments, punch, holidays, resolutions, full_day, half_day)
    used = _counted(leave.where(F.coalesce("leave_kind", F.lit("")).contains("调休")), F.concat_ws(":", F.lit("leave"), "applicant", "approval_id", F.coalesce(F.col("start").cast("string"), F.lit("None"))), include)
    used = used.withColumn("used_days", leave_days(F.col("duration_text"), F.col("start"), F.col("end")))
    bounds = complete_bounds(F.col("start"), F.col("end"), F.col("used_days"))
    used = used.select(F.col("applicant").alias("person_name"), "seq", "used_days", bounds[0].alias("_ls"), bounds[1].alias("_le"))

    remark = F.when(F.col("days") >= 30, F.format_string("项目出差%d天→%d天", "days", F.col("credit").cast("int"))).otherwise(F.format_string("项目出差%d天不足30不计", "days"))
    seg = F.struct("island", *(F.col(c).cast("string").alias(c) for c in ("system_start", "system_end", "actual_start", "actual_end")), "credit")
    t = segments.groupBy("person_name").agg(
        F.min("system_start").alias("system_travel_start"), F.max("system_end").alias("system_travel_end"), F.min("actual_start").alias("actual_travel_start"), F.max("actual_end").alias("actual_travel_end"),
        F.sum("credit").alias("travel_comp_days"), F.sort_array(F.collect_list(seg)).alias("_seg"), F.sort_array(F.collect_list(F.struct("island", remark.alias("r")))).alias("_rem"),
    )
    o = credits.groupBy("person_name").agg(F.sum("credit").alias("ot_comp_days"), F.sort_array(F.collect_list(F.struct("seq", F.col("work_date").cast("string").alias("date"), "credit", "holiday"))).alias("_ot"))
    lv = used.where("used_days > 0").groupBy("person_name").agg(F.sum("used_days").alias("used_comp_days"), F.min("_ls").alias("leave_start"), F.max("_le").alias("leave_end"), F.sort_array(F.collect_list(F.struct("seq", F.col("_ls").cast("string").alias("start"), F.col("_le").cast("string").alias("end"), "used_days"))).alias("_lv"))
    people = trips.select("person_name").union(ot.select("applicant")).union(used.select("person_name")).distinct()
    every = people.join(profiles(travel, overtime, leave), "person_name", "left").join(t, "person_name", "left").join(o, "person_name", "left").join(lv, "person_name", "left")
    total = F.coalesce("travel_comp_days", F.lit(0.0)) + F.coalesce("ot_comp_days", F.lit(0.0))
    spent = F.coalesce("used_comp_days", F.lit(0.0))
    no = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return every.select(
        "person_name", F.coalesce("center", F.lit("")).alias("center"), F.coalesce("department", F.lit("")).alias("department"),
        iso("system_travel_start").alias("system_travel_start"), iso("system_travel_end").alias("system_travel_end"), iso("actual_travel_start").alias("actual_travel_start"), iso("actual_travel_end").alias("actual_travel_end"),
        F.coalesce("travel_comp_days", F.lit(0.0)).alias("travel_comp_days"),
        F.coalesce(overtime_labels(F.transform("_ot", lambda d: d)), F.lit("")).alias("ot_dates"), F.coalesce("ot_comp_days", F.lit(0.0)).alias("ot_comp_days"), total.alias("total_comp_days"),
        iso("leave_start").alias("leave_start"), iso("leave_end").alias("leave_end"), spent.alias("used_comp_days"), (total - spent).alias("remaining_comp_days"),
        F.coalesce(F.array_join(F.transform("_rem", lambda x: x["r"]), "；"), F.lit("")).alias("remark"),
        no(F.transform("_seg", lambda s: F.struct(*(s[c].alias(c) for c in ("system_start", "system_end", "actual_start", "actual_end", "credit")))), SEGMENT).alias("travel_segments"),
        no(F.transform("_ot", lambda d: F.struct(*(d[c].alias(c) for c in ("date", "credit", "holiday")))), OT_DAY).alias("ot_days"),
        no(F.transform("_lv", lambda d: F.struct(*(d[c].alias(c) for c in ("start", "end", "used_days")))), LEAVE).alias("leave_segments"),
    )


SEGMENT = "array<struct<system_start: string, system_end: string, actual_start: string, actual_end: string, credit: double>>"
OT_DAY = "array<struct<date: string, credit: double, holiday: boolean>>"
LEAVE = "array<struct<start: string, end: string, used_days: double>>"


def _counted(df: DataFrame, key: Column, include: DataFrame | None) -> DataFrame:
    """Approved records, and those that the review includes by key."""
    d = df.withColumn("_key", F.concat(F.lit("approval_not_passed:"), key))
    if include is None:
        return d.where(approved(F.col("status"))).drop("_key")
    return d.join(include.select(F.col("key").alias("_key"), F.lit(True).alias("_in")).distinct(), "_key", "left").where(approved(F.col("status")) | F.coalesce("_in", F.lit(False))).drop("_key", "_in")


def totals(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count(F.lit(1)).alias("person_count"), F.coalesce(F.sum("total_comp_days"), F.lit(0.0)).alias("total_comp_days"), F.coalesce(F.sum("used_comp_days"), F.lit(0.0)).alias("used_comp_days"))


def missing_roles(present: DataFrame) -> DataFrame:
    """``missing_source_*`` codes of required roles that ``present`` (role) lacks."""
    need = present.sparkSession.createDataFrame([(r,) for r in ROLES], "role string")
    return need.join(present.select("role").distinct(), "role", "left_anti").select(F.concat(F.lit("missing_source_"), "role").alias("code"), "role")


def warnings(travel: DataFrame, overtime: DataFrame, leave: DataFrame, punch: DataFrame, hq_keywords: list[str], holidays: DataFrame | None, include: DataFrame | None = None, resolutions: DataFrame | None = None, gap_days: int = 1, full_day: float = 8.0, half_day: float = 4.0) -> DataFrame:
    """code, person, date, kind, blocking: one select per warning code, united."""
    none = F.lit(None).cast("string")

    def pick(df, code, person, day=none, kind=none, blocking=True):
        return df.select(F.lit(code).alias("code"), person.alias("person"), day.alias("date"), kind.alias("kind"), F.lit(blocking).alias("blocking"))

    late = lambda df, kind: pick(df.where(~approved(F.col("status"))), "approval_not_passed", F.col("applicant"), none, F.lit(kind))
    key = F.concat_ws(":", F.lit("travel"), "applicant", F.coalesce(F.when(F.col("approval_id") != "", F.col("approval_id")), F.col("start").cast("string"), F.lit("None")), "status")
    counted = _counted(travel, key, include)
    dated = counted.where("start is not null and end is not null")
    trips = truncated_travel(dated.where(is_project(F.col("category"))), punch, hq_keywords)
    segs = travel_segments(trips.select(F.col("applicant").alias("person_name"), F.col("start").alias("system_start"), F.col("end").alias("system_end"), F.col("start").alias("actual_start"), "actual_end"), gap_days)
    days = holidays if holidays is not None else travel.sparkSession.createDataFrame([], "day date")
    ot = _counted(overtime, F.concat_ws(":", F.lit("ot"), "applicant", F.col("work_date").cast("string"), "approval_id"), include)
    credits = overtime_credits(ot, segs, punch, days, resolutions, full_day, half_day)
    out = (
        late(travel, "travel")
        .unionByName(late(overtime, "overtime"))
        .unionByName(late(leave.where(F.coalesce("leave_kind", F.lit("")).contains("调休")), "leave"))
        .unionByName(pick(counted.where("start is null or end is null"), "travel_missing_dates", F.col("applicant")))
        .unionByName(pick(dated.where(~is_project(F.col("category")) & ~is_non_project(F.col("category"))), "travel_category_unknown", F.col("applicant"), blocking=False))
        .unionByName(pick(trips.where("unknown_address"), "hq_address_unknown", F.col("applicant"), F.col("start").cast("string")))
    )
    for code in ("ot_missing_punch", "ot_half_day_mismatch"):
        out = out.unionByName(pick(credits.where(F.col("reason") == code), code, F.col("person_name"), F.col("work_date").cast("string")))
    if holidays is None:
        out = out.unionByName(pick(travel.sparkSession.range(1), "holidays_calendar_missing", none, blocking=False))
    return out


def open_warnings(found: DataFrame, resolved: DataFrame) -> DataFrame:
    """Blocking warnings without a resolution of the same code and ``person:date`` key."""
    key = F.concat_ws(":", "person", "date")
    done = resolved.select("code", F.col("key").alias("_key")).distinct()
    return found.where("blocking").withColumn("_key", key).join(done, ["code", "_key"], "left_anti").drop("_key")


def decode_resolutions(resolved: DataFrame) -> DataFrame:
    """person, date, action of overtime resolutions, from rows with code and a map of ``person:date`` to action."""
    d = resolved.where(F.col("code").isin("ot_missing_punch", "ot_half_day_mismatch")).select(F.explode("actions").alias("k", "action"))
    parts = F.split("k", ":", 2)
    return d.select(parts[0].alias("person"), F.to_date(parts[1]).alias("date"), "action")


def merge_resolutions(old: DataFrame, new: DataFrame, deep: bool) -> DataFrame:
    """code -> actions: later wins, for a whole code (``deep`` false) or key by key."""
    o, n = old.select("code", F.col("actions").alias("_o")), new.select("code", F.col("actions").alias("_n"))
    both = o.join(n, "code", "full_outer")
    if not deep:
        return both.select("code", F.coalesce("_n", "_o").alias("actions"))
    kept = F.map_filter("_o", lambda k, v: ~F.map_contains_key(F.col("_n"), k))
    return both.select("code", F.when(F.col("_o").isNull(), F.col("_n")).when(F.col("_n").isNull(), F.col("_o")).otherwise(F.map_concat(kept, "_n")).alias("actions"))


def backfill_segments(rows: DataFrame) -> DataFrame:
    """Segment lists made from the aggregate columns where an older snapshot lacks them."""
    t = F.struct(*(F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in (("system_travel_start", "system_start"), ("system_travel_end", "system_end"), ("actual_travel_start", "actual_start"), ("actual_travel_end", "actual_end"))), F.coalesce("travel_comp_days", F.lit(0.0)).alias("credit"))
    first = F.trim(F.regexp_replace(F.split(F.coalesce("ot_dates", F.lit("")), "、")[0], r"\(法定\)", ""))
    day = F.struct(first.alias("date"), F.col("ot_comp_days").alias("credit"), F.lit(None).cast("boolean").alias("holiday"))
    off = F.struct(F.coalesce("leave_start", F.lit("")).alias("start"), F.coalesce("leave_end", F.lit("")).alias("end"), F.coalesce("used_comp_days", F.lit(0.0)).alias("used_days"))
    void = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    none = F.array()
    return rows.withColumns(
        {
            "travel_segments": F.when(~void("travel_segments"), F.col("travel_segments")).when(has("system_travel_start") | has("actual_travel_start"), F.array(t)).otherwise(none.cast(SEGMENT)),
            "ot_days": F.when(~void("ot_days"), F.col("ot_days")).when((F.coalesce("ot_comp_days", F.lit(0.0)) > 0) & (first != ""), F.array(day)).otherwise(none.cast(OT_DAY)),
            "leave_segments": F.when(~void("leave_segments"), F.col("leave_segments")).when(has("leave_start") | (F.coalesce("used_comp_days", F.lit(0.0)) != 0), F.array(off)).otherwise(none.cast(LEAVE)),
        }
    )


def prior_keys(prior: DataFrame) -> DataFrame:
    """(person, date) of every overtime day of a prior ledger."""
    d = backfill_segments(prior).select(F.col("person_name").alias("person"), F.explode("ot_days").alias("d"))
    return d.select("person", F.substring(F.trim(F.regexp_replace("d.date", r"\(法定\)", "")), 1, 10).alias("date")).where("person != '' and date != ''").distinct()


def uncovered_warnings(found: DataFrame, prior: DataFrame) -> DataFrame:
    """Warnings but for overtime codes on days that the prior ledger has."""
    codes = ["ot_missing_punch", "ot_half_day_mismatch"]
    hit = found.where(F.col("code").isin(codes)).join(prior_keys(prior), ["person", "date"], "left_anti")
    return found.where(~F.col("code").isin(codes)).unionByName(hit.select(*found.columns))


def merge_ledgers(prior: DataFrame, current: DataFrame, holidays: DataFrame, gap_days: int = 1) -> DataFrame:
    """Ledger of two periods: trips united and merged anew, days and leaves by key with the prior's winning, credits summed again."""
    a = backfill_segments(prior).withColumn("_p", F.lit(0))
    b = backfill_segments(current).withColumn("_p", F.lit(1))
    cols = ["person_name", "center", "department", "travel_segments", "ot_days", "leave_segments", "_p"]
    both = a.select(*cols).unionByName(b.select(*cols)).where("person_name != ''")
    pick = lambda c: F.coalesce(F.max_by(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("_p"))), F.lit("")).alias(c)
    people = both.groupBy("person_name").agg(pick("center"), pick("department"))
    s = both.select("person_name", F.explode("travel_segments").alias("s"))
    actual = lambda k: F.to_date(F.when(F.col(f"s.{k}") != "", F.col(f"s.{k}")))
    trips = s.select("person_name", actual("actual_start").alias("actual_start"), actual("actual_end").alias("actual_end"), actual("system_start").alias("_ss"), actual("system_end").alias("_se")).where("actual_start is not null and actual_end is not null")
    trips = trips.select("person_name", "actual_start", "actual_end", F.coalesce("_ss", "actual_start").alias("system_start"), F.coalesce("_se", "actual_end").alias("system_end"))
    segs = travel_segments(trips, gap_days)
    first = lambda *k: Window.partitionBy("person_name", *k).orderBy("_p", "_i")  # noqa: E731  the prior period is 0, then the lists' order
    ot = both.select("person_name", "_p", F.posexplode("ot_days").alias("_i", "d")).select("person_name", "_p", "_i", F.col("d.date").alias("date"), F.col("d.credit").alias("credit")).where("date != ''")
    ot = ot.withColumn("_r", F.row_number().over(first("date"))).where("_r = 1").withColumn("day", F.to_date(F.substring("date", 1, 10)))
    ot = ot.join(holidays.select("day", F.lit(True).alias("holiday")).distinct(), "day", "left").na.fill(False, ["holiday"])
    in_travel = inside_any(ot.where("not holiday"), segs, ["person_name"], "day", "actual_start", "actual_end", "left_anti")
    ot = ot.where("holiday").unionByName(in_travel.select(*ot.columns))
    lv = both.select("person_name", "_p", F.posexplode("leave_segments").alias("_i", "l")).select("person_name", "_p", "_i", "l.start", "l.end", "l.used_days")
    lv = lv.withColumn("_r", F.row_number().over(first("start", "end"))).where("_r = 1")
    t = segs.groupBy("person_name").agg(F.min("actual_start").cast("string").alias("actual_travel_start"), F.max("actual_end").cast("string").alias("actual_travel_end"), F.sum("credit").alias("travel_comp_days"))
    o = ot.groupBy("person_name").agg(F.sum("credit").alias("ot_comp_days"), overtime_labels(F.sort_array(F.collect_list(F.struct("date", "credit", "holiday")))).alias("ot_dates"))
    u = lv.groupBy("person_name").agg(F.sum("used_days").alias("used_comp_days"), F.min(F.when(F.col("start") != "", F.col("start"))).alias("leave_start"), F.max(F.when(F.col("end") != "", F.col("end"))).alias("leave_end"))
    every = people.join(t, "person_name", "left").join(o, "person_name", "left").join(u, "person_name", "left")
    every = every.na.fill(0.0, ["travel_comp_days", "ot_comp_days", "used_comp_days"]).na.fill("")
    return every.withColumn("total_comp_days", F.col("travel_comp_days") + F.col("ot_comp_days")).withColumn("remaining_comp_days", F.col("total_comp_days") - F.col("used_comp_days"))


def export_rows(ledger: DataFrame) -> DataFrame:
    """The three lists side by side: as many rows per person as the longest has (credited days only), totals on the first."""
    d = ledger.withColumn("_ot", F.filter("ot_days", lambda x: x["credit"] > 0))
    d = d.withColumn("_z", F.arrays_zip(F.col("travel_segments").alias("t"), F.col("_ot").alias("o"), F.col("leave_segments").alias("l")))
    d = d.select("person_name", "total_comp_days", "used_comp_days", "remaining_comp_days", F.posexplode_outer("_z").alias("pos", "z"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    return d.select("person_name", F.coalesce("pos", F.lit(0)).alias("row"), F.col("z.t.actual_start").alias("travel_start"), F.col("z.t.actual_end").alias("travel_end"), F.col("z.o.date").alias("ot_date"), F.col("z.l.start").alias("leave_start"), *(F.when(first, F.col(c)).alias(c) for c in ("total_comp_days", "used_comp_days", "remaining_comp_days")))


def longest_named(texts: DataFrame, names: DataFrame) -> DataFrame:
    """For each text (text_id, text) the longest of the names (name) that it contains, all of them if they tie.

    A name is met through its first 1, 2, 4 ... or 64 characters, as many as it has, at any place of the text; then the whole name is looked for.
    """
    n = names.select("name").where("name is not null").distinct()
    n = n.withColumn("_g", F.least(F.lit(64), F.expr("cast(pow(2, floor(log2(greatest(length(name), 1)))) as int)"))).withColumn("_gram", F.expr("substring(name, 1, _g)"))
    sizes = sorted(r[0] for r in n.select("_g").distinct().collect())
    # a lookahead finds the runs at every character in one pass
    runs = [F.regexp_extract_all(F.col("text"), F.lit(f"(?s)(?=(.{{{g}}}))"), F.lit(1)) for g in sizes]
    grams = F.array_distinct(F.concat(F.array(F.lit("")), *runs))
    met = texts.select("text_id", F.explode(grams).alias("_gram")).join(n, "_gram").select("text_id", "name").distinct()
    hits = met.join(texts.select("text_id", "text"), "text_id").where(F.contains("text", "name")).select("text_id", "name")
    best = Window.partitionBy("text_id").orderBy(F.length("name").desc())
    return hits.withColumn("_r", F.rank().over(best)).where("_r = 1").select("text_id", "name")
