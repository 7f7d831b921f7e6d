"""Monthly attendance: punch locations, travel from approvals and punches, half-day symbols, tallies, checks.

Company labels, overseas words and the default site are parameters; nothing here names a place.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import day_runs, days_between, inside_any

PRESENT, DOMESTIC, OVERSEAS, MISSING, LEAVE = "√", "￥", "＄", "×", "假"
#: Latin names that count as overseas where no configured keyword fits.
LATIN_OVERSEAS = ["thailand", "vietnam", "indonesia", "singapore", "malaysia"]
DEPARTED = r"[（(\[【][^）)\]】]*(?:已)?离职[^）)\]】]*[）)\]】]"


@dataclass
class Places:
    """Company labels by site, words of homes and ways there, overseas keywords, and the site of people without one."""

    labels: dict[str, list[str]]
    transit: list[str] = field(default_factory=list)
    overseas: list[str] = field(default_factory=list)
    default_site: str = ""


def normalize_name(name: Column) -> Column:
    """Without departed marks and blanks, interpuncts unified; a name that is only a mark stays."""
    t = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)^\s+|\s+$", "")
    bare = F.regexp_replace(F.regexp_replace(t, DEPARTED, ""), r"(?U)\s+", "")
    return F.translate(F.when(bare == "", t).otherwise(bare), "·･・", "•••")


def marked_departed(name: Column) -> Column:
    n = F.coalesce(name, F.lit(""))
    return n.rlike(DEPARTED) | (n.contains("离职") & ~n.contains("在职"))


def with_base_site(roster: DataFrame, default: str) -> DataFrame:
    s = F.trim(F.coalesce("base_site", F.lit("")))
    return roster.withColumn("base_site", F.when(s != "", s).otherwise(F.lit(default)))


def overseas_token(text: Column, keywords: list[str]) -> Column:
    """The first configured keyword in the text, else a Latin fallback, else null."""
    t = F.coalesce(text, F.lit(""))
    hits = [F.when(t.contains(k), F.lit(k)) for k in keywords] + [F.when(F.lower(t).contains(k), F.lit(k)) for k in LATIN_OVERSEAS]
    return F.coalesce(*hits)


def classify(address: Column, status: Column, base: Column, places: Places) -> Column:
    """base_company, other_company, home_transit, field or unknown; an overseas address is never the base company."""
    a = F.coalesce(address, F.lit(""))
    at = lambda words: F.lit(False) if not words else _any(a.contains(w) for w in words)
    own, other = F.lit(False), F.lit(False)
    for site, labels in places.labels.items():
        own = own | ((base == site) & at(labels))
        other = other | ((base != site) & at(labels))
    abroad = overseas_token(a, places.overseas).isNotNull()
    none = (F.trim(a) == "") | F.coalesce(status, F.lit("")).contains("缺卡")
    return F.when(none, "unknown").when(own & ~abroad, "base_company").when(own, "field").when(other, "other_company").when(at(places.transit), "home_transit").otherwise("field")


def _any(flags) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | f
    return out


def located(punch: DataFrame, roster: DataFrame, places: Places) -> DataFrame:
    """Punches with ``person`` (normalised name), ``kind`` and ``abroad`` token; the person's site comes from the roster."""
    r = with_base_site(roster, places.default_site).select(normalize_name(F.col("name")).alias("person"), "base_site").groupBy("person").agg(F.first("base_site").alias("base_site"))
    p = punch.withColumn("person", normalize_name(F.col("person_name"))).join(r, "person", "left").withColumn("base_site", F.coalesce("base_site", F.lit(places.default_site)))
    return p.withColumn("kind", classify(F.col("address"), F.col("status"), F.col("base_site"), places)).withColumn("abroad", overseas_token(F.col("address"), places.overseas))


def clear_mixed_days(loc: DataFrame, places: Places) -> DataFrame:
    """Bare company labels are blanked on days with a punch in the field or abroad."""
    away = (F.col("kind").isin("field", "other_company") | F.col("abroad").isNotNull()).cast("int")
    d = loc.withColumn("_away", F.max(away).over(Window.partitionBy("person", "work_date")))
    bare = F.trim("address").isin(*[w for ws in places.labels.values() for w in ws])
    hit = (F.col("_away") == 1) & bare & F.col("abroad").isNull()
    return d.withColumns({"address": F.when(hit, "").otherwise(F.col("address")), "kind": F.when(hit, "unknown").otherwise(F.col("kind"))}).drop("_away")


def _approved(travel: DataFrame) -> DataFrame:
    return travel.where(F.coalesce("status", F.lit("")).contains("通过") & F.col("start").isNotNull() & F.col("end").isNotNull())


def first_field_day(travel: DataFrame, loc: DataFrame) -> DataFrame:
    """seq and the first day of the trip on which the person punched in the field or at another company."""
    days = travel.select("seq", normalize_name(F.col("applicant")).alias("person"), F.explode(days_between(F.col("start"), F.col("end"))).alias("work_date"))
    away = loc.where(F.col("kind").isin("field", "other_company")).select("person", "work_date").distinct()
    return days.join(away, ["person", "work_date"]).groupBy("seq").agg(F.min("work_date").alias("field_day"))


def shift_overseas_starts(travel: DataFrame, loc: DataFrame, places: Places) -> DataFrame:
    """Approved trips abroad start on their first day in the field."""
    abroad = overseas_token(F.col("location"), places.overseas).isNotNull()
    ok = _approved(travel).where(abroad)
    t = travel.join(first_field_day(ok, loc), "seq", "left")
    return t.withColumn("start", F.greatest("start", F.coalesce("field_day", "start"))).drop("field_day")


def overseas_runs(travel: DataFrame, loc: DataFrame) -> DataFrame:
    """person, start, end, location: consecutive days with punches abroad (not at the base company) that no approved trip covers."""
    days = loc.where("abroad is not null and kind != 'base_company' and person != ''").select("person", "work_date", "abroad", "seq")
    trips = _approved(travel).select(normalize_name(F.col("applicant")).alias("person"), "start", "end")
    open_ = inside_any(days, trips, ["person"], "work_date", "start", "end", "left_anti")
    label = open_.groupBy("person").agg(F.min_by("abroad", "seq").alias("location"))
    runs = day_runs(open_, ["person"], "work_date").groupBy("person", "run").agg(F.min("work_date").alias("start"), F.max("work_date").alias("end"))
    return runs.join(label, "person").select("person", "start", "end", "location")


def field_continuations(travel: DataFrame, loc: DataFrame) -> DataFrame:
    """person, start, end: stretches that begin the day after a real approved trip and go on while the person
    punches in the field at home, not at the base company and not under another trip."""
    trips = _approved(travel).withColumn("person", normalize_name(F.col("applicant")))
    d = loc.where("abroad is null and kind in ('field', 'base_company') and person != ''").groupBy("person", "work_date").agg(F.max(F.col("kind") == "base_company").alias("base")).where("not base")
    free = inside_any(d, trips.select("person", "start", "end"), ["person"], "work_date", "start", "end", "left_anti")
    runs = day_runs(free, ["person"], "work_date").groupBy("person", "run").agg(F.min("work_date").alias("a"), F.max("work_date").alias("b"))
    # a run may hold the day after a trip anywhere: the stretch starts there
    after = trips.where(~F.coalesce("category", F.lit("")).contains("合成")).select("person", F.date_add("end", 1).alias("work_date")).distinct()
    begin = day_runs(free, ["person"], "work_date").join(after, ["person", "work_date"]).select("person", "run", F.col("work_date").alias("start"))
    return begin.join(runs, ["person", "run"]).select("person", "start", F.col("b").alias("end"))


def travel_days(travel: DataFrame, loc: DataFrame, first, last, places: Places) -> DataFrame:
    """person, day, abroad: days of approved trips inside the month, each trip clipped when its person is back.

    A day with base punches only ends the trip before it, a day with both kinds ends it
    after; a start day with base punches only is no travel day but ends nothing; an end at
    08:30 or earlier leaves the end day out.
    """
    t = _approved(travel).withColumn("person", normalize_name(F.col("applicant")))
    early = F.coalesce(F.hour("end_at") * 60 + F.minute("end_at") <= 510, F.lit(False)) & (F.col("end") > F.col("start")) if "end_at" in travel.columns else F.lit(False)
    t = t.withColumn("_last", F.when(early, F.date_sub("end", 1)).otherwise(F.col("end")))
    d = t.select("seq", "person", "start", overseas_token(F.col("location"), places.overseas).isNotNull().alias("abroad"), F.explode(days_between(F.greatest("start", F.lit(first).cast("date")), F.least("_last", F.lit(last).cast("date")))).alias("day"))
    p = loc.groupBy("person", F.col("work_date").alias("day")).agg(F.max(F.col("kind") == "base_company").alias("base"), F.max(F.col("kind").isin("field", "other_company") | F.col("abroad").isNotNull()).alias("away"))
    d = d.join(p, ["person", "day"], "left").na.fill(False, ["base", "away"])
    still_home = (F.col("day") == F.col("start")) & F.col("base") & ~F.col("away")
    clip = F.min(F.when(F.col("base") & ~still_home, F.when(F.col("away"), F.date_add("day", 1)).otherwise(F.col("day")))).over(Window.partitionBy("seq"))
    d = d.withColumn("_clip", clip).where((F.col("_clip").isNull() | (F.col("day") < F.col("_clip"))) & ~still_home)
    return d.groupBy("person", "day").agg(F.max("abroad").alias("abroad"))


def leave_sides(leave: DataFrame) -> DataFrame:
    """person, day, side, leave_kind of approved leave: a half day takes only its side."""
    ok = leave.where(F.coalesce("status", F.lit("")).contains("通过"))
    d = ok.select(normalize_name(F.col("applicant")).alias("person"), "leave_kind", "start", "end", F.coalesce("start_half", F.lit("上午")).alias("a"), F.coalesce("end_half", F.lit("下午")).alias("b"), F.explode(days_between(F.col("start"), F.col("end"))).alias("day"))
    d = d.withColumn("side", F.explode(F.array(F.lit("in"), F.lit("out"))))
    skip = ((F.col("day") == F.col("start")) & (F.col("a") == "下午") & (F.col("side") == "in")) | ((F.col("day") == F.col("end")) & (F.col("b") == "上午") & (F.col("side") == "out"))
    return d.where(~skip).groupBy("person", "day", "side").agg(F.min("leave_kind").alias("leave_kind"))


def month_grid(roster: DataFrame, work_dates: DataFrame, travel: DataFrame, leave: DataFrame, punch: DataFrame, first, last, places: Places, resolutions: DataFrame | None = None) -> DataFrame:
    """person, day, side, symbol, leave_kind, late, conflict of every roster person and work day.

    Order: resolved leave/travel conflicts, travel (a punched side shows ￥ or ＄, a side without
    a punch stays ×), leave, presence, missing.  After the last punch of a departed person nothing counts.
    ``resolutions``: person, day, prefer (travel or leave).
    """
    loc = clear_mixed_days(located(punch, roster, places), places)
    t = shift_overseas_starts(travel, loc, places)
    cols = ["seq", "applicant", "category", "location", "start", "end", "status"]
    made = overseas_runs(t, loc).select(F.xxhash64("person", "start").alias("seq"), F.col("person").alias("applicant"), F.lit("打卡地址海外（合成）").alias("category"), "location", "start", "end", F.lit("已通过").alias("status"))
    every = t.select(*cols).unionByName(made)
    more = field_continuations(every, loc).select(F.xxhash64("person", "start", F.lit(1)).alias("seq"), F.col("person").alias("applicant"), F.lit("打卡外勤续差（合成）").alias("category"), F.lit("").alias("location"), "start", "end", F.lit("已通过").alias("status"))
    away = travel_days(every.unionByName(more), loc, first, last, places).withColumn("travel", F.lit(True))
    sides = leave_sides(leave)
    seen = loc.where(~F.coalesce("status", F.lit("")).contains("缺卡")).groupBy("person", F.col("work_date").alias("day"), "side").agg(F.max(F.coalesce("status", F.lit("")).contains("迟到")).alias("late"), F.max(F.col("kind") == "base_company").alias("at_base"), F.max(F.coalesce("leave_apply", F.lit("")).contains("出差")).alias("says_travel"), F.max(F.col("abroad").isNotNull()).alias("punched_abroad"))
    people = roster.select(normalize_name(F.col("name")).alias("person"), marked_departed(F.col("name")).alias("departed"), "center").dropDuplicates(["person"])
    until = loc.groupBy("person").agg(F.max("work_date").alias("_until"))
    month = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    grid = people.join(until, "person", "left").withColumn("day", F.explode(month)).join(work_dates.select("day").distinct(), "day", "left_semi").withColumn("side", F.explode(F.array(F.lit("in"), F.lit("out"))))
    grid = grid.where(~F.col("departed") | (F.col("day") <= F.coalesce("_until", F.lit("1970-01-01").cast("date"))))
    g = grid.join(away, ["person", "day"], "left").join(sides, ["person", "day", "side"], "left").join(seen.withColumn("punched", F.lit(True)), ["person", "day", "side"], "left")
    if resolutions is not None:
        g = g.join(resolutions.select("person", "day", "prefer"), ["person", "day"], "left")
    else:
        g = g.withColumn("prefer", F.lit(None).cast("string"))
    g = g.na.fill(False, ["travel", "punched", "late", "at_base", "says_travel", "abroad", "punched_abroad"])
    both = F.col("travel") & F.col("leave_kind").isNotNull()
    trip = (F.col("travel") | (F.col("says_travel") & ~F.col("at_base"))) & (F.coalesce("prefer", F.lit("travel")) == "travel")
    off = F.col("leave_kind").isNotNull() & ~(both & trip) & ~(F.col("says_travel") & ~F.col("at_base"))
    sign = F.when(F.col("abroad") | F.col("punched_abroad"), OVERSEAS).otherwise(DOMESTIC)
    symbol = F.when(trip & F.col("punched") & ~F.col("at_base"), sign).when(off, LEAVE).when(F.col("punched"), PRESENT).otherwise(MISSING)
    return g.select("person", "center", "day", "side", symbol.alias("symbol"), F.when(off, F.col("leave_kind")).alias("leave_kind"), F.col("late").alias("late"), (both & F.col("prefer").isNull()).alias("conflict"))


def month_tallies(grid: DataFrame) -> DataFrame:
    """Per person: required days, present, domestic, overseas and leave in half days, late, missing, absent (both sides missing)."""
    half = lambda s: F.sum(F.when(F.col("symbol") == s, 0.5).otherwise(0.0))
    day = grid.groupBy("person", "day").agg((F.sum((F.col("symbol") == MISSING).cast("int")) == 2).alias("absent"))
    a = day.groupBy("person").agg(F.count(F.lit(1)).alias("required"), F.sum(F.col("absent").cast("long")).alias("absent"))
    t = grid.groupBy("person").agg(half(PRESENT).alias("present"), half(DOMESTIC).alias("domestic"), half(OVERSEAS).alias("overseas"), half(LEAVE).alias("leave"), F.sum(F.col("late").cast("long")).alias("late"), F.sum((F.col("symbol") == MISSING).cast("long")).alias("missing"))
    return a.join(t, "person")


def leave_kind_days(grid: DataFrame) -> DataFrame:
    return grid.where("leave_kind is not null").groupBy("person", "leave_kind").agg((F.count(F.lit(1)) * 0.5).alias("days"))


def conflicts(grid: DataFrame) -> DataFrame:
    """person, day: leave on a travel day that no resolution settles."""
    return grid.where("conflict").select("person", "day").distinct()


def off_day_punches(punch: DataFrame, work_dates: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """person, day of punches on other than work days, with the plan: present, full_day or ignore as resolved, else blocking."""
    d = punch.select(normalize_name(F.col("person_name")).alias("person"), F.col("work_date").alias("day")).distinct().join(work_dates.select("day").distinct(), "day", "left_anti")
    if resolutions is None:
        return d.withColumn("plan", F.lit("blocking"))
    return d.join(resolutions.select("person", "day", "action"), ["person", "day"], "left").select("person", "day", F.coalesce("action", F.lit("blocking")).alias("plan"))


def makeup_accepted(makeups: DataFrame, punch: DataFrame, per_month: int = 5) -> DataFrame:
    """Make-up punches (person, day, side) with a real punch on the other side of that day, the first ``per_month`` of a month."""
    real = punch.select("person", "day", F.when(F.col("side") == "in", "out").otherwise("in").alias("side")).distinct()
    w = Window.partitionBy("person", F.trunc("day", "month")).orderBy("day", "side")
    return makeups.join(real, ["person", "day", "side"], "left_semi").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_month).drop("_r")


def calendar(first, days: int, spark, off_days: DataFrame | None = None, extra_days: DataFrame | None = None) -> DataFrame:
    """Work days of a month: weekdays less ``off_days`` plus ``extra_days`` (day)."""
    d = spark.range(days).select(F.date_add(F.lit(first).cast("date"), F.col("id").cast("int")).alias("day")).where(F.weekday("day") < 5)
    if off_days is not None:
        d = d.join(off_days.select("day"), "day", "left_anti")
    return d if extra_days is None else d.union(extra_days.select("day")).distinct()


def calendar_edits(text: Column) -> Column:
    """``8/22 补班``-like edits: array of struct month, day, kind."""
    hits = F.regexp_extract_all(text, F.lit(r"\d{1,2}/\d{1,2}\s*(?:补班|休|放假|上班)"), F.lit(0))
    return F.transform(hits, lambda h: F.struct(F.regexp_extract(h, r"^(\d+)/", 1).cast("int").alias("month"), F.regexp_extract(h, r"/(\d+)", 1).cast("int").alias("day"), F.when(h.rlike("补班|上班"), "work").otherwise("off").alias("kind")))


def symbol_grid(grid: DataFrame) -> DataFrame:
    """person, side and one column per day of the month: the workbook's two rows per person."""
    return grid.groupBy("person", "side").pivot("day_no", list(range(1, 32))).agg(F.first("symbol")) if "day_no" in grid.columns else symbol_grid(grid.withColumn("day_no", F.dayofmonth("day")))
