"""Daily reports: where a sheet has its columns, who was on site on which day, and what about it looks wrong.

Input are sheet rows as they stand (path, row from 0, cells), from ``workbook.rows_of(files, as_is=True)`` or from ``pdf.grid``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headings, who is meant, how far headings are looked for, kinds of person.
DATE, SITE, OURS, NAME, STAGE = "日期", "现场施工人员", "我司人员", "姓名", "当前阶段"
NOBODY, HEADING_LIKE = ("公司人员", "外包人员", "无"), ("", "合计", "姓名")
HEAD_ROWS, HEAD_COLUMNS, STAGE_ROWS, STAGE_COLUMNS, FIRST_DATA = 15, 40, 7, 20, 7
FORMAL, CONTRACT = "internal_formal", "internal_contract"
WARNINGS = "path string, code string, row int, subject string"


def _cells(rows: DataFrame) -> DataFrame:
    """path, row, c, v of the cells that headings are looked for in."""
    head = rows.where(F.col("row") < HEAD_ROWS)
    return head.select("path", "row", F.posexplode(F.slice("cells", 1, HEAD_COLUMNS)).alias("c", "v")).withColumn("v", F.trim(F.coalesce("v", F.lit("")))).where("v != ''")


def columns(rows: DataFrame) -> DataFrame:
    """path, date, site (columns, null if there is none), ours (columns of our own people), stage, start (first row of data).

    The date is headed ``日期``, the site's people by a text with ``现场施工人员``; the first in reading order counts.  Our own people
    are under every text with ``我司人员``, and under a ``姓名`` up to three rows below and two columns right of one.
    Data starts under the lowest of these, or in the eighth row if what stands under the date still looks like a heading.
    """
    c = _cells(rows)
    at = F.struct("row", "c")
    ours = c.where(F.col("v").contains(OURS)).select("path", F.col("row").alias("_r"), F.col("c").alias("_c"))
    named = c.where(F.col("v") == NAME).join(ours, "path").where((F.col("_r").between(F.col("row") - 3, F.col("row"))) & F.col("_c").between(F.col("c") - 2, F.col("c")))
    both = ours.select("path", F.col("_r").alias("row"), F.col("_c").alias("c")).unionByName(named.select("path", "row", "c"))
    both = both.groupBy("path").agg(F.sort_array(F.collect_set("c")).alias("ours"), F.max("row").alias("_low"))
    one = c.groupBy("path").agg(F.min(F.when(F.col("v") == DATE, at)).alias("d"), F.min(F.when(F.col("v").contains(SITE), at)).alias("s"), F.max(F.when((F.col("v") == STAGE) & (F.col("row") < STAGE_ROWS) & (F.col("c") < STAGE_COLUMNS), F.col("c"))).alias("stage"))
    one = rows.select("path").distinct().join(one, "path", "left").join(both, "path", "left")
    low = F.greatest(F.coalesce("d.row", F.lit(0)), F.coalesce("s.row", F.lit(0)), F.coalesce("_low", F.lit(0)))
    one = one.select("path", F.col("d.c").alias("date"), F.col("s.c").alias("site"), F.coalesce("ours", F.array().cast("array<int>")).alias("ours"), "stage", (low + 1).alias("start"))
    probe = rows.select("path", F.col("row").alias("start"), F.col("cells").alias("_p"))
    one = one.join(probe, ["path", "start"], "left")
    like = F.coalesce(F.trim(F.get("_p", F.col("date"))), F.lit("")).isin(*HEADING_LIKE)
    return one.select("path", "date", "site", "ours", "stage", F.when(F.col("date").isNotNull() & (F.col("start") < FIRST_DATA) & like, FIRST_DATA).otherwise(F.col("start")).alias("start"))


def name_tokens(text: Column) -> Column:
    """Structs of name and doubtful: names of two to four Han characters, doubtful with a form of address at the end; and other short texts with Han characters, always doubtful."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\d+\s*人", " "), "[（(][^）)]*[）)]", " ")
    parts = F.transform(F.split(t, r"[、,，/；;|\s]+"), lambda p: F.regexp_replace(p, "^[ ，,。；;:：]+|[ ，,。；;:：]+$", ""))
    plain = lambda p: p.rlike("^[\\u4e00-\\u9fff]{2,4}$")
    doubt = lambda p: F.when(plain(p), p.endswith("工") & (F.length(p) >= 3)).when(p.rlike("[\\u4e00-\\u9fff]") & F.length(p).between(2, 6), True)
    told = F.transform(F.filter(parts, lambda p: (p != "") & ~p.isin(*NOBODY)), lambda p: F.struct(p.alias("name"), doubt(p).alias("doubtful")))
    return F.filter(told, lambda s: s["doubtful"].isNotNull())


def day_of(cell: Column) -> Column:
    """A date in one of three forms, with or without what follows; else null."""
    t = F.substring(F.trim(F.coalesce(cell, F.lit(""))), 1, 10)
    ok = t.rlike(r"^\d{4}([-/.])\d{1,2}\1\d{1,2}$")
    return F.when(ok, F.try_to_timestamp(F.translate(t, "/.", "--"), F.lit("y-M-d")).cast("date"))


def report(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(person-days, warnings) of daily reports.

    Person-days: path, work_date, person_name, person_kind, stage, source_row (from 1): each person once a day and kind; the kind is formal for names in the
    site text's ``【公司人员】`` part, contract for names in our own columns.  The day's stage is the first that is given, its row the first.
    Warnings (path, code, row, subject): unreadable_workbook, missing_date, ambiguous_person_token, source_mismatch, same_day_stage_conflict,
    same_day_conflict, name_kind_collision, suspected_name_split; the subject is the token, date, name or ``short/long`` concerned.
    Files without a date or site column have only the first; an empty table has neither.
    """
    cols = columns(rows)
    warn = lambda d, code, row, subject: d.select("path", F.lit(code).alias("code"), F.lit(row).cast("int").alias("row") if row is None else (F.col(row) + 1).cast("int").alias("row"), subject.cast("string").alias("subject"))
    none = F.lit(None)
    bad = cols.where("date is null or site is null")
    d = rows.join(cols.where("date is not null and site is not null"), "path").where(F.col("row") >= F.col("start"))
    cell = lambda at: F.trim(F.coalesce(F.get("cells", at), F.lit("")))
    text = cell(F.col("site"))
    formal = name_tokens(F.regexp_extract(text, "【公司人员】[：:](.*?)(?=【|$)", 1))
    contract = F.flatten(F.transform("ours", lambda c: name_tokens(F.get("cells", c))))
    d = d.select("path", "row", day_of(F.get("cells", F.col("date"))).alias("day"), text.alias("_site"), cell(F.get("ours", 0)).alias("_own"), F.when(F.col("stage").isNotNull(), F.nullif(cell(F.col("stage")), F.lit(""))).alias("stage"), formal.alias("formal"), contract.alias("contract"))
    lost = d.where((F.col("day").isNull()) & ((F.col("_site") != "") | (F.col("_own") != "")))
    d = d.where("day is not null")
    doubtful = d.select("path", "row", F.explode(F.concat("formal", "contract")).alias("t")).where("t.doubtful")
    names = lambda c: F.transform(c, lambda t: t["name"])
    apart = d.where((F.size("formal") > 0) & (F.size("contract") > 0) & ~F.arrays_overlap(names("formal"), names("contract")))
    by = Window.partitionBy("path", "day")
    d = d.withColumns({"_stage": F.first("stage", True).over(by.orderBy("row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "_first": F.min("row").over(by), "_n": F.count(F.lit(1)).over(by)})
    d = d.withColumn("_before", F.first("stage", True).over(by.orderBy("row").rowsBetween(Window.unboundedPreceding, -1)))
    clash = d.where(F.col("stage") != F.col("_before"))
    again = d.where("_n > 1 and row = _first")
    of_kind = lambda c, kind: F.transform(names(c), lambda n: F.struct(n.alias("name"), F.lit(kind).alias("kind")))
    kinds = [of_kind("formal", FORMAL), of_kind("contract", CONTRACT)]
    p = d.select("path", "day", "_stage", "_first", F.explode(F.concat(*kinds)).alias("p")).select("path", F.col("day").alias("work_date"), "p.*", "_stage", "_first").distinct()
    days = p.select("path", "work_date", F.col("name").alias("person_name"), F.col("kind").alias("person_kind"), F.col("_stage").alias("stage"), (F.col("_first") + 1).cast("int").alias("source_row"))
    people = p.groupBy("path", "name").agg(F.countDistinct("kind").alias("kinds"))
    cut = F.array(*(F.expr(f"case when length(name) > {n} + 1 then {e} end") for n in (1, 2) for e in (f"substring(name, 1, length(name) - {n})", f"substring(name, {n} + 1)")))
    split = people.select("path", F.col("name").alias("_long"), F.explode(F.array_distinct(cut)).alias("name")).join(people.select("path", "name"), ["path", "name"])
    parts = [
        warn(bad, "unreadable_workbook", None, none),
        warn(lost, "missing_date", "row", none),
        warn(doubtful, "ambiguous_person_token", "row", F.col("t.name")),
        warn(apart, "source_mismatch", "row", F.col("day")),
        warn(clash, "same_day_stage_conflict", "row", F.col("day")),
        warn(again, "same_day_conflict", None, F.col("day")),
        warn(people.where("kinds > 1"), "name_kind_collision", None, F.col("name")),
        warn(split, "suspected_name_split", None, F.concat_ws("/", "name", "_long")),
    ]
    warnings = parts[0]
    for part in parts[1:]:
        warnings = warnings.unionByName(part)
    return days, warnings
