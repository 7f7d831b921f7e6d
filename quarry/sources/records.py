"""Typed records from spreadsheet rows (path, sheet, sheet_no, row, cells), and parsing of their cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: words in file names and headers that tell a source's role
FILENAME_WORDS = {"travel": ["出差申请", "出差"], "overtime": ["加班申请", "加班"], "leave": ["请假申请", "请假"], "punch": ["打卡", "上下班"]}
HEADER_WORDS = {"travel": ["出差类别", "出差事由"], "overtime": ["加班明细", "加班时长", "加班事由"], "leave": ["假种", "请假类型", "请假时长"], "punch": ["打卡地址", "打卡时间", "地点"]}
DAY = r"\d{4}[/-]\d{1,2}[/-]\d{1,2}"
RANGE = rf"({DAY})\s*[-~～至到]\s*({DAY})"
OVERTIME_DAY = rf"({DAY})\s*(\d+(?:\.\d+)?)\s*小时"
FORMATS = ["y/M/d H:m:s", "y/M/d H:m", "y-M-d H:m:s", "y-M-d H:m", "y/M/d", "y-M-d"]
SENSIBLE = "[（(][^）)]*[）)]"


def parse_datetime(text: Column) -> Column:
    """A timestamp without zone from six formats, Chinese date marks, an Excel serial number, or a date inside other text."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[年月]", "/"), "日|上午|下午", ""))
    serial = F.when(t.rlike(r"^\d+(\.\d+)?$"), F.make_timestamp_ntz(F.lit(1899), F.lit(12), F.lit(30), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(secs=F.round(t.try_cast("double") * 86400, 0).cast("decimal(18,6)")))
    tries = [F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz") for f in FORMATS]
    inside = F.try_to_timestamp(F.translate(F.regexp_extract(t, DAY, 0), "-", "/"), F.lit("y/M/d")).cast("timestamp_ntz")
    return F.coalesce(serial, *tries, inside)


def parse_date(text: Column) -> Column:
    return parse_datetime(text).cast("date")


def parse_range(text: Column) -> tuple[Column, Column]:
    """Bounds of ``a 至 b``; a single date is both."""
    t = F.coalesce(text, F.lit(""))
    has = t.rlike(RANGE)
    one = parse_date(t)
    return F.when(has, parse_date(F.regexp_extract(t, RANGE, 1))).otherwise(one), F.when(has, parse_date(F.regexp_extract(t, RANGE, 2))).otherwise(one)


def overtime_days(rows: DataFrame, detail: str, start: str, duration: str) -> DataFrame:
    """One row per ``date N小时`` of the detail; else one of the start date with the hours of the duration text."""
    hits = F.regexp_extract_all(F.coalesce(F.col(detail), F.lit("")), F.lit(OVERTIME_DAY), F.lit(0))
    some = F.transform(hits, lambda h: F.struct(parse_date(F.regexp_extract(h, OVERTIME_DAY, 1)).alias("work_date"), F.regexp_extract(h, OVERTIME_DAY, 2).cast("double").alias("hours")))
    said = F.regexp_extract(F.coalesce(F.col(duration), F.lit("")), r"(\d+(?:\.\d+)?)\s*小时", 1)
    alone = F.array(F.struct(parse_date(F.col(start)).alias("work_date"), F.when(said != "", said.cast("double")).otherwise(F.lit(0.0)).alias("hours")))
    return rows.withColumn("_d", F.explode(F.when(F.size(hits) > 0, some).otherwise(alone))).where("_d.work_date is not null").select(*rows.columns, "_d.work_date", "_d.hours")


def widest_sheet(rows: DataFrame) -> DataFrame:
    """Rows of each file's sheet with the most rows that hold anything (the first of equals)."""
    n = rows.where(F.exists("cells", lambda c: F.trim(c) != "")).groupBy("path", "sheet_no").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("path").agg(F.max_by("sheet_no", F.struct("n", -F.col("sheet_no"))).alias("sheet_no"))
    return rows.join(best, ["path", "sheet_no"], "left_semi")


def header_positions(rows: DataFrame, required: list[str], first: int = 15) -> DataFrame:
    """path, header_row and a map of the required names to columns: the first of ``first`` rows that has them exactly or as parts."""
    trimmed = F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))))
    d = rows.where(F.col("row") < first).withColumn("_c", trimmed)
    exact = [F.array_position("_c", F.lit(r)).cast("int") - 1 for r in required]

    def soft(name):
        return F.coalesce(F.get(F.filter(F.transform("_c", lambda c, i: F.when(c.contains(name), i)), lambda i: i.isNotNull()), F.lit(0)), F.lit(-1))

    d = d.withColumn("_e", F.array(*exact)).withColumn("_s", F.array(*(soft(r) for r in required)))
    whole = lambda c: F.forall(c, lambda i: i >= 0)
    d = d.withColumn("_at", F.when(whole("_e"), F.col("_e")).when(whole("_s"), F.col("_s"))).where("_at is not null")
    found = d.groupBy("path").agg(F.min("row").alias("header_row"), F.min_by("_at", "row").alias("_at"))
    return found.select("path", "header_row", F.map_from_arrays(F.array(*map(F.lit, required)), "_at").alias("at"))


def named_cells(rows: DataFrame, *layouts: dict[str, str], optional: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Data rows below the header: path, seq, layout and one column per name of any layout.

    A layout maps header names to columns; of those whose header is found in a file the
    first counts.  ``optional`` maps further columns to words, one of which their header
    cell holds.  What a file lacks is an empty string.
    """
    w, optional, found = widest_sheet(rows), optional or {}, None
    wanted = list(dict.fromkeys(c for x in layouts for c in x.values()))
    for i, layout in enumerate(layouts):
        at = F.map_from_arrays(F.array(*map(F.lit, layout.values())), F.array(*(F.col("at")[n] for n in layout)))
        part = header_positions(w, list(layout)).select("path", "header_row", at.alias("at"), F.lit(i).alias("layout"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("path").agg(F.min_by(F.struct("header_row", "at"), "layout").alias("h"), F.min("layout").alias("layout")).select("path", "h.header_row", "h.at", "layout")
    heads = w.select("path", "row", "cells").join(best, "path").where(F.col("row") == F.col("header_row"))
    place = lambda words: F.get(F.filter(F.transform("cells", lambda c, i: F.when(_has_any(F.coalesce(c, F.lit("")), words), i)), lambda i: i.isNotNull()), F.lit(0))
    heads = heads.select("path", "header_row", "at", "layout", *(place(v).alias(f"_at_{c}") for c, v in optional.items()))
    d = w.join(heads, "path").where(F.col("row") > F.col("header_row"))
    cell = lambda at: F.trim(F.coalesce(F.get("cells", at), F.lit("")))
    return d.select("path", F.col("row").alias("seq"), "layout", *(cell(F.col("at")[c]).alias(c) for c in wanted), *(cell(F.col(f"_at_{c}")).alias(c) for c in optional))


_WHO = {"申请人": "applicant", "申请人部门": "department", "当前审批状态": "status"}
_SPAN = {"开始时间": "_s", "结束时间": "_e"}


def _center() -> Column:
    return F.split("department", "/")[0].alias("center")


def travel_records(rows: DataFrame) -> DataFrame:
    """Trips of approval sheets; the approval's number is empty where the sheet has none."""
    r = named_cells(rows, {**_WHO, "出差类别": "category", **_SPAN}, optional={"approval_id": ("审批编号",)}).where("applicant != ''")
    return r.select("path", "seq", "applicant", "department", _center(), "category", parse_date(F.col("_s")).alias("start"), parse_date(F.col("_e")).alias("end"), "status", "approval_id")


def overtime_records(rows: DataFrame) -> DataFrame:
    """One row per day of overtime; sheets may lack the columns of duration, reason and number."""
    more = {"_h": ("加班时长",), "reason": ("加班事由",), "approval_id": ("审批编号",)}
    r = named_cells(rows, {**_WHO, **_SPAN, "加班明细": "_detail"}, optional=more).where("applicant != ''")
    return overtime_days(r, "_detail", "_s", "_h").select("path", "seq", "applicant", "department", _center(), "work_date", "hours", "status", "reason", "approval_id")


def leave_records(rows: DataFrame) -> DataFrame:
    """Leave of sheets with start and end columns, or with one column for both."""
    kinds = ({**_WHO, "假种": "leave_kind"}, {**_WHO, "请假类型": "leave_kind"})
    more = {"_r": ("请假时间", "休假时间", "起止"), "duration_text": ("请假时长", "时长"), "approval_id": ("审批编号",)}
    r = named_cells(rows, *({**k, **_SPAN} for k in kinds), *kinds, optional=more).where("applicant != ''")
    a, b = parse_range(F.col("_r"))
    own = F.col("layout") < len(kinds)
    start, end = (F.when(own, parse_date(F.col(c))).otherwise(x) for c, x in (("_s", a), ("_e", b)))
    return r.select("path", "seq", "applicant", "department", _center(), "leave_kind", start.alias("start"), end.alias("end"), "duration_text", "status", "approval_id")


def punch_records(rows: DataFrame) -> DataFrame:
    """Punches of sheets with headers (three forms), else of sheets with the fixed columns date, name, time, state, address.

    ``--`` is no time; a time alone is joined with the row's date.
    """
    layouts = [{"日期": "_d", "姓名": "person_name", t: "_t", p: "address"} for t, p in (("时间", "地点"), ("打卡时间", "打卡地址"), ("时间", "打卡地址"))]
    named = named_cells(rows, *layouts, optional={"status": ("状态",)}).drop("layout")
    plain = widest_sheet(rows).join(named.select("path").distinct(), "path", "left_anti")
    cell = lambda i: F.trim(F.coalesce(F.get("cells", F.lit(i)), F.lit("")))
    address = F.when(cell(4) == "--", "").otherwise(cell(4))
    plain = plain.select("path", F.col("row").alias("seq"), F.split(cell(0), r"\s")[0].alias("_d"), cell(1).alias("person_name"), cell(2).alias("_t"), cell(3).alias("status"), address.alias("address"))
    r = named.unionByName(plain)
    day = parse_date(F.col("_d"))
    only = F.regexp_extract("_t", r"^\d{1,2}:\d{2}(?::\d{2})?$", 0)
    at = F.when(only != "", parse_datetime(F.concat(day.cast("string"), F.lit(" "), only))).when(F.col("_t") != "--", parse_datetime(F.col("_t")))
    return r.select("path", "seq", "person_name", day.alias("work_date"), at.alias("punch_time"), "status", "address").where("person_name != '' and work_date is not null")


def role_by_name(name: Column) -> Column:
    """The only role whose words the file name holds; among several the most specific; else null."""
    hits = {r: _has_any(name, ws) for r, ws in FILENAME_WORDS.items()}
    n = sum((h.cast("int") for h in hits.values()), F.lit(0))
    one = F.lit(None).cast("string")
    for r, h in hits.items():
        one = F.when(h, F.lit(r)).otherwise(one)
    ot, tr = name.contains("加班"), name.contains("出差")
    return F.when(n == 1, one).when(ot & ~tr, "overtime").when(tr & ~ot, "travel").when(name.contains("请假"), "leave").when(name.contains("打卡"), "punch")


def _has_any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def role_by_headers(headers: Column) -> Column:
    """The role with the most header words found; null on a tie."""
    score = {r: sum((F.exists(headers, lambda h: h.contains(w)).cast("int") for w in ws), F.lit(0)) for r, ws in HEADER_WORDS.items()}
    best = F.greatest(*score.values())
    ties = sum(((s == best).cast("int") for s in score.values()), F.lit(0))
    out = F.lit(None).cast("string")
    for r, s in score.items():
        out = F.when(s == best, F.lit(r)).otherwise(out)
    return F.when((best > 0) & (ties == 1), out)


def holiday_lines(lines: DataFrame) -> DataFrame:
    """Days of a text file, one per line; blanks and ``#`` comments are skipped.  A missing file is None at the caller's, not an empty table."""
    t = F.trim(F.regexp_replace("value", "#.*$", ""))
    return lines.select(F.to_date(F.regexp_extract(t, r"^\d{4}-\d{2}-\d{2}", 0).try_cast("date")).alias("day")).where("day is not null").distinct()


def roster_rows(rows: DataFrame) -> DataFrame:
    """One row per name, one that has not left before one that has."""
    w = Window.partitionBy("name").orderBy("left", "seq")
    return rows.where("name != ''").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def filled_persons(rows: DataFrame) -> DataFrame:
    """Rows (path, row, person, …) of a re-imported export with blank persons filled from above, per file."""
    w = Window.partitionBy("path").orderBy("row")
    return rows.withColumn("person", F.last(F.when(F.coalesce("person", F.lit("")) != "", F.col("person")), ignorenulls=True).over(w))


def looks_like_export(cells: Column, anchors: list[str]) -> Column:
    """All anchor headings stand in the row."""
    return F.forall(F.array(*map(F.lit, anchors)), lambda a: F.array_contains(cells, a))


def infer_header(first: Column, second: Column, width: Column, prefix: str = "列") -> Column:
    """Struct header (array) and is_header from a sheet's first two rows."""
    filled = F.filter(first, lambda c: F.trim(c) != "")
    below = F.filter(F.coalesce(second, F.array().cast("array<string>")), lambda c: F.trim(c) != "")
    textual = lambda c: F.trim(c).try_cast("double").isNull()
    mean = lambda a: F.aggregate(a, F.lit(0), lambda s, c: s + F.length(c)) / F.greatest(F.size(a), F.lit(1))
    labels = (F.size(filled) >= 2) & F.forall(filled, lambda c: (F.length(c) <= 40) & textual(c)) & (F.size(F.array_distinct(filled)) == F.size(filled))
    ok = labels & ((F.size(below) == 0) | F.exists(below, lambda c: ~textual(c)) | (F.size(below) != F.size(filled)) | (~F.exists(filled, lambda c: c.rlike(r"\d")) & (mean(filled) <= mean(below))))
    generic = F.transform(F.sequence(F.lit(1), width), lambda i: F.concat(F.lit(prefix), i.cast("string")))
    named = F.transform(generic, lambda g, i: F.when(F.trim(F.coalesce(F.get(first, i), F.lit(""))) != "", F.trim(F.get(first, i))).otherwise(g))
    return F.struct(F.when(ok, named).otherwise(generic).alias("header"), ok.alias("is_header"))


def prune_columns(header: Column, rows: Column) -> Column:
    """Positions of columns with a name or any value."""
    at = F.transform(header, lambda h, i: F.when((F.trim(h) != "") | F.exists(rows, lambda r: F.trim(F.coalesce(F.get(r, i), F.lit(""))) != ""), i))
    return F.filter(at, lambda i: i.isNotNull())


def dominant_font(spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Font size with the most characters per document (spans: doc, size, text)."""
    n = spans.groupBy(doc, "size").agg(F.sum(F.length("text")).alias("n"))
    return n.groupBy(doc).agg(F.max_by("size", F.struct("n", "size")).alias("size"))


def project_codes(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<!\d)\d{3,6}(?!\d)"), F.lit(0)))


def person_names(text: Column) -> Column:
    """Han names of two to four characters: counts and brackets dropped, split at separators, first occurrences."""
    t = F.regexp_replace(F.regexp_replace(text, r"\d+\s*人", " "), SENSIBLE, " ")
    return F.array_distinct(F.filter(F.split(t, r"[、，,;；\s]+"), lambda p: p.rlike(r"^\p{IsHan}{2,4}$") & ~p.isin("公司人员", "外包人员")))


def labelled_block(text: Column, label: str, next_label: str) -> Column:
    return F.trim(F.regexp_extract(F.replace(text, F.lit("\n"), F.lit(" ")), rf"【{label}】(.*?)(?:【{next_label}】|$)", 1))


def match_score(text: Column, filename: Column, words: str, name_words: str, file_pattern: str) -> Column:
    """strong: the right kind of file and a word in text or name; weak: either alone; else none."""
    t, n = F.coalesce(text, F.lit("")), F.coalesce(filename, F.lit(""))
    f, w, k = n.rlike(file_pattern), t.rlike(words), n.rlike(name_words)
    return F.when(f & (w | k), "strong").when(f | w, "weak").otherwise("none")


def best_tool(scores: dict[str, Column]) -> Column:
    """The tool with the only best score; ``clarify`` on a tie; null if none scores."""
    rank = lambda c: F.when(c == "strong", 2).when(c == "weak", 1).otherwise(0)
    ranks = {t: rank(c) for t, c in scores.items()}
    top = F.greatest(*ranks.values())
    ties = sum(((r == top).cast("int") for r in ranks.values()), F.lit(0))
    out = F.lit(None).cast("string")
    for t, r in ranks.items():
        out = F.when(r == top, F.lit(t)).otherwise(out)
    return F.when(top == 0, F.lit(None)).when(ties > 1, "clarify").otherwise(out)


def find_json(text: Column, names: list[str]) -> Column:
    """The first of several paths that a tolerant JSON answer has."""
    return F.coalesce(*(F.get_json_object(text, f"$.{n}") for n in names))
