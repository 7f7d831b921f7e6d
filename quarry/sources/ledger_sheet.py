"""The leave ledger as the sheet that it is exported to, and back: rows of cells, from and for ``workbook``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ledger import LEAVE, OT_DAY, SEGMENT
from . import workbook

# The two header rows of the sheet, what an export is known by, the mark of a public holiday.
HEAD = [
    ["姓名", "中心", "部门", "出差日期（系统提报）", "", "出差日期（实际）", "", "可调休天数", "加班日期", "", "可调休天数", "合计可调休天数", "调休日期", "", "已休调休天数", "合计已休天数", "剩余调休天数", "备注"],
    ["", "", "", "起始日", "结束日", "起始日", "结束日", "", "加班日期（开始时间）", "加班日期（结束时间）", "", "", "起始日", "结束日", "", "", "", ""],
]
ANCHORS = ((0, 0, "姓名"), (0, 11, "合计可调休天数"), (0, 15, "合计已休天数"), (1, 8, "加班"))
HOLIDAY = "(法定)"
SHEET = "台账"
#: Ledger rows that a workbook holds at most.
PART_ROWS = 10_000


def _side_by_side(ledger: DataFrame) -> DataFrame:
    """The ledger with ``_z``: a person's trips, credited overtime days and leaves, zipped."""
    credited = F.filter("ot_days", lambda d: d["credit"] > 0)
    return ledger.withColumn("_z", F.arrays_zip(F.col("travel_segments").alias("t"), credited.alias("o"), F.col("leave_segments").alias("l")))


def sheet_rows(ledger: DataFrame, *more: str) -> DataFrame:
    """person_name, row, cells, and the columns ``more``: a person's trips, credited overtime days and leaves side by side, the names and totals on the first row."""
    d = _side_by_side(ledger)
    d = d.select("*", F.posexplode_outer("_z").alias("_pos", "z")).withColumn("row", F.coalesce("_pos", F.lit(0)))
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    once = lambda c: F.when(F.col("row") == 0, said(c)).otherwise("")
    day = F.when(F.col("z.o").isNotNull(), F.concat(F.regexp_replace("z.o.date", r"\(法定\)", ""), F.when(F.col("z.o.holiday"), HOLIDAY).otherwise(""))).otherwise("")
    cells = [*map(once, ("person_name", "center", "department")), *map(said, ("z.t.system_start", "z.t.system_end", "z.t.actual_start", "z.t.actual_end", "z.t.credit")), day, day, said("z.o.credit"), once("total_comp_days")]
    cells += [*map(said, ("z.l.start", "z.l.end", "z.l.used_days")), *map(once, ("used_comp_days", "remaining_comp_days", "remark"))]
    return d.select("person_name", "row", F.array(*cells).alias("cells"), *more)


def export(ledger: DataFrame, group: Column, most: int = PART_ROWS) -> DataFrame:
    """path, content: workbooks for each value of ``group`` (a center, say), its persons by name; of more than ``most`` rows, as many workbooks as they need.

    The sheet of the k-th workbook of a path has k behind its name.  A person may go on in the next one, whose first rows then have no name.
    """
    # where a person's rows begin among those of the group follows from the sizes of their lists
    by_name = Window.partitionBy("path").orderBy("person_name")
    d = _side_by_side(ledger).withColumn("_n", F.greatest(F.size("_z"), F.lit(1)).cast("long")).withColumn("path", group.cast("string"))
    d = d.withColumn("_before", F.coalesce(F.sum("_n").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_z")
    at = F.col("_before") + F.col("row")
    rows = sheet_rows(d, "path", "_before").select("path", F.floor(at / most).alias("part"), at.alias("at"), "cells")
    parts = int(ledger.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "path", "part").sortWithinPartitions("path", "part", "at")
    return rows.mapInArrow(_workbooks, "path string, content binary")


def _workbooks(batches: Iterator) -> Iterator:
    """A workbook for each path and part of rows in their order, one at a time."""
    import pyarrow as pa

    key, held = None, []

    def packed():
        name = SHEET if key[1] == 0 else f"{SHEET} {key[1] + 1}"
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([workbook.write_workbook({name: [*HEAD, *held]})], pa.binary())], names=["path", "content"])

    for b in batches:
        for path, part, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
            if key != (path, part):
                if held:
                    yield packed()
                key, held = (path, part), []
            held.append(cells)
    if held:
        yield packed()


def _anchored() -> list[Column]:
    """For each anchor: the row (row, cells) holds it."""
    holds = lambda r, c, t: (F.col("row") == r) & F.coalesce(F.trim(F.get("cells", F.lit(c))).contains(t) if r else F.trim(F.get("cells", F.lit(c))) == t, F.lit(False))
    return [holds(*a) for a in ANCHORS]


def looks_exported(rows: DataFrame) -> DataFrame:
    """The paths whose first two rows are those of an export."""
    found = rows.where("row < 2").groupBy("path").agg(*(F.max(h).alias(f"_{i}") for i, h in enumerate(_anchored())))
    return found.where(" and ".join(f"_{i}" for i in range(len(ANCHORS)))).select("path")


def imported(rows: DataFrame) -> DataFrame:
    """path, person_name, center, department, the three lists, their sums, totals and remark of every person of exported sheets (path, row, cells).

    A row with a name starts a person; rows without one go on with the last.  A row gives a trip if it has one of its dates or a credit, an
    overtime day if it has a date and a credit over 0, a leave if it has a date or days.  Totals are those of the first row, or else the sums of the lists.
    Rows above the first name, and files that are no exports, give nothing.  Of a path with several workbooks, told apart by the number behind their sheets'
    names, each goes on where the one before it ends.
    """
    part = F.when(F.col("sheet").rlike(f"^{SHEET} [0-9]{{1,9}}$"), F.substring_index("sheet", " ", -1).cast("int")).otherwise(1) if "sheet" in rows.columns else F.lit(1)
    v = lambda i: F.trim(F.coalesce(F.get("cells", F.lit(i)), F.lit("")))
    n = lambda i: F.replace(v(i), F.lit(",")).try_cast("double")
    # a workbook's rows stay together, and what it gives of its persons is joined to what the one before it gives
    down = Window.partitionBy("path", "part").orderBy("row")
    every = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = rows.select("path", part.alias("part"), "row", "cells")
    s = s.select("*", *(F.max(h).over(every).alias(f"_{i}") for i, h in enumerate(_anchored())), F.sum(((F.col("row") >= 2) & (v(0) != "")).cast("int")).over(down).alias("_block"))
    s = s.where("row >= 2 and " + " and ".join(f"_{i}" for i in range(len(ANCHORS)))).where("_block > 0 or part > 1")
    trip = F.when((F.concat(*map(v, range(3, 7))) != "") | n(7).isNotNull(), F.struct(v(3).alias("system_start"), v(4).alias("system_end"), v(5).alias("actual_start"), v(6).alias("actual_end"), F.coalesce(n(7), F.lit(0.0)).alias("credit")))
    day = F.trim(F.replace(F.when(v(8) != "", v(8)).otherwise(v(9)), F.lit(HOLIDAY)))
    extra = F.when((day != "") & (n(10) > 0), F.struct(day.alias("date"), n(10).alias("credit"), F.concat(v(8), v(9)).contains(HOLIDAY).alias("holiday")))
    leave = F.when((F.concat(v(12), v(13)) != "") | (F.coalesce(n(14), F.lit(0.0)) != 0), F.struct(v(12).alias("start"), v(13).alias("end"), F.coalesce(n(14), F.lit(0.0)).alias("used_days")))
    first = lambda c: F.min_by(c, "row")
    listed = lambda c, kind: F.transform(F.sort_array(F.filter(F.collect_list(F.struct("row", c.alias("x"))), lambda r: r["x"].isNotNull())), lambda r: r["x"]).cast(kind)
    p = s.groupBy("path", "part", "_block").agg(
        first(v(0)).alias("person_name"), first(v(1)).alias("center"), first(v(2)).alias("department"),
        listed(trip, SEGMENT).alias("travel_segments"), listed(extra, OT_DAY).alias("ot_days"), listed(leave, LEAVE).alias("leave_segments"),
        F.min_by(F.struct(n(11).alias("total"), n(15).alias("used"), n(16).alias("left"), v(17).alias("remark")), "row").alias("_t"),
    )
    p = p.withColumn("_person", F.sum((F.col("_block") > 0).cast("int")).over(Window.partitionBy("path").orderBy("part", "_block"))).where("_person > 0")
    lists = ("travel_segments", "ot_days", "leave_segments")
    onward = lambda c: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", c))), lambda x: x[c])).alias(c)
    p = p.groupBy("path", "_person").agg(*(F.min_by(c, "part").alias(c) for c in ("person_name", "center", "department")), *map(onward, lists), F.min_by("_t", "part").alias("_t"))
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda a, x: a + x[f])
    p = p.withColumns({"travel_comp_days": total("travel_segments", "credit"), "ot_comp_days": total("ot_days", "credit"), "_used": total("leave_segments", "used_days")})
    p = p.withColumns({"total_comp_days": F.coalesce("_t.total", F.col("travel_comp_days") + F.col("ot_comp_days")), "used_comp_days": F.coalesce("_t.used", "_used")})
    p = p.withColumns({"remaining_comp_days": F.coalesce("_t.left", F.col("total_comp_days") - F.col("used_comp_days")), "remark": F.col("_t.remark")})
    return p.drop("_t", "_used", "_person")
