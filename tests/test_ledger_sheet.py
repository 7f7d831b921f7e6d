"""The ledger's sheet: every list comes back as it went out; odd sheets."""

import math

from pyspark.sql import functions as F

from quarry.operators.ledger import LEAVE, OT_DAY, SEGMENT
from quarry.sources import ledger_sheet, workbook

SCHEMA = f"person_name string, center string, department string, travel_segments {SEGMENT}, ot_days {OT_DAY}, leave_segments {LEAVE}, total_comp_days double, used_comp_days double, remaining_comp_days double, remark string"
ROWS = [
    ("钱一", "c", "d", [("2024-01-01", "2024-02-10", "2024-01-01", "2024-02-09", 2.0), ("2024-03-01", "2024-03-05", "2024-03-01", "2024-03-05", 0.0)], [("2024-02-11", 1.0, True), ("2024-04-01", 0.5, False)], [("2024-05-01", "2024-05-02", 1.5)] * 3, 3.5, 4.5, -1.0, "note"),
    ("孙二", "c", "d", [], [], [], 0.0, 0.0, 0.0, ""),
    ("李三", "", "e", [], [("2024-02-11", 1.0, False)], [], 1.0, 0.0, 1.0, ""),
]


def _plain(r):
    return (r.person_name, r.center, r.department, [tuple(s) for s in r.travel_segments], [tuple(s) for s in r.ot_days], [tuple(s) for s in r.leave_segments], r.total_comp_days, r.used_comp_days, r.remaining_comp_days, r.remark)


def test_round_trip(spark):
    ledger = spark.createDataFrame(ROWS, SCHEMA)
    files = ledger_sheet.export(ledger, F.col("department"))
    back = ledger_sheet.imported(workbook.rows_of(files, as_is=True))
    assert sorted(map(_plain, back.collect())) == sorted(ROWS)
    assert {r.path for r in back.collect()} == {"d", "e"}
    assert back.where("travel_comp_days = 2 and ot_comp_days = 1.5").count() == 1
    assert ledger_sheet.imported(workbook.rows_of(files.limit(0), as_is=True)).collect() == []


def test_missing_totals_are_summed_and_odd_rows_left_out(spark):
    blank = [""] * 18
    row = lambda **at: [str(at.get(f"c{i}", "")) for i in range(18)]
    sheet = [*ledger_sheet.HEAD, row(c3="above any name"), row(c0="甲", c7="1,000.5", c9="2024-01-01(法定)", c10="1", c13="2024-02-02"), blank, row(c8="2024-01-03", c10="0"), row(c14="2"), row(c7="x")]
    rows = [("f", i, c) for i, c in enumerate(sheet)] + [("other", 0, ["姓名"]), ("other", 1, ["x"])]
    (r,) = ledger_sheet.imported(spark.createDataFrame(rows, "path string, row int, cells array<string>")).collect()
    assert [tuple(s) for s in r.travel_segments] == [("", "", "", "", 1000.5)] and [tuple(d) for d in r.ot_days] == [("2024-01-01", 1.0, True)]
    assert [tuple(x) for x in r.leave_segments] == [("", "2024-02-02", 0.0), ("", "", 2.0)]
    assert (r.total_comp_days, r.used_comp_days) == (1001.5, 2.0) and math.isclose(r.remaining_comp_days, 999.5)
