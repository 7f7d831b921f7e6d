"""Exports of more rows than a workbook holds go on in further workbooks and come back whole; sheets as they stand have no end."""

from pyspark.sql import functions as F

from quarry.operators.ledger import LEAVE, OT_DAY, SEGMENT
from quarry.sources import ledger_sheet, workbook

SCHEMA = f"person_name string, center string, department string, travel_segments {SEGMENT}, ot_days {OT_DAY}, leave_segments {LEAVE}, total_comp_days double, used_comp_days double, remaining_comp_days double, remark string"


def _person(name, n, department="d"):
    return (name, "c", department, [], [(f"2024-01-{1 + i % 28:02} #{i}", 1.0, i % 2 == 0) for i in range(n)], [("2024-05-01", "2024-05-02", 1.5)] * (n // 2), float(n), 1.5 * (n // 2), 0.25, f"of {name}")


def test_persons_go_on_in_the_next_workbook(spark):
    people = [_person("a", 3), _person("b", 17), _person("c", 0), _person("d", 5), _person("e", 4), _person("f", 30), _person("g", 2, "other")]
    files = ledger_sheet.export(spark.createDataFrame(people, SCHEMA), F.col("department"), most=5)
    read = workbook.rows_of(files, as_is=True)
    assert read.groupBy("path", "sheet").count().agg(F.max("count")).first()[0] == 5 + 2
    assert {r.path: r.n for r in files.groupBy("path").agg(F.count("content").alias("n")).collect()} == {"d": 12, "other": 1}
    back = ledger_sheet.imported(read).collect()
    plain = lambda r: (r.person_name, r.center, r.department, [tuple(x) for x in r.travel_segments], [tuple(x) for x in r.ot_days], [tuple(x) for x in r.leave_segments], r.total_comp_days, r.used_comp_days, r.remaining_comp_days, r.remark)
    assert sorted(map(plain, back)) == sorted(people)


def test_ledgers_longer_than_the_table_readers_limit(spark):
    n = workbook.MAX_ROWS + 50
    data = workbook.write_workbook({ledger_sheet.SHEET: [*ledger_sheet.HEAD, ["n", "c", "d"], *([*[""] * 8, "2024-01-01", "", 1] for _ in range(n))]})
    assert sum(1 for _ in workbook.read_workbook(data, as_is=True)) == n + 3
    assert sum(1 for _ in workbook.read_workbook(data)) == workbook.MAX_ROWS
    ledger = spark.createDataFrame([_person("n", n)], SCHEMA)
    (back,) = ledger_sheet.imported(workbook.rows_of(ledger_sheet.export(ledger, F.col("department")), as_is=True)).collect()
    assert len(back.ot_days) == n and back.ot_comp_days == n
