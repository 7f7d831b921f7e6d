"""Daily reports: columns found under shuffled and merged headings, person-days, warnings; broken workbooks."""

import io
import zipfile

import pytest

from quarry.plans.pdfs import sheet, write_pdf
from quarry.sources import daily, pdf, workbook


def _report(spark, rows):
    files = spark.createDataFrame([("f", workbook.write_workbook({"s": rows}))], "path string, content binary")
    days, warnings = daily.report(workbook.rows_of(files, as_is=True))
    return sorted((str(r.work_date), r.person_name, r.person_kind, r.stage, r.source_row) for r in days.collect()), sorted((r.code, r.row, r.subject) for r in warnings.collect())


HEAD = [["项目日报"], [], ["当前阶段", "现场施工人员情况", "日期", "我司人员", ""], ["", "", "", "人数", "姓名"]]


def test_columns_rows_and_kinds(spark):
    rows = HEAD + [
        ["基础", "【公司人员】：张三、李四（组长）2人【外包人员】：王五", "2024-03-01", "", "张三，赵六"],
        ["", "【公司人员】:孙七", "2024/3/2 08:00", "", ""],
        ["主体", "外包 王五", "2024.3.3", "", "无"],
    ]
    days, warnings = _report(spark, rows)
    assert days == [
        ("2024-03-01", "张三", "internal_contract", "基础", 5),
        ("2024-03-01", "张三", "internal_formal", "基础", 5),
        ("2024-03-01", "李四", "internal_formal", "基础", 5),
        ("2024-03-01", "赵六", "internal_contract", "基础", 5),
    ]
    assert warnings == [("missing_date", 6, None), ("name_kind_collision", None, "张三")]  # 2024/3/2 and a time is cut at ten characters, which is no date


def test_warnings(spark):
    rows = HEAD + [
        ["", "【公司人员】：张三丰", "2024-03-05", "", "李工、王磊师傅"],
        ["主体", "【公司人员】：张三", "2024-03-05", "", ""],
        ["收尾", "", "2024-03-05", "", "陈大工"],
        ["收尾", "someone", "合计", "", ""],
        ["收尾", "", "", "", "only here"],
    ]
    days, warnings = _report(spark, rows)
    assert {d[1] for d in days} == {"张三丰", "张三", "李工", "王磊师傅", "陈大工"} and {d[3] for d in days} == {"主体"} and {d[4] for d in days} == {5}
    assert warnings == [
        ("ambiguous_person_token", 7, "陈大工"),
        ("missing_date", 8, None),
        ("same_day_conflict", None, "2024-03-05"),
        ("same_day_stage_conflict", 7, "2024-03-05"),
        ("source_mismatch", 5, "2024-03-05"),
        ("suspected_name_split", None, "张三/张三丰"),
    ]


def test_data_starts_in_the_eighth_row_where_headings_go_on(spark):
    rows = [["日期", "现场施工人员", "我司人员"], ["合计", "", "9"], *[["", "", ""]] * 5, ["2024-01-01", "", "钱一"]]
    assert _report(spark, rows)[0] == [("2024-01-01", "钱一", "internal_contract", None, 8)]
    assert _report(spark, [["日期", "other"], ["2024-01-01", "x"]]) == ([], [("unreadable_workbook", None, None)])
    assert _report(spark, [])[0] == []


def test_merged_headings_count_once(spark):
    data = workbook.write_workbook({"s": [["日期", "现场施工人员", "我司人员", ""], ["2024-01-01", "", "钱一", "泥工班"]]})
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w") as new:
        for n in z.namelist():
            new.writestr(n, z.read(n).replace(b"</sheetData>", b'</sheetData><mergeCells><mergeCell ref="C1:D1"/></mergeCells>'))
    files = spark.createDataFrame([("f", out.getvalue())], "path string, content binary")
    assert [r.person_name for r in daily.report(workbook.rows_of(files, as_is=True))[0].collect()] == ["钱一"]
    assert workbook.rows_of(files).first().cells == ["日期", "现场施工人员", "我司人员", "我司人员"]


def test_a_report_as_pdf_reads_as_its_workbook(spark):
    rows = [["日期", "现场施工人员", "我司人员"], ["2024-01-01", "【公司人员】：钱一", "钱一"], ["2024-01-02", "【公司人员】：钱二", "钱二"]]
    files = spark.createDataFrame([("p", write_pdf([sheet(rows, 60)]))], "path string, content binary")
    grid = pdf.grid(pdf.pages(files))
    days = daily.report(grid.withColumn("row", grid["row"] - 1))[0]
    assert sorted((str(r.work_date), r.person_name, r.person_kind) for r in days.collect()) == [(d, n, k) for d, n in (("2024-01-01", "钱一"), ("2024-01-02", "钱二")) for k in ("internal_contract", "internal_formal")]


@pytest.mark.parametrize("broken", [b"PK", b"PK\x03\x04nonsense", None, b"", b"x" * 100])
def test_broken_workbooks_give_no_rows(spark, broken):
    files = spark.createDataFrame([("f", broken)], "path string, content binary")
    assert workbook.rows_of(files).collect() == []
