"""PDF queries parse every file once, in many tasks, and hand pages on as they are read."""

import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from quarry import plans
from quarry.plans import pdfs
from quarry.sources import office, pdf


@pytest.fixture(scope="module")
def letters(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("letters"))
    spark.createDataFrame([(i, f"Customer#{i:03}", "BUILDING", i % 25) for i in range(1, 9)], "c_custkey long, c_name string, c_mktsegment string, c_nationkey int").coalesce(1).write.parquet(f"{d}/customer.parquet")
    return d


def _parses(df):
    return str(df._jdf.queryExecution().executedPlan().toString()).count("MapIn")


@pytest.mark.parametrize("name", ["pdf_blocks", "pdf_markdown", "pdf_page_texts"])
def test_files_are_parsed_once(spark, letters, name):
    q = plans.queries()[name](spark, letters)
    assert _parses(q) == 1
    assert {r.path for r in q.select("path").collect()} == {f"c{i}" for i in range(1, 9)}


def test_files_of_one_part_are_dealt_to_tasks(spark, letters):
    assert pdfs._letters(spark, letters).rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_grids_are_parsed_once(spark):
    files = spark.createDataFrame([("f", pdfs._report([1, 2], ["2024-01-01", "2024-01-02"], ["O", "F"]))], "path string, content binary")
    g = pdf.grid(pdf.pages(files))
    assert _parses(g) == 1 and g.count() == 4


def test_pages_are_handed_on_in_bounded_batches():
    data = pdfs._report(list(range(100)), ["2024-01-01"] * 100, ["O"] * 100)  # four pages
    files = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(600)]), pa.array([data] * 600)], names=["path", "content"])
    sizes = [b.num_rows for b in office._parsed(iter([files]), pdf.parse, to_arrow_schema(DataType.fromDDL(pdf.PAGES)))]
    assert sum(sizes) == 2400 and max(sizes) < office.HELD_ROWS + 4 and len(sizes) > 1
    assert not list(office._parsed(iter([files.slice(0, 0)]), pdf.parse, to_arrow_schema(DataType.fromDDL(pdf.PAGES))))
