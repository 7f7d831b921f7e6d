"""Helpers shared by the operators of this package."""

from __future__ import annotations

import gc
import math
import tempfile

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one bucket of a two-level running total or numbering holds on average.
ROWS_PER_BUCKET = 4096

#: The six ASCII blanks between words; every other character belongs to a word.
BLANKS = r"\x20\x09-\x0D"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quarry-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, write it to the shared checkpoint folder and read it from there: recovery never goes behind it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files and checkpoints that no DataFrame refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def byte_slices(batch, column: int, most: int = 8 << 20):
    """An Arrow batch in slices whose ``column`` (text or binary) holds about ``most`` bytes, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(first, last - first)
        first = last


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores added until no column of ``df`` has that name (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def text_of(df: DataFrame, text: str = "text") -> Column:
    """The text as a string, null as empty."""
    return F.coalesce(df[text].cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, out: str, rows: int, row_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add ``out``: the sum of ``value`` (long) over the rows of the same group before this one.

    The order inside a group is: bucket by hash of the first ``order`` column, then ``order``.  Buckets are summed
    first and their sums accumulated per group, so a group that holds a third of all
    rows is still spread over about ``rows / row_bucket / 3`` tasks.
    ``group`` and ``order`` columns must not be null in ``group``.
    """
    buckets = max(1, math.ceil(rows / row_bucket))
    d = df.withColumn("_bucket", F.pmod(F.xxhash64(order[0]), F.lit(buckets)))
    keys = [*group, "_bucket"]
    sums = d.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    base = sums.select(*keys, (F.sum("_sum").over(Window.partitionBy(*group).orderBy("_bucket")) - F.col("_sum")).alias("_base"))
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_inner", F.coalesce(F.sum(value).over(before), F.lit(0)))
    return d.join(base, keys).withColumn(out, (F.col("_base") + F.col("_inner")).cast("long")).drop("_bucket", "_base", "_inner")


def with_key(docs: DataFrame, id_col: str = "doc_id", name: str = "_key") -> DataFrame:
    """Add a unique long ``name`` that orders rows as ``id_col`` does (nulls first; ties in one fixed order).

    Unique, non-null whole numbers are used as they are.  Otherwise the rows are range
    partitioned by id, written to the checkpoint folder and numbered.
    """
    name = free_name(docs, name)
    ids = docs.select(docs[id_col].alias("i"))
    odd = ids.groupBy("i").count().where("i is null or count > 1").limit(1).count()
    if not odd and docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return docs.withColumn(name, docs[id_col].cast("long"))
    others = [docs[c] for c, kind in docs.dtypes if c != id_col and not kind.startswith(("map", "variant"))]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = free_name(docs, "_tie")
    placed = docs.withColumn(by, F.xxhash64(*others) if others else F.lit(0))
    placed = cut(placed.repartitionByRange(n, F.col(id_col).asc_nulls_first(), by).sortWithinPartitions(F.col(id_col).asc_nulls_first(), by))
    # the ids put the partition above the row within it: both follow the sorted order
    return placed.withColumn(name, F.monotonically_increasing_id()).drop(by)
