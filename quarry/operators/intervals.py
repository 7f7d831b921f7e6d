"""Day-interval operators: runs of days, interval merging with tolerance, containment and overlap.

Range conditions are rewritten to equi-joins on exploded days, or carried through an
island id, so no plan compares every interval with every other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def days_between(start: Column, end: Column) -> Column:
    """Inclusive days from start to end; empty if they are reversed or null (``sequence`` alone would descend)."""
    return F.when(end >= start, F.sequence(start, end)).otherwise(F.array().cast("array<date>"))


def day_count(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def block_credit(days: Column, block: int = 30, credit: int = 2) -> Column:
    """Credit per full block of days."""
    return (F.floor(days / block) * credit).cast("double")


def day_runs(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Every distinct (keys, day) with ``run``: 1-based number of its stretch of consecutive days."""
    d = df.select(*keys, day).where(F.col(day).isNotNull()).distinct()
    w = Window.partitionBy(*keys).orderBy(day)
    opens = F.coalesce((F.datediff(F.col(day), F.lag(day).over(w)) > 1).cast("int"), F.lit(1))
    return d.withColumn("_opens", opens).withColumn("run", F.sum("_opens").over(w).cast("int")).drop("_opens")


def stints(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """keys, index, entry_date, exit_date, days: maximal runs of consecutive days."""
    runs = day_runs(df, keys, day)
    return runs.groupBy(*keys, F.col("run").alias("index")).agg(F.min(day).alias("entry_date"), F.max(day).alias("exit_date"), F.count(F.lit(1)).alias("days"))


def stage_counts(df: DataFrame, keys: list[str], stage: str) -> DataFrame:
    """Days per non-blank stage; one row of ``df`` per day."""
    label = F.trim(F.coalesce(F.col(stage), F.lit("")))
    return df.withColumn("_stage", label).where("_stage != ''").groupBy(*keys, F.col("_stage").alias("stage")).agg(F.count(F.lit(1)).alias("days"))


def stints_with_stages(df: DataFrame, keys: list[str], day: str, stage: str) -> DataFrame:
    """Stints with ``stage_label``: stages in name order, with their days where they don't fill the stint.

    ``df`` has one row per (keys, day).
    """
    runs = day_runs(df, keys, day)
    spans = runs.groupBy(*keys, "run").agg(F.min(day).alias("entry_date"), F.max(day).alias("exit_date"), F.count(F.lit(1)).alias("days"))
    staged = stage_counts(df.join(runs, [*keys, day]), [*keys, "run"], stage).withColumnRenamed("days", "stage_days")
    both = spans.join(staged, [*keys, "run"], "left")
    part = F.when(F.col("stage_days") == F.col("days"), F.col("stage")).otherwise(F.concat("stage", F.lit("("), F.col("stage_days").cast("string"), F.lit("天)")))
    grouped = both.groupBy(*keys, F.col("run").alias("index"), "entry_date", "exit_date", "days").agg(F.sort_array(F.collect_list(F.when(F.col("stage").isNotNull(), F.struct("stage", part.alias("text"))))).alias("_s"))
    return grouped.withColumn("stage_label", F.array_join(F.transform("_s", lambda s: s["text"]), "、")).drop("_s")


def stints_text(df: DataFrame, keys: list[str]) -> DataFrame:
    """``compact`` (``1: 01-11~01-13; …``) and ``summary`` text of all stints of a key."""
    one = df.select(*keys, "index", F.format_string("%d: %s~%s", "index", F.date_format("entry_date", "MM-dd"), F.date_format("exit_date", "MM-dd")).alias("c"), F.format_string("第%d次 %s入→%s出（%d天）", "index", F.col("entry_date").cast("string"), F.col("exit_date").cast("string"), "days").alias("s"))
    g = one.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("index", "c", "s"))).alias("_l"))
    return g.select(*keys, F.array_join(F.transform("_l", lambda x: x["c"]), "; ").alias("compact"), F.array_join(F.transform("_l", lambda x: x["s"]), "；").alias("summary"))


def islands(df: DataFrame, keys: list[str], start: str, end: str, gap_days: int = 0, name: str = "island") -> DataFrame:
    """``df`` with the number of the merged interval each row belongs to.

    An interval joins the island before it if it starts at most ``gap_days`` + 1 days after
    the greatest end so far: a running maximum, since an earlier interval may end last.
    """
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.datediff(F.col(start), reach) > gap_days + 1).cast("int"), F.lit(1))
    return df.withColumn("_opens", opens).withColumn(name, F.sum("_opens").over(w).cast("int")).drop("_opens")


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, gap_days: int = 0, extra: list[Column] | None = None) -> DataFrame:
    """keys, island, start, end, then ``extra`` aggregates over the merged rows (this replaces an overlap join)."""
    return islands(df, keys, start, end, gap_days).groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), *(extra or []))


def first_day_inside(spans: DataFrame, points: DataFrame, keys: list[str], span_id: str, start: str, end: str, day: str, condition: Column) -> DataFrame:
    """Per span the first day inside it on which a point of the same keys meets ``condition`` (null: none), and ``n_points``."""
    days = spans.select(span_id, *keys, F.explode(days_between(F.col(start), F.col(end))).alias(day))
    flagged = points.withColumn("_hit", condition).groupBy(*keys, day).agg(F.max("_hit").alias("_hit"), F.count(F.lit(1)).alias("_n"))
    return days.join(flagged, [*keys, day]).groupBy(span_id).agg(F.min(F.when(F.col("_hit"), F.col(day))).alias("first_day"), F.sum("_n").alias("n_points"))


def inside_any(points: DataFrame, spans: DataFrame, keys: list[str], day: str, start: str, end: str, how: str = "left_semi") -> DataFrame:
    """Points whose day lies in some span of the same keys (``left_anti``: in none)."""
    days = spans.select(*keys, F.explode(days_between(F.col(start), F.col(end))).alias(day)).distinct()
    return points.join(days, [*keys, day], how)
