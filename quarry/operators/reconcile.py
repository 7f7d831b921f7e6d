"""Reconciliation of two grids: tallies and day symbols, exemptions, frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_COLUMN = "日格"
# fixed values: symbol variants
SYMBOLS = {"√": ["✓", "☑"], "￥": ["¥"], "＄": ["$"], "×": ["x", "X", "✕"], "★": ["*"]}


def symbol(value: Column) -> Column:
    """Trimmed, variants of a glyph unified, null as empty."""
    v = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    out = v
    for to, variants in SYMBOLS.items():
        out = F.when(v.isin(*variants), F.lit(to)).otherwise(out)
    return out


def number(value: Column) -> Column:
    """Blank as 0, thousands separators dropped, null if it is no number."""
    v = F.regexp_replace(F.trim(F.coalesce(value.cast("string"), F.lit(""))), ",", "")
    return F.when(v == "", F.lit(0.0)).otherwise(v.try_cast("double"))


def people_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """person and side: only_system, only_correct or both."""
    a, b = left.select("person").distinct(), right.select("person").distinct()
    tag = lambda d, s: d.select("person", F.lit(s).alias("side"))
    return tag(a.exceptAll(b), "only_system").unionByName(tag(b.exceptAll(a), "only_correct")).unionByName(tag(a.intersect(b), "both"))


def _matched(diffs: DataFrame, exemptions: DataFrame) -> DataFrame:
    """Reason of the first exemption (by seq) that covers a diff: a tally by its column or a blanket one; a day by its day, or by no days at all."""
    e = exemptions.select(F.col("person").alias("_p"), F.coalesce("columns", F.array().cast("array<string>")).alias("_c"), F.coalesce("days", F.array().cast("array<int>")).alias("_d"), "reason", F.col("seq").alias("_s"))
    c, d = F.size("_c") > 0, F.size("_d") > 0
    tally = (c & F.array_contains("_c", F.col("column"))) | (~c & ~d)
    on_day = F.when(d, F.array_contains("_d", F.col("day"))).otherwise(F.lit(True))
    hit = F.when(F.col("day").isNull(), tally).otherwise(on_day)
    j = diffs.join(e, diffs["person"] == e["_p"], "left").withColumn("_hit", F.coalesce(hit, F.lit(False)))
    keys = ["person", "kind", "column", "day", "system", "correct"]
    return j.groupBy(*keys).agg(F.min_by(F.when(F.col("_hit"), F.col("reason")), F.when(F.col("_hit"), F.col("_s"))).alias("exemption"))


def compare(sys_tally: DataFrame, cor_tally: DataFrame, sys_days: DataFrame, cor_days: DataFrame, exemptions: DataFrame) -> DataFrame:
    """person, kind (tally, day), column, day, system, correct, exemption of every difference among people on both sides.

    Tallies (person, label, value) differ by more than 1e-9, days (person, day, in_symbol,
    out_symbol) in either symbol; what one side lacks is 0 or blank.
    """
    people = sys_tally.select("person").union(sys_days.select("person")).distinct().intersect(cor_tally.select("person").union(cor_days.select("person")).distinct())
    a = sys_tally.select("person", F.col("label").alias("column"), F.col("value").alias("_a"))
    b = cor_tally.select("person", F.col("label").alias("column"), F.col("value").alias("_b"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    t = a.join(b, ["person", "column"], "full_outer").where(F.abs(zero("_a") - zero("_b")) >= 1e-9)
    t = t.select("person", F.lit("tally").alias("kind"), "column", F.lit(None).cast("int").alias("day"), zero("_a").cast("string").alias("system"), zero("_b").cast("string").alias("correct"))
    both = lambda d, n: d.select("person", "day", F.concat_ws("/", symbol(F.col("in_symbol")), symbol(F.col("out_symbol"))).alias(n))
    g = both(sys_days, "_a").join(both(cor_days, "_b"), ["person", "day"], "full_outer")
    blank = lambda c: F.coalesce(c, F.lit("/"))
    g = g.where(blank("_a") != blank("_b")).select("person", F.lit("day").alias("kind"), F.lit(DAY_COLUMN).alias("column"), "day", blank("_a").alias("system"), blank("_b").alias("correct"))
    return _matched(t.unionByName(g).join(people, "person", "left_semi"), exemptions)


def column_frequency(diffs: DataFrame) -> DataFrame:
    return diffs.where("exemption is null and kind = 'tally'").groupBy("column").agg(F.count(F.lit(1)).alias("n"))


def diff_summary(diffs: DataFrame) -> DataFrame:
    ex = F.col("exemption").isNotNull()
    return diffs.agg(F.sum((~ex).cast("long")).alias("non_exempt"), F.sum(ex.cast("long")).alias("exempt"), F.count_distinct(F.when(~ex, F.col("person"))).alias("people"))


def diff_sample(diffs: DataFrame, most: int = 30) -> DataFrame:
    return diffs.where("exemption is null").orderBy("person", "kind", "column", "day").limit(most)


def roster_changes(roster: DataFrame, hr: DataFrame) -> DataFrame:
    """person and change: new, left or transfer (center differs)."""
    a, b = roster.select("person", F.col("center").alias("_a")), hr.select("person", F.col("center").alias("_b"))
    j = a.join(b, "person", "full_outer")
    change = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "left").when(F.col("_a") != F.col("_b"), "transfer")
    return j.select("person", change.alias("change")).where("change is not null")


def orphans(roster: DataFrame, **sources: DataFrame) -> DataFrame:
    """code and person: names of each source that the roster lacks, and roster names without a punch."""
    out = None
    for name, s in sources.items():
        part = s.select("person").distinct().join(roster.select("person"), "person", "left_anti").select(F.lit(f"orphan_{name}").alias("code"), "person")
        out = part if out is None else out.unionByName(part)
    if "punch" in sources:
        out = out.unionByName(roster.select("person").distinct().join(sources["punch"].select("person"), "person", "left_anti").select(F.lit("roster_no_punch").alias("code"), "person"))
    return out


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
