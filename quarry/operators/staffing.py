"""Person-day facts: import checks, name resolution, supersede and void, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import stints

FORMAL, CONTRACT = "internal_formal", "internal_contract"
#: Characters that a roster name may add before or after a token.
MAX_NAME_DELTA = 2
MAX_CANDIDATES = 5
KEY = ["work_date", "person_name", "person_kind"]


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the first in source order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def dedupe_by_hash(assets: DataFrame, content: str, order: str) -> DataFrame:
    return keep_first(assets.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256)), ["sha256"], order)


def supersede(facts: DataFrame, batch: DataFrame, project: str, voided_by: str = "system") -> DataFrame:
    """Facts after a confirmed batch: active ones of the same project and date are voided, the batch's first row per key is added."""
    new = keep_first(batch, KEY, "seq").withColumns({"project_id": F.lit(project), "status": F.lit("active"), "void_reason": F.lit(None).cast("string")})
    dates = batch.select("work_date").distinct().withColumn("_hit", F.lit(True))
    old = facts.join(dates, "work_date", "left")
    gone = F.col("_hit") & (F.col("project_id") == project) & (F.col("status") == "active")
    old = old.withColumn("void_reason", F.when(gone, "superseded").otherwise(F.col("void_reason"))).withColumn("status", F.when(gone, "voided").otherwise(F.col("status"))).drop("_hit")
    return old.unionByName(new.select(*old.columns))


def void(facts: DataFrame, scope: str, dates: list | None = None, persons: list[str] | None = None, batches: list[str] | None = None, reason: str = "manual") -> DataFrame:
    """Soft-void active facts of a scope: person, batch, day or day_person."""
    by = {"person": lambda: F.col("person_name").isin(*persons), "batch": lambda: F.col("batch_id").isin(*batches), "day": lambda: F.col("work_date").isin(*dates), "day_person": lambda: F.col("work_date").isin(*dates) & F.col("person_name").isin(*persons)}
    hit = by[scope]() & (F.col("status") == "active")
    return facts.withColumn("void_reason", F.when(hit, reason).otherwise(F.col("void_reason"))).withColumn("status", F.when(hit, "voided").otherwise(F.col("status")))


def listed(facts: DataFrame, include_voided: bool = False) -> DataFrame:
    f = facts if include_voided else facts.where("status = 'active'")
    return f.orderBy("work_date", "person_name")


def person_summary(facts: DataFrame) -> DataFrame:
    """Per person and kind: distinct days, first and last day, stints, stages in order, days per stage of the day's first non-blank stage."""
    f = facts.where("status = 'active'")
    label = F.trim(F.coalesce("stage", F.lit("")))
    day = f.groupBy("person_name", "person_kind", "work_date").agg(F.min_by(F.when(label != "", label), F.when(label != "", F.col("seq"))).alias("stage"))
    runs = stints(day, ["person_name", "person_kind"], "work_date").groupBy("person_name", "person_kind").agg(F.count(F.lit(1)).alias("stints"))
    out = day.groupBy("person_name", "person_kind").agg(F.count(F.lit(1)).alias("days"), F.min("work_date").alias("first_day"), F.max("work_date").alias("last_day"), F.sort_array(F.collect_set("stage")).alias("stages"))
    return out.join(runs, ["person_name", "person_kind"])


def kind_rollup(facts: DataFrame) -> DataFrame:
    """Persons and person-days per kind, and in all (kind null)."""
    f = facts.where("status = 'active'").select("person_name", "person_kind", "work_date").distinct()
    return f.rollup("person_kind").agg(F.count_distinct("person_name").alias("persons"), F.count(F.lit(1)).alias("person_days"), F.min("work_date").alias("first_day"), F.max("work_date").alias("last_day"))


def kind_order(kind: Column) -> Column:
    return F.when(kind == FORMAL, 0).when(kind == CONTRACT, 1).otherwise(2)


def department_title(facts: DataFrame, roster: DataFrame, contract_department: str = "") -> DataFrame:
    """Roster's department and title by name; else ``contract_department`` for the contract kind."""
    r = keep_first(roster.withColumn("_o", F.struct(F.col("left"), F.col("seq"))), ["name"], "_o").select(F.col("name").alias("_n"), F.coalesce("department", F.lit("")).alias("_d"), F.coalesce("title", F.lit("")).alias("_t"))
    j = facts.join(r, F.trim("person_name") == F.col("_n"), "left")
    fall = F.when(F.col("person_kind") == CONTRACT, contract_department).otherwise("")
    return j.withColumn("department", F.coalesce("_d", fall)).withColumn("title", F.coalesce("_t", F.lit(""))).drop("_n", "_d", "_t")


def _extensions(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """(token, name) where name is token with 1 to MAX_NAME_DELTA characters before or after: an equi-join on the names' cut forms."""
    cutters = [F.expr(f"substring(name, 1, length(name) - {k})") for k in range(1, MAX_NAME_DELTA + 1)] + [F.expr(f"substring(name, {k + 1})") for k in range(1, MAX_NAME_DELTA + 1)]
    forms = names.select("name", F.explode(F.array_distinct(F.array(*cutters))).alias("token")).where("token != ''")
    return tokens.join(forms, "token").distinct()


def name_split_pairs(names: DataFrame) -> DataFrame:
    """(short, long) names of which one extends the other by 1 or 2 characters at an end."""
    return _extensions(names.select(F.col("name").alias("token")).distinct(), names.select("name").distinct()).select(F.col("token").alias("short"), F.col("name").alias("long"))


def classify_names(tokens: DataFrame, roster: DataFrame) -> DataFrame:
    """token, status (exact, auto, unresolved, unavailable), to_name, candidates (at most MAX_CANDIDATES, in name order)."""
    t = tokens.select(F.trim("token").alias("token")).distinct()
    names = roster.select("name").distinct()
    if names.isEmpty():
        return t.select("token", F.lit("unavailable").alias("status"), F.lit(None).cast("string").alias("to_name"), F.array().cast("array<string>").alias("candidates"))
    found = _extensions(t, names).groupBy("token").agg(F.sort_array(F.collect_set("name")).alias("c"))
    j = t.join(names.select(F.col("name").alias("token"), F.lit(True).alias("_e")), "token", "left").join(found, "token", "left")
    exact = F.col("_e").isNotNull() | (F.col("token") == "")
    n = F.coalesce(F.size("c"), F.lit(0))
    status = F.when(exact, "exact").when(n == 1, "auto").otherwise("unresolved")
    none = F.array().cast("array<string>")
    return j.select("token", status.alias("status"), F.when(exact, F.col("token")).when(n == 1, F.col("c")[0]).alias("to_name"), F.when(exact, none).otherwise(F.slice(F.coalesce("c", none), 1, MAX_CANDIDATES)).alias("candidates"))


def correct_names(rows: DataFrame, roster: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with unique extensions rewritten, and a warning row (code, token, to_name, candidates) per other token."""
    c = classify_names(rows.select(F.col("person_name").alias("token")), roster)
    auto = c.where("status = 'auto'").select(F.col("token").alias("_t"), "to_name")
    out = rows.join(auto, F.trim("person_name") == F.col("_t"), "left").withColumn("person_name", F.coalesce("to_name", "person_name")).select(*rows.columns)
    code = F.when(F.col("status") == "auto", "roster_name_corrected").when(F.col("status") == "unavailable", "roster_unavailable").otherwise("roster_name_unresolved")
    return out, c.where("status != 'exact'").select(code.alias("code"), "token", "to_name", "candidates")


def match_projects(codes: DataFrame, projects: DataFrame) -> DataFrame:
    """codes (doc, code) against project codes, either being a prefix of the other: doc, status, project_id, n.

    Prefixes of both sides are exploded and meet by equality.  Equal codes are matched once: a project of one code counts as one of those that
    share it, so that neither side of a join has a row per project.  Only projects of several codes, and docs of several codes, are met one by one.
    """
    prefixes = lambda c, most: F.transform(F.sequence(F.lit(1), most), lambda i: F.substring(F.col(c), F.lit(1), i))
    whole = codes.where("code != ''")
    c = whole.select("code").distinct()
    p = projects.select(F.col("id").alias("project_id"), F.col("code").alias("pcode")).where("pcode != ''")
    found = [F.count(F.lit(1)).alias("n"), F.min("project_id").alias("p")]
    added = [F.sum("n").alias("n"), F.min("p").alias("p")]

    def met(projects, *cols):
        """code, pcode and the columns ``cols`` of projects: those that start with the code, and those that are shorter than it and start it."""
        wide = projects.select(F.explode(prefixes("pcode", F.length("pcode"))).alias("code"), *cols)
        tail = c.where("length(code) > 1").select("code", F.explode(prefixes("code", F.length("code") - 1)).alias("pcode"))
        return c.hint("merge").join(wide, "code").select("code", *cols).unionByName(tail.hint("merge").join(projects, "pcode").select("code", *cols))

    per_id = p.groupBy("project_id").agg(F.min("pcode").alias("pcode"), F.max("pcode").alias("_last"))
    shared = per_id.where(F.col("pcode") == F.col("_last")).groupBy("pcode").agg(*found)
    mixed = p.join(per_id.where(F.col("pcode") != F.col("_last")).select(F.col("project_id").alias("_id")), F.col("project_id").eqNullSafe(F.col("_id")), "left_semi").distinct()
    hits = met(shared, "n", "p").unionByName(met(mixed, "project_id").distinct().select("code", F.lit(1).cast("long").alias("n"), F.col("project_id").alias("p"))).groupBy("code").agg(*added)
    # a doc of one code has its code's hits; only docs of several codes are met with projects one by one
    per = whole.groupBy("doc").agg(F.min("code").alias("code"), F.max("code").alias("_last"))
    one = per.where(F.col("code") == F.col("_last")).join(hits, "code").select("doc", "n", "p")
    many = whole.join(per.where(F.col("code") != F.col("_last")).select(F.col("doc").alias("_doc")), F.col("doc") == F.col("_doc"), "left_semi").distinct()
    several = many.join(met(p, "project_id").distinct(), "code").select("doc", "project_id").distinct().groupBy("doc").agg(*found)
    out = codes.select("doc").distinct().join(one.unionByName(several), "doc", "left")
    status = F.when(F.col("n") == 1, "matched").when(F.col("n") > 1, "ambiguous").otherwise("unmatched")
    return out.select("doc", status.alias("status"), F.when(F.col("n") == 1, F.col("p")).alias("project_id"), F.coalesce("n", F.lit(0)).alias("n"))


def apply_resolutions(rows: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Review decisions by name (token, action, keep_kind, name): keep one kind, discard, rename."""
    r = resolutions.select(F.col("token").alias("person_name"), "action", "keep_kind", F.col("name").alias("_to"))
    j = rows.join(r, "person_name", "left")
    keep = F.coalesce((F.col("action") != "discard") & ((F.col("action") != "keep_kind") | (F.col("keep_kind") == F.col("person_kind"))), F.lit(True))
    return j.where(keep).withColumn("person_name", F.when(F.col("action").isin("rename", "select_roster_name", "merge"), F.coalesce("_to", "person_name")).otherwise(F.col("person_name"))).select(*rows.columns)


def rename_person(facts: DataFrame, old: str, new: str) -> DataFrame:
    """Rename, or void where the new name already has an active fact of the same project, date and kind."""
    k = ["project_id", "work_date", "person_kind"]
    have = facts.where((F.col("person_name") == new) & (F.col("status") == "active")).select(*k).distinct().withColumn("_have", F.lit(True))
    j = facts.join(have, k, "left")
    hit = (F.col("person_name") == old) & (F.col("status") == "active")
    dup = hit & F.coalesce("_have", F.lit(False))
    return j.withColumn("void_reason", F.when(dup, "merged").otherwise(F.col("void_reason"))).withColumn("status", F.when(dup, "voided").otherwise(F.col("status"))).withColumn("person_name", F.when(hit & ~dup, new).otherwise(F.col("person_name"))).select(*facts.columns)


def kind_collisions(rows: DataFrame) -> DataFrame:
    """Names with both kinds on one day."""
    return rows.groupBy("work_date", "person_name").agg(F.count_distinct("person_kind").alias("kinds")).where("kinds = 2").select("work_date", "person_name")


def repeated_rows(rows: DataFrame) -> DataFrame:
    """Person-days from several source rows, and whether their stages differ."""
    g = rows.groupBy(*KEY).agg(F.count_distinct("source_row").alias("rows"), F.count_distinct("stage").alias("stages"))
    return g.where("rows > 1 or stages > 1").select(*KEY, "rows", (F.col("stages") > 1).alias("stage_conflict"))


def sources_overlap(rows: DataFrame) -> DataFrame:
    """Days on which the formal and the contract list share a name (they should be disjoint)."""
    g = rows.groupBy("work_date").agg(F.collect_set(F.when(F.col("person_kind") == FORMAL, F.col("person_name"))).alias("f"), F.collect_set(F.when(F.col("person_kind") == CONTRACT, F.col("person_name"))).alias("c"))
    return g.select("work_date", F.arrays_overlap("f", "c").alias("overlap"))


def drop_fixed_splits(warnings: DataFrame, corrected: DataFrame) -> DataFrame:
    """Name-split warnings (code, short, long) but for those whose short name was corrected (token)."""
    return warnings.join(corrected.select(F.col("token").alias("short")).distinct(), "short", "left_anti")


def batch_status(batches: DataFrame, open_codes: DataFrame) -> DataFrame:
    """parsed if the project is set and no blocking code is open; else needs_review."""
    o = open_codes.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_open"))
    j = batches.join(o, "batch_id", "left")
    return j.withColumn("status", F.when(F.col("project_id").isNotNull() & (F.coalesce("_open", F.lit(0)) == 0), "parsed").otherwise("needs_review")).drop("_open")


def export_person_days(facts: DataFrame, roster: DataFrame, contract_department: str = "") -> DataFrame:
    """Active facts with running number, department and title, by date, name and kind; numbered per date and added up over dates."""
    f = department_title(facts.where("status = 'active'"), roster, contract_department)
    per = f.groupBy("work_date").agg(F.count(F.lit(1)).alias("_n")).withColumn("_off", F.sum("_n").over(Window.orderBy("work_date")) - F.col("_n")).select("work_date", "_off")
    w = Window.partitionBy("work_date").orderBy("person_name", kind_order(F.col("person_kind")), "seq")
    return f.withColumn("_i", F.row_number().over(w)).join(per, "work_date").withColumn("number", F.col("_off") + F.col("_i")).select("number", "work_date", "person_name", "person_kind", "department", "title")
