"""Access: visibility predicates, organisation closure, grants, feature gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

CLEARANCES = ("general", "core")


def cleared(classification: Column, clearance: str) -> Column:
    """Classes up to the clearance's rank (an unknown clearance ranks lowest)."""
    top = CLEARANCES.index(clearance) if clearance in CLEARANCES else 0
    return F.coalesce(classification, F.lit(CLEARANCES[0])).isin(*CLEARANCES[: top + 1])


def visible(org_units: list[str], projects: list[str], domains: list[str], clearance: str = "general") -> Column:
    """(unit in scope and class cleared) or (project and domain in scope, project not blank); without any scope nothing.

    It fails closed: rows that lack the labels are not visible.
    """
    out = F.lit(False)
    if org_units:
        out = out | (F.col("org_unit_id").isin(*org_units) & cleared(F.col("classification"), clearance))
    if projects and domains:
        out = out | (F.col("project_id").isin(*projects) & F.col("domain").isin(*domains) & (F.coalesce("project_id", F.lit("")) != ""))
    return F.coalesce(out, F.lit(False))


def can_upload(org_unit: Column, project: Column, domain: Column, org_units: list[str], projects: list[str], domains: list[str]) -> Column:
    """With a project: project and domain in scope; else the unit in scope."""
    by_project = project.isin(*projects) & domain.isin(*domains) if projects and domains else F.lit(False)
    by_unit = org_unit.isin(*org_units) if org_units else F.lit(False)
    return F.coalesce(F.when(F.coalesce(project, F.lit("")) != "", by_project).otherwise(by_unit), F.lit(False))


def descendants(units: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id): each root (code) and all units below it, by breadth-first rounds that end on cycles too.

    Units (id, parent_id, code) form a small dimension; each round is one join, and a pair
    already found is not followed again.
    """
    found = cut(units.join(roots.select(F.col("code")).distinct(), "code").select(F.col("code").alias("root"), F.col("id")))
    at = found
    while not at.isEmpty():
        below = at.join(units.select(F.col("id").alias("_c"), "parent_id"), at["id"] == F.col("parent_id")).select("root", F.col("_c").alias("id")).distinct()
        at = cut(below.join(found, ["root", "id"], "left_anti"))
        found = found.unionByName(at)
    return found


def closure_sql(units: DataFrame, root: str) -> DataFrame:
    """id of one root and all units below it, as one recursive query: of any depth, and a unit already on the way down ends a cycle.

    Levels are at most as many as units, which is the limit that the query is given; the root is a parameter, not part of its text.
    """
    n = units.count()
    query = f"""WITH RECURSIVE c (id, way) MAX RECURSION LEVEL {n + 1} AS (
  SELECT id, array(id) FROM {{units}} WHERE code = :root
  UNION ALL SELECT u.id, array_append(c.way, u.id) FROM {{units}} u JOIN c ON u.parent_id = c.id WHERE NOT array_contains(c.way, u.id))
SELECT DISTINCT id FROM c"""
    return units.sparkSession.sql(query, {"root": root}, units=units)


def permissions(user_position: DataFrame, position: DataFrame, position_role: DataFrame, role_permission: DataFrame) -> DataFrame:
    """user_id and the set of permissions of the roles of their active positions."""
    posts = user_position.join(position.where("active"), "position_id")
    roles = posts.join(position_role, "position_id").join(role_permission, "role_id")
    return roles.groupBy("user_id").agg(F.sort_array(F.collect_set("permission")).alias("permissions"))


def positions_with_roles(position: DataFrame, position_role: DataFrame, role: DataFrame) -> DataFrame:
    codes = position_role.join(role, "role_id").groupBy("position_id").agg(F.sort_array(F.collect_set("code")).alias("roles"))
    return position.join(codes, "position_id", "left").withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))


def feature_gate(org_ids: Column, feature_ids: Column, granted: Column, needed: str) -> Column:
    """Some unit of the user is in the feature's closure, and the permission is held."""
    return F.coalesce(F.arrays_overlap(org_ids, feature_ids) & F.array_contains(granted, needed), F.lit(False))
