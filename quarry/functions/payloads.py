"""Answers of conversion services, as ``variant`` columns: fields where they usually are, or wherever they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.shared import cut

#: Levels of nesting that a walk follows at most; JSON deeper than this doesn't parse into a variant.
MOST_LEVELS = 1000


def parsed(text: Column) -> Column:
    """The payload as a variant, null if it is not JSON."""
    return F.try_parse_json(text)


def text_at(payload: Column, *paths: str) -> Column:
    """The first of the paths that holds a string (no number, no null) that isn't empty."""
    found = []
    for p in paths:
        v = F.try_variant_get(payload, p, "variant")
        found.append(F.when(F.schema_of_variant(v) == "STRING", F.nullif(F.try_variant_get(payload, p, "string"), F.lit(""))))
    return F.coalesce(*found)


def primary_file(payload: Column) -> Column:
    """The first of the payload's file names, at the top or under ``data``, as text."""
    return F.coalesce(*(F.try_variant_get(payload, f"$.{at}file_names[0]", "string") for at in ("", "data.")))


def markdown_of(payload: Column, filename: Column) -> Column:
    """The converted text: the result whose name is or ends with the file's, else the first by name; else the batch's first, else the plain one; else ''.

    Results without text don't count.
    """
    held = F.map_entries(F.try_variant_get(payload, "$.results", "map<string, variant>"))
    told = F.filter(F.transform(held, lambda e: F.struct(e["key"].alias("name"), text_at(e["value"], "$.md_content").alias("t"))), lambda r: F.trim(r["t"]) != "")
    named = F.filter(told, lambda r: (filename != "") & r["name"].endswith(filename))
    batch = F.when(F.schema_of_variant(F.try_variant_get(payload, "$.data.batch_result_list[0].md_content", "variant")) == "STRING", F.try_variant_get(payload, "$.data.batch_result_list[0].md_content", "string"))
    return F.coalesce(F.get(named, 0)["t"], F.get(F.array_sort(told), 0)["t"], batch, text_at(payload, "$.data.md_content"), F.lit(""))


def answers(df: DataFrame, payload: str, filename: str) -> DataFrame:
    """``df`` with task_id, status, error, primary_file, markdown of the payloads (JSON text)."""
    v = parsed(F.col(payload))
    return df.withColumns({
        "task_id": text_at(v, "$.task_id", "$.data.task_id"),
        "status": text_at(v, "$.status", "$.data.status"),
        "error": text_at(v, "$.error", "$.message"),
        "primary_file": primary_file(v),
        "markdown": markdown_of(v, F.coalesce(F.col(filename), F.lit(""))),
    })


def search(df: DataFrame, key: str, payload: str, names: list[str]) -> DataFrame:
    """key, level, path, value: for each row, the string under one of ``names`` that lies least deep.

    Payloads are opened one level at a time, objects and lists alike; a row that has found its string is not opened further, and the walk
    ends with the last row, at any depth.  On one level the order of ``names`` decides, then the path.  Rows without a
    find are left out; keys must be unique.
    """
    spark = df.sparkSession
    at = df.select(F.col(key).alias("_k"), parsed(F.col(payload)).alias("_v"), F.lit("$").alias("_p"))
    out = None
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("_name"))
    for level in range(1, MOST_LEVELS + 1):
        below = spark.sql("SELECT _k, _p, t.key _name, t.pos _pos, t.value _v FROM {at}, LATERAL variant_explode(_v) t", at=at)
        path = F.concat("_p", F.when(F.col("_name").isNull(), F.concat(F.lit("["), "_pos", F.lit("]"))).otherwise(F.concat(F.lit("."), "_name")))
        below = cut(below.select("_k", "_name", path.alias("_p"), "_v", F.schema_of_variant("_v").alias("_kind")))
        text = F.when((F.col("_kind") == "STRING") & (rank > 0), F.nullif(F.col("_v").try_cast("string"), F.lit("")))
        hits = below.withColumn("value", text).where("value is not null").groupBy("_k").agg(F.min(F.struct(rank.alias("r"), F.col("_p").alias("path"), "value")).alias("m"))
        hits = hits.select(F.col("_k").alias(key), F.lit(level).alias("level"), "m.path", "m.value")
        out = hits if out is None else out.unionByName(hits)
        opened = below.where(F.col("_kind").startswith("OBJECT") | F.col("_kind").startswith("ARRAY"))
        at = opened.join(hits.select(F.col(key).alias("_k")), "_k", "left_anti").select("_k", "_v", "_p")
        if at.isEmpty():
            break
    return out
