"""Stored decisions on conflicts, in versions, and results that follow them: only what a decision touches is computed anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of persons that results are kept in, each a folder.
PARTS = 64
COLUMNS = "subject string, person string, action string, version long"


def decide(decisions: DataFrame, path: str, version: int) -> None:
    """Append decisions (subject, person, action) to the store at ``path`` under a version of their own.

    A version is written as one folder, whole or not at all, and written again it replaces itself, so a repeated call has no second effect.
    A null action takes back what was decided.  Of two decisions of one version on a subject the greater action stands.
    """
    once = decisions.select(F.col("subject").cast("string"), F.col("person").cast("string"), "action").groupBy("subject", "person").agg(F.max("action").alias("action"))
    once.write.mode("overwrite").parquet(f"{path}/version={version}")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """subject, person, action, version: everything decided so far."""
    return spark.read.schema(COLUMNS).parquet(path)


def standing(stored: DataFrame) -> DataFrame:
    """subject, person, action: the latest decision on each subject, without those taken back."""
    last = stored.groupBy("subject", "person").agg(F.max_by(F.struct("action"), "version").alias("a"))
    return last.select("subject", "person", "a.action").where("action is not null")


def part(person: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(person.cast("string")), F.lit(parts)).cast("int")


def refresh(spark: SparkSession, path: str, out: str, compute: Callable[[Callable[[DataFrame, str], DataFrame], DataFrame], DataFrame], since: int | None = None, person: str = "person", parts: int = PARTS) -> list[int]:
    """Bring the results at ``out`` up to the decisions at ``path``; returns the parts that were written.

    ``compute(of, standing)`` makes the results with a column ``person``; it must pass each of its inputs through ``of(input, person_column)``, which
    keeps the persons concerned.  With ``since`` these are the persons in the parts in which a decision of a later version
    lies; their parts are replaced by dynamic partition overwrite, all others stay as they are, files included.  Without it,
    everything is computed.  A part whose persons have no results any more is left with a row of nulls, which ``results`` leaves out.
    """
    every = stored(spark, path)
    if since is None:
        chosen = list(range(parts))
    else:
        rows = every.where(F.col("version") > since).select(part(F.col("person"), parts).alias("p")).distinct().orderBy("p").collect()
        chosen = [r.p for r in rows]  # at most ``parts``
    if not chosen:
        return []
    of = (lambda d, c: d) if since is None else (lambda d, c: d.where(part(F.col(c), parts).isin(chosen)))
    made = compute(of, standing(every))
    made = made.where(F.col(person).isNotNull()).withColumn("_part", part(F.col(person), parts))
    blank = spark.createDataFrame([(p,) for p in chosen], "_part int").select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in made.schema.fields if f.name != "_part"), "_part")
    both = made.unionByName(blank).repartition("_part")
    both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(out)
    return chosen


def results(spark: SparkSession, out: str, person: str = "person") -> DataFrame:
    return spark.read.parquet(out).where(F.col(person).isNotNull()).drop("_part")
