"""The corpus pipeline: quality classifier, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``docs``.  A runner may write each stage's rows as Parquet and read them again
as the next one's ``docs``.

In every stage null and empty texts are documents without words (the classifier scores them, they are one group of copies,
hold no passage and are never drawn by the mix), very long texts are read whole, ties fall to the least id, repeated rows and ids
count each, an empty table stays empty, and further columns, whatever their names, are passed on by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common, decontaminate, mixing, neardup, quality, sharding

#: What each stage writes isn't expressible in SQL (trained model, tries, weighted medians).
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores one half or more; it is trained on the labels of ``sf_dir``."""
    scored, out = quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.where(F.col(out)["score"] >= 0.5).select(*(scored[c] for c in docs.columns))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of every group of five-word Jaccard similarity 0.8 or more."""
    return neardup.deduplicate(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage occurs."""
    found, out = decontaminate.find_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size(F.col(out)["spans"]) == 0).select(*(found[c] for c in docs.columns))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: whole times, and once more with the probability of the rest (by a hash of its id)."""
    key, times = common.free_name(docs, "_key"), common.free_name(docs, "_times")
    d = common.with_key(docs, "doc_id", key)
    _, taken = mixing.mix(d.select(d[key].alias("doc_id"), d["text"], d["source"]))
    share = F.col("taken") / F.greatest("size", F.lit(1))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(mixing.SEED)), F.lit(1 << 30)) / float(1 << 30)
    copies = taken.select(F.col("doc_id").alias("_id"), (F.floor(share) + (draw < share - F.floor(share)).cast("int")).cast("int").alias(times)).where(F.col(times) > 0)
    out = d.join(copies, d[key] == copies["_id"])
    return out.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*(d[c] for c in docs.columns))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The 16 shards of what is left."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("near-dedup", keep_one_of_each),
    ("benchmark decontamination", keep_uncontaminated),
    ("mixing sources to target weights", mix_to_targets),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
