from pyspark.sql import functions as F

from quarry.functions import providers as P


def test_encoder_and_scorer_are_batched_and_deterministic(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b"), (4, "b")], "i int, t string").repartition(2)
    rows = {r.i: r for r in df.select("i", P.embed(F.col("t"), lambda: P.hashed_encoder(8), 2).alias("v"), P.score_pairs(F.lit("a b"), F.col("t"), P.overlap_scorer).alias("s")).collect()}
    assert rows[1].v == rows[3].v and len(rows[2].v) == 8 and [rows[i].s for i in (1, 2, 4)] == [1.0, 0.0, 0.5]


def test_observed_rows(spark):
    df, seen = P.observed(spark.range(7), "n")
    df.collect()
    assert seen()["rows"] == 7
