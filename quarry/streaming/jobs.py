"""Structured Streaming forms of the queue, rate limit, lock-out and memory-threshold operators.

Each takes a streaming DataFrame (or, where it says so, a batch one) and can be run to the end
of what is available with :func:`run_available`; checkpoints make restarts exact.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.shared import cut, shared_folder


def read_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A table (one Parquet file, or a folder of them) as a stream."""
    batch = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", files_per_trigger)
    if all(f.endswith(f"/{name}.parquet") for f in batch.inputFiles()):
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return stream.parquet(f"{sf_dir}/{name}.parquet")


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there into Parquet, and read that; in complete mode, what the last batch left."""
    spark = stream.sparkSession
    out = shared_folder(spark, "stream")
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    if mode == "complete":
        w = w.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{out}/data"))
    else:
        w = w.format("parquet").option("path", f"{out}/data")
    w.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def rate_limit(events: DataFrame, key: str, ts: str, limit: int, window: str = "60 seconds", late: str = "5 minutes") -> DataFrame:
    """Calls per key and fixed window, and how many of them the limit rejects; windows close behind the watermark."""
    g = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("window.start").alias("window_start"), "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("rejected"))


def lockouts(attempts: DataFrame, failures: int = 5, within: int = 300, locked: int = 300) -> DataFrame:
    """username and locked_at of every lock: the n-th failure within ``within`` seconds of the first since the
    last success or lock; attempts while locked don't count.  Attempts (username, ts, success) of a user are taken in time order per batch.
    """

    second = 1_000_000

    def step(key, frames, state):
        n, first, until = state.get if state.exists else (0, 0, 0)
        out = []
        for t, ok in pd.concat(list(frames)).sort_values("us", kind="stable")[["us", "success"]].itertuples(index=False):
            if t < until:
                continue
            if ok:
                n = 0
                continue
            if n == 0 or t - first > within * second:
                n, first = 0, int(t)
            n += 1
            if n >= failures:
                n, until = 0, int(t) + locked * second
                out.append(int(t))
        state.update((n, first, until))
        yield pd.DataFrame({"username": pd.Series([key[0]] * len(out), dtype=object), "us": pd.Series(out, dtype="int64")})

    timed = attempts.select("username", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "success")
    locks = timed.groupBy("username").applyInPandasWithState(step, "username string, us long", "n int, first long, until long", "append", GroupStateTimeout.NoTimeout)
    return locks.select("username", F.timestamp_micros("us").alias("locked_at"))


def memory_triggers(messages: DataFrame, budget: int) -> DataFrame:
    """conversation_id, window_tokens each time a conversation's running tokens pass the budget (its window then starts anew)."""

    def step(key, frames, state):
        total = state.get[0] if state.exists else 0
        out = []
        for v in pd.concat(list(frames)).sort_values("id")["tokens"]:
            total += int(v)
            if total > budget:
                out.append(total)
                total = 0
        state.update((total,))
        yield pd.DataFrame({"conversation_id": [key[0]] * len(out), "window_tokens": pd.Series(out, dtype="int64")})

    return messages.groupBy("conversation_id").applyInPandasWithState(step, "conversation_id long, window_tokens long", "total long", "append", GroupStateTimeout.NoTimeout)


def process_queue(jobs: DataFrame, key: str, handle, folder: str | None = None) -> str:
    """At-least-once queue: every micro-batch's jobs go through ``handle`` (DataFrame to DataFrame) and are written under
    the batch's own number, so a repeated batch overwrites itself.  Returns the folder of results.
    """
    out = folder or shared_folder(jobs.sparkSession, "queue")

    def write(batch: DataFrame, number: int) -> None:
        handle(batch.dropDuplicates([key])).write.mode("overwrite").parquet(f"{out}/done/batch={number}")

    q = jobs.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return f"{out}/done"


def route(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memory jobs, which come first, and the others: two queries over one stream."""
    memory = F.col("type").isin("compress", "title")
    return jobs.where(memory), jobs.where(~memory)


def work(jobs: DataFrame, key: str, steps: list, folder: str | None = None) -> str:
    """One consumer of a queue with jobs of several kinds; returns the folder of results.

    ``steps`` are (condition, handle), first come first: in every micro-batch the jobs of a step are handled and written before the next step's
    handler is called, so memory jobs never wait behind an ingestion.  A job is handled by the first step whose condition it meets.
    Results go under the step's and the batch's number.  If a handler or the process fails, the batch is not committed, and the next
    start takes the same jobs again under the same number: what was already written is replaced, nothing is there twice, and a key that
    comes again in a later batch is not handled again.
    """
    spark = jobs.sparkSession
    out = folder or shared_folder(spark, "work")

    def write(batch: DataFrame, number: int) -> None:
        batch = cut(batch.dropDuplicates([key]))
        taken = F.lit(False)
        for i, (condition, handle) in enumerate(steps):
            mine = batch.where(F.coalesce(condition, F.lit(False)) & ~taken)
            taken = taken | F.coalesce(condition, F.lit(False))
            if number:
                done = _done(spark, out, key, jobs.schema[key].dataType).where((F.col("step") == i) & (F.col("batch") < number))
                mine = mine.join(done.select(key), key, "left_anti")
            handle(mine).write.mode("overwrite").parquet(f"{out}/done/step={i}/batch={number}")

    q = jobs.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return f"{out}/done"


def _done(spark: SparkSession, out: str, key: str, kind) -> DataFrame:
    schema = StructType([StructField(key, kind), StructField("step", LongType()), StructField("batch", LongType())])
    return spark.read.schema(schema).parquet(f"{out}/done")


def publish_versions(rows: DataFrame, versions: DataFrame, path: str, key: str = "version_id") -> None:
    """Replace everything that ``path`` has of ``versions`` (key) by ``rows`` in one step: delete and write are one dynamic partition overwrite.

    Done again, it leaves the same; other versions keep their files.  A version without rows is left with a row of nulls, which
    ``published`` leaves out.  Rows of other versions than those given are an error in the caller and not written.
    """
    mine = rows.join(versions.select(key).distinct(), key, "left_semi").withColumn("_row", F.lit(True))
    blank = versions.select(key).distinct().select(*(F.col(c) if c == key else F.lit(None).cast(mine.schema[c].dataType).alias(c) for c in mine.columns if c != "_row"), F.lit(False).alias("_row"))
    mine.unionByName(blank).repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def published(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("_row").drop("_row")
