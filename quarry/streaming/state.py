"""Keyed state with timers on Structured Streaming: leases, waits for an end, rolling compression of conversations.

Each is a stateful processor whose state and timers live in the engine's state store (RocksDB), so a restart goes on where the
last committed batch ended.  Rows of a key are taken in time order within a batch; time is event time, and timers fire
behind the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What ends a version.
TERMINAL = ("ready", "failed")


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which these processors need; the session's own setting comes back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def run(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all that is there, with its checkpoint and result in ``folder``; again, it goes on from there."""
    spark = stream.sparkSession
    with rocksdb(spark):
        w = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/data")
        w.format("parquet").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/data")


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> list[tuple]:
    frames = list(rows)
    return list(pd.concat(frames).sort_values(by, kind="stable").itertuples(index=False)) if frames else []


def _millis(column) -> F.Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


class _Leases(StatefulProcessor):
    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "holder string, until long")

    def _lapse(self) -> tuple | None:
        holder, until = self.held.get()
        self.held.clear()
        return holder, "lapsed", int(until)

    def handleInputRows(self, key, rows, timerValues):
        out = []
        for r in _in_order(rows, ["at", "action", "holder"]):
            if self.held.exists() and int(self.held.get()[1]) <= r.at:
                self.handle.deleteTimer(int(self.held.get()[1]))
                out.append(self._lapse())
            if r.action == "release":
                if self.held.exists():
                    self.handle.deleteTimer(int(self.held.get()[1]))
                    self.held.clear()
                    out.append((r.holder, "released", int(r.at)))
            elif self.held.exists():
                out.append((r.holder, "refused", int(r.at)))
            else:
                self.held.update((r.holder, int(r.at) + self.ttl))
                self.handle.registerTimer(int(r.at) + self.ttl)
                out.append((r.holder, "granted", int(r.at)))
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        due = self.held.exists() and int(self.held.get()[1]) <= expiredTimerInfo.getExpiryTimeInMs()
        yield self._frame(key, [self._lapse()] if due else [])

    def close(self) -> None:
        pass

    @staticmethod
    def _frame(key, out) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *o) for o in out], columns=["key", "holder", "event", "at"])


def leases(requests: DataFrame, ttl_seconds: int = 120, late: str = "0 seconds") -> DataFrame:
    """key, holder, event (granted, refused, released, lapsed), at: what becomes of requests (key, holder, action, ts) for one lease a key.

    ``acquire`` is granted if nobody holds the key, and lapses after ``ttl_seconds`` unless the key is released before; ``release`` frees the key whoever
    asks, and says nothing where it is free.  A lease that ran out lapses as soon as the watermark is past its end, even if nothing
    more comes for its key.  Requests of null keys share the null key's lease.
    """
    r = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    r = r.select(F.col("key").cast("string").alias("key"), "ts", F.col("holder").cast("string").alias("holder"), "action", _millis("ts").alias("at"))
    out = r.groupBy("key").transformWithStateInPandas(_Leases(ttl_seconds * 1000), "key string, holder string, event string, at long", "append", "EventTime")
    return out.select("key", "holder", "event", F.timestamp_millis("at").alias("at"))


class _Waits(StatefulProcessor):
    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, chunks long")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows, timerValues):
        out = []
        for r in _in_order(rows, ["at", "kind", "status"]):
            if self.due.exists() and int(self.due.get()[0]) <= r.at:
                out.append(self._end("timeout", 0, int(self.due.get()[0])))
            if r.kind == "wait":
                if not self.due.exists():
                    self.due.update((int(r.at) + self.timeout,))
                    self.handle.registerTimer(int(r.at) + self.timeout)
            elif r.status is None:
                self.last.clear()
                if self.due.exists():
                    self._stop()
            else:
                self.last.update((r.status, int(r.chunks)))
            if self.due.exists() and self.last.exists() and self.last.get()[0] in TERMINAL:
                status, chunks = self.last.get()
                out.append(self._end(status, int(chunks), int(r.at)))
        yield self._frame(key, out)

    def _stop(self) -> None:
        self.handle.deleteTimer(int(self.due.get()[0]))
        self.due.clear()

    def _end(self, status: str, chunks: int, at: int) -> tuple:
        self._stop()
        return status, chunks, at

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out = []
        if self.due.exists() and int(self.due.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            at = int(self.due.get()[0])
            self.due.clear()
            out.append(("timeout", 0, at))
        yield self._frame(key, out)

    def close(self) -> None:
        pass

    @staticmethod
    def _frame(key, out) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *o) for o in out], columns=["version_id", "status", "chunks", "at"])


def wait_for_end(requests: DataFrame, statuses: DataFrame, timeout_seconds: int, late: str = "0 seconds") -> DataFrame:
    """version_id, status, chunks, at: how each awaited version ended, once a wait.

    ``requests`` (version_id, ts) start a wait, ``statuses`` (version_id, status, chunks, ts) are what versions come to; a null
    status says that the version is gone, which ends the wait without a row.  A version that is ready or failed when the wait starts ends it at once;
    one that is neither within ``timeout_seconds`` gives ``timeout`` (with no chunks) as soon as the watermark is past that, whether
    or not anything more comes.  A second wait while one runs is the same wait.
    """
    timed = lambda d, kind, *more: d.select(F.col("version_id").cast("string").alias("version_id"), F.col("ts").cast("timestamp").alias("ts"), F.lit(kind).alias("kind"), *more)
    w = timed(requests, "wait", F.lit(None).cast("string").alias("status"), F.lit(0).cast("long").alias("chunks"))
    s = timed(statuses, "status", "status", F.coalesce(F.col("chunks").cast("long"), F.lit(0).cast("long")).alias("chunks"))
    both = s.unionByName(w).withWatermark("ts", late).withColumn("at", _millis("ts"))
    out = both.groupBy("version_id").transformWithStateInPandas(_Waits(timeout_seconds * 1000), "version_id string, status string, chunks long, at long", "append", "EventTime")
    return out.select("version_id", "status", "chunks", F.timestamp_millis("at").alias("at"))


def compress_step(kept: list[tuple[int, int]], message: tuple[int, int], budget: int, keep: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(what stays, what is compressed) after one more message (id, tokens): nothing within the budget; else all but the last ``keep``, or the older half if there are no more than that."""
    kept = [*kept, message]
    if sum(t for _, t in kept) <= budget:
        return kept, []
    cut = len(kept) - keep if len(kept) > keep else max(1, len(kept) // 2)
    return kept[cut:], kept[:cut]


class _Compression(StatefulProcessor):
    def __init__(self, budget: int, turns: int):
        self.budget, self.keep = budget, max(1, 2 * turns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "id long, tokens long")
        self.version = handle.getValueState("version", "version int, covered_to long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        rows = list(initialState.itertuples(index=False))
        self.version.update((int(rows[0].version), int(rows[0].covered_to)))
        held = [(int(r.id), int(r.tokens)) for r in rows if pd.notna(r.id)]
        if held:
            self.kept.put(sorted(held))

    def handleInputRows(self, key, rows, timerValues):
        kept = [(int(i), int(t)) for i, t in self.kept.get()] if self.kept.exists() else []
        version, covered = map(int, self.version.get()) if self.version.exists() else (0, -1)
        out = []
        for r in _in_order(rows, ["id"]):
            kept, gone = compress_step(kept, (int(r.id), int(r.tokens)), self.budget, self.keep)
            if gone:
                version, covered = version + 1, gone[-1][0]
                out.append((key[0], version, gone[0][0], covered, sum(t for _, t in gone), len(kept)))
        if kept:
            self.kept.put(kept)
        else:
            self.kept.clear()
        self.version.update((version, covered))
        yield pd.DataFrame(out, columns=["conversation_id", "version", "covered_from", "covered_to", "tokens", "retained"])

    def close(self) -> None:
        pass


def rolling_compression(messages: DataFrame, budget: int, turns: int, start: DataFrame | None = None) -> DataFrame:
    """conversation_id, version, covered_from, covered_to, tokens, retained of each summary that the messages (conversation_id, id, tokens) lead to.

    A conversation's state is its list of messages not yet compressed and the version of its last summary; each message
    that takes the list over ``budget`` makes a summary of what ``compress_step`` gives up.  ``start`` (conversation_id, version, covered_to,
    kept: array of id and tokens) is where conversations stand when the stream starts for the first time.  Messages of a batch
    are taken by id; the state can be read with ``compression_state``.
    """
    m = messages.select("conversation_id", F.col("id").cast("long").alias("id"), F.col("tokens").cast("long").alias("tokens"))
    first = None
    if start is not None:
        first = start.select("conversation_id", F.col("version").cast("int").alias("version"), F.col("covered_to").cast("long").alias("covered_to"), F.explode_outer("kept").alias("k"))
        first = first.select("conversation_id", "version", "covered_to", F.col("k.id").cast("long").alias("id"), F.col("k.tokens").cast("long").alias("tokens")).groupBy("conversation_id")
    kind = messages.schema["conversation_id"].dataType.simpleString()
    schema = f"conversation_id {kind}, version int, covered_from long, covered_to long, tokens long, retained int"
    return m.groupBy("conversation_id").transformWithStateInPandas(_Compression(budget, turns), schema, "append", "None", first)


def compression_state(spark: SparkSession, folder: str) -> DataFrame:
    """conversation_id, version, covered_to, kept (ids, ascending) as the last committed batch of a ``run`` in ``folder`` left them."""
    read = lambda name: spark.read.format("statestore").option("path", f"{folder}/checkpoint").option("stateVarName", name)
    with rocksdb(spark):
        version = read("version").load().select("key.*", F.col("value.version").alias("version"), F.col("value.covered_to").alias("covered_to"))
        kept = read("kept").option("flattenCollectionTypes", True).load().select("key.*", F.col("list_element.id").alias("id"))
    kept = kept.groupBy("conversation_id").agg(F.sort_array(F.collect_list("id")).alias("kept"))
    return version.join(kept, "conversation_id", "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<bigint>")))
