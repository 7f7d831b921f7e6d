"""Queries that run streams to the end of the events and conversations tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.shared import shared_folder
from ..streaming import jobs, state
from .inputs import table

S = F.col


def stream_rate_limit(spark, d):
    """All windows of the stream, in complete mode: what the last batch leaves is every window's final count."""
    e = jobs.read_table(spark, d, "events").select(F.concat(F.lit("a"), S("user_id")).alias("actor"), "ts")
    k = jobs.run_available(jobs.rate_limit(e, "actor", "ts", 2, "1 day", "0 seconds"), "complete")
    return k.select("actor", S("window_start").cast("string").alias("window_start"), "n", "rejected")


def stream_lockouts(spark, d):
    e = jobs.read_table(spark, d, "events").select(F.concat(F.lit("u"), S("user_id") % 20).alias("username"), "ts", (S("event_type") == "purchase").alias("success"))
    k = jobs.run_available(jobs.lockouts(e, 3, 7200, 3600))
    return k.select("username", S("locked_at").cast("string").alias("locked_at"))


def stream_memory_triggers(spark, d):
    c = jobs.read_table(spark, d, "conversations").select(S("conv_id").alias("conversation_id"), S("turn").alias("id"), F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).alias("tokens"))
    return jobs.run_available(jobs.memory_triggers(c, 300))


def stream_queue(spark, d):
    e = jobs.read_table(spark, d, "events").select("event_id", "event_type")
    done = jobs.process_queue(e, "event_id", lambda b: b.withColumn("state", F.lit("ready")))
    return spark.read.parquet(done).groupBy("event_type", "state").agg(F.count(F.lit(1)).alias("n"))


def stream_leases(spark, d):
    """Leases of two hours on fifty keys: purchases release, other events ask."""
    e = jobs.read_table(spark, d, "events").select((S("user_id") % 50).cast("string").alias("key"), S("event_id").cast("string").alias("holder"), F.when(S("event_type") == "purchase", "release").otherwise("acquire").alias("action"), "ts")
    k = state.run(state.leases(e, 7200), shared_folder(spark, "leases"))
    return k.select("key", "holder", "event", F.unix_millis("at").alias("at"))


def stream_waits(spark, d):
    """Sign-ups wait a day for their version; views and clicks move it on, purchases end it, every eleventh view takes it away."""
    e = jobs.read_table(spark, d, "events")
    v = F.concat(F.lit("v"), S("event_id") % 200).alias("version_id")
    status = F.when((S("event_type") == "view") & (S("event_id") % 11 == 0), F.lit(None)).when(S("event_type") == "purchase", F.when(S("event_id") % 3 == 0, "failed").otherwise("ready")).otherwise(S("event_type"))
    w = state.wait_for_end(e.where("event_type = 'signup'").select(v, "ts"), e.where("event_type != 'signup'").select(v, status.alias("status"), (S("event_id") % 10).alias("chunks"), "ts"), 86400)
    return state.run(w, shared_folder(spark, "waits")).select("version_id", "status", "chunks", F.unix_millis("at").alias("at"))


def _compressed(spark, d, folder):
    c = jobs.read_table(spark, d, "conversations").select(S("conv_id").alias("conversation_id"), S("turn").alias("id"), F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).alias("tokens"))
    start = table(spark, d, "conversations").where("conv_id % 3 = 0").select(S("conv_id").alias("conversation_id")).distinct()
    start = start.select("conversation_id", F.lit(4).alias("version"), F.lit(-3).alias("covered_to"), F.array(F.struct(F.lit(-2).alias("id"), F.lit(40).alias("tokens")), F.struct(F.lit(-1).alias("id"), F.lit(50).alias("tokens"))).alias("kept"))
    return state.run(state.rolling_compression(c, 300, 2, start), folder)


def stream_compression(spark, d):
    return _compressed(spark, d, shared_folder(spark, "compression"))


def stream_compression_state(spark, d):
    """What the stream leaves in its state, read back through the state data source."""
    folder = shared_folder(spark, "compression")
    _compressed(spark, d, folder)
    return state.compression_state(spark, folder).select("conversation_id", "version", "covered_to", F.array_join("kept", ",").alias("kept"))


QUERIES = {f.__name__: f for f in (stream_rate_limit, stream_lockouts, stream_memory_triggers, stream_queue, stream_leases, stream_waits, stream_compression, stream_compression_state)}

_LEASES = """WITH RECURSIVE e AS (SELECT CAST(user_id % 50 AS VARCHAR) k, CAST(event_id AS VARCHAR) h, CASE WHEN event_type = 'purchase' THEN 'release' ELSE 'acquire' END a, epoch_us(ts) // 1000 t FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, a, h) i FROM e),
s AS (SELECT k, CAST(0 AS BIGINT) i, CAST(NULL AS VARCHAR) h, CAST(NULL AS BIGINT) u, CAST(NULL AS VARCHAR) lh, CAST(NULL AS BIGINT) lu, CAST(NULL AS VARCHAR) eh, CAST(NULL AS VARCHAR) ev, CAST(NULL AS BIGINT) et FROM (SELECT DISTINCT k FROM e)
UNION ALL SELECT k, i, CASE WHEN a = 'release' THEN NULL WHEN live THEN h ELSE nh END, CASE WHEN a = 'release' THEN NULL WHEN live THEN u ELSE t + 7200000 END, CASE WHEN u <= t THEN h END, CASE WHEN u <= t THEN u END, nh,
CASE WHEN a = 'release' THEN CASE WHEN live THEN 'released' END WHEN live THEN 'refused' ELSE 'granted' END, t FROM (SELECT o.k, o.i, s.h, s.u, o.h nh, o.a, o.t, coalesce(s.u > o.t, false) live FROM s JOIN o ON s.k = o.k AND o.i = s.i + 1))
SELECT k AS "key", eh AS holder, ev AS event, et AS at FROM s WHERE ev IS NOT NULL UNION ALL SELECT k, lh, 'lapsed', lu FROM s WHERE lh IS NOT NULL
UNION ALL SELECT k, h, 'lapsed', u FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1) WHERE u <= (SELECT max(t) FROM e)"""
_WAITS = """WITH RECURSIVE e AS (SELECT 'v' || (event_id % 200) v, epoch_us(ts) // 1000 t, CASE WHEN event_type = 'signup' THEN 'wait' ELSE 'status' END k, CASE WHEN event_type = 'signup' OR event_type = 'view' AND event_id % 11 = 0 THEN NULL WHEN event_type = 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'ready' END ELSE event_type END st, event_id % 10 ch FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY t, k, st NULLS LAST) i FROM e),
s AS (SELECT v, CAST(0 AS BIGINT) i, CAST(NULL AS VARCHAR) st, CAST(NULL AS BIGINT) ch, CAST(NULL AS BIGINT) due, CAST(NULL AS BIGINT) lapsed, CAST(NULL AS VARCHAR) es, CAST(NULL AS BIGINT) ec, CAST(NULL AS BIGINT) et FROM (SELECT DISTINCT v FROM e)
UNION ALL SELECT v, i, st, ch, CASE WHEN st IN ('ready', 'failed') THEN NULL ELSE due END, lapsed, CASE WHEN due IS NOT NULL AND st IN ('ready', 'failed') THEN st END, ch, t FROM (
SELECT o.v, o.i, o.t, CASE WHEN o.k = 'wait' THEN s.st ELSE o.st END st, CASE WHEN o.k = 'wait' THEN s.ch ELSE o.ch END ch, CASE WHEN s.due <= o.t THEN s.due END lapsed,
CASE WHEN o.k = 'wait' THEN CASE WHEN s.due > o.t THEN s.due ELSE o.t + 86400000 END WHEN o.st IS NULL OR s.due <= o.t THEN NULL ELSE s.due END due FROM s JOIN o ON s.v = o.v AND o.i = s.i + 1))
SELECT v version_id, es AS status, ec chunks, et AS at FROM s WHERE es IS NOT NULL UNION ALL SELECT v, 'timeout', 0, lapsed FROM s WHERE lapsed IS NOT NULL
UNION ALL SELECT v, 'timeout', 0, due FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY v ORDER BY i DESC) = 1) WHERE due <= (SELECT max(t) FROM e)"""
_COMPRESSION = """WITH RECURSIVE m AS (SELECT conv_id c, turn id, CAST(floor(length(coalesce(text, '')) / 2) AS BIGINT) k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) i FROM conversations),
s AS (SELECT c, CAST(0 AS BIGINT) i, CASE WHEN c % 3 = 0 THEN [{'id': CAST(-2 AS BIGINT), 'k': CAST(40 AS BIGINT)}, {'id': -1, 'k': 50}] ELSE CAST([] AS STRUCT(id BIGINT, k BIGINT)[]) END kept, CASE WHEN c % 3 = 0 THEN 4 ELSE 0 END v, CAST(CASE WHEN c % 3 = 0 THEN -3 ELSE -1 END AS BIGINT) upto, CAST([] AS STRUCT(id BIGINT, k BIGINT)[]) gone FROM (SELECT DISTINCT c FROM m)
UNION ALL SELECT c, i, r[n + 1 :], v + CASE WHEN n > 0 THEN 1 ELSE 0 END, CASE WHEN n > 0 THEN r[n].id ELSE upto END, r[: n] FROM (
SELECT *, CASE WHEN list_sum(list_transform(r, lambda x: x.k)) <= 300 THEN 0 WHEN len(r) > 4 THEN len(r) - 4 ELSE greatest(1, len(r) // 2) END n FROM (SELECT m.c, m.i, list_append(s.kept, {'id': CAST(m.id AS BIGINT), 'k': m.k}) r, s.v, s.upto FROM s JOIN m ON s.c = m.c AND m.i = s.i + 1)))"""
_LOCKOUTS = """WITH RECURSIVE e AS (SELECT 'u' || (user_id % 20) u, epoch_us(ts) t, event_type = 'purchase' ok FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY t) i FROM e),
s AS (SELECT u, CAST(0 AS BIGINT) i, 0 n, CAST(0 AS BIGINT) f, CAST(0 AS BIGINT) b, CAST(NULL AS BIGINT) lk FROM (SELECT DISTINCT u FROM e)
UNION ALL SELECT u, i, CASE WHEN t < b THEN n WHEN ok OR m >= 3 THEN 0 ELSE m END, CASE WHEN t < b OR ok THEN f WHEN m = 1 THEN t ELSE f END, CASE WHEN t >= b AND NOT ok AND m >= 3 THEN t + 3600000000 ELSE b END, CASE WHEN t >= b AND NOT ok AND m >= 3 THEN t END FROM (
SELECT o.u, o.i, o.t, o.ok, s.n, s.f, s.b, CASE WHEN s.n = 0 OR o.t - s.f > 7200000000 THEN 1 ELSE s.n + 1 END m FROM s JOIN o ON s.u = o.u AND o.i = s.i + 1))
SELECT u username, rtrim(rtrim(strftime(make_timestamp(lk), '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') locked_at FROM s WHERE lk IS NOT NULL"""
_TRIGGERS = """WITH RECURSIVE m AS (SELECT conv_id c, CAST(floor(length(coalesce(text, '')) / 2) AS BIGINT) k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) i FROM conversations),
s AS (SELECT c, CAST(0 AS BIGINT) i, CAST(0 AS BIGINT) n, CAST(NULL AS BIGINT) w FROM (SELECT DISTINCT c FROM m)
UNION ALL SELECT m.c, m.i, CASE WHEN s.n + m.k > 300 THEN 0 ELSE s.n + m.k END, CASE WHEN s.n + m.k > 300 THEN s.n + m.k END FROM s JOIN m ON s.c = m.c AND m.i = s.i + 1)
SELECT c conversation_id, w window_tokens FROM s WHERE w IS NOT NULL"""
ORACLE_SQL = {
    "stream_leases": _LEASES,
    "stream_waits": _WAITS,
    "stream_compression": _COMPRESSION + " SELECT c conversation_id, v AS version, gone[1].id covered_from, upto covered_to, CAST(list_sum(list_transform(gone, lambda x: x.k)) AS BIGINT) tokens, CAST(len(kept) AS INT) retained FROM s WHERE len(gone) > 0",
    "stream_compression_state": _COMPRESSION + " SELECT c conversation_id, v AS version, upto covered_to, array_to_string(list_transform(kept, lambda x: x.id), ',') kept FROM s QUALIFY row_number() OVER (PARTITION BY c ORDER BY i DESC) = 1",
    "stream_lockouts": _LOCKOUTS,
    "stream_memory_triggers": _TRIGGERS,
    "stream_rate_limit": "SELECT 'a' || user_id actor, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') window_start, count(*) n, greatest(count(*) - 2, 0) rejected FROM events GROUP BY user_id, date_trunc('day', ts)",
    "stream_queue": "SELECT event_type, 'ready' state, count(*) n FROM events GROUP BY event_type",
}
