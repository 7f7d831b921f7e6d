"""Audit log, pages of rows, log scrubbing, rate limits and lock-outs over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SENSITIVE = ("password", "token", "secret", "authorization", "cookie", "api_key")


def audit_filter(tenant: str | None = None, action: str | None = None, actor: str | None = None, since=None, until=None) -> Column:
    out = F.lit(True)
    for col, value in (("tenant_id", tenant), ("action", action), ("actor", actor)):
        if value:
            out = out & (F.col(col) == value)
    if since is not None:
        out = out & (F.col("created_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        out = out & (F.col("created_at") <= F.lit(until).cast("timestamp"))
    return out


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 500) -> DataFrame:
    """One page: limit 1 to ``most``, offset at least 0."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, most)))


def scrub(detail: Column, keep: int = 80) -> Column:
    """Map values of sensitive keys masked, others cut."""
    bad = lambda k: F.lower(k).rlike("|".join(SENSITIVE))
    return F.transform_values(detail, lambda k, v: F.when(bad(k), F.lit("***")).when(F.length(v) > keep, F.concat(F.substring(v, 1, keep), F.lit("…"))).otherwise(v))


def rate_limited(events: DataFrame, key: str, ts: str, limit: int, window: str = "60 seconds") -> DataFrame:
    """Events per key and fixed window with ``allowed`` and ``rejected`` counts; works on streams too."""
    g = events.groupBy(F.window(ts, window), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("window.start").alias("window_start"), "n", F.least("n", F.lit(limit)).alias("allowed"), F.greatest(F.col("n") - limit, F.lit(0)).alias("rejected"))


def valid_sessions(sessions: DataFrame, now) -> DataFrame:
    return sessions.where(F.col("expires_at") > F.lit(now).cast("timestamp"))


def legal_transitions(log: DataFrame, machine: dict[str, list[str]], key: str, order: str, status: str) -> DataFrame:
    """Log rows with ``legal``: whether the status may follow the one before it (any may come first)."""
    before = F.lag(status).over(Window.partitionBy(key).orderBy(order))
    ok = before.isNull()
    for a, nexts in machine.items():
        ok = ok | ((before == a) & F.col(status).isin(*nexts))
    return log.withColumn("legal", F.coalesce(ok, F.lit(False)))


def latency_summary(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    g = calls.groupBy(*(by or []))
    return g.agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("ok").cast("long")).alias("succeeded"), F.avg("seconds").alias("mean"), F.min("seconds").alias("least"), F.max("seconds").alias("most"))
