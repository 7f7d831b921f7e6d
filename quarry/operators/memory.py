"""Conversation memory: token estimates, windows, compression split, titles, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_TITLE = "新对话"


def estimate_tokens(text: Column) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 2))).cast("long")


def message_tokens(token_count: Column, text: Column) -> Column:
    """The stored count unless it is null or 0."""
    return F.coalesce(F.when(token_count != 0, token_count), estimate_tokens(text)).cast("long")


def cap_tokens(text: Column, cap: int) -> tuple[Column, Column]:
    """(text cut to the cap, whether it was cut)."""
    if cap <= 0:
        return F.lit(""), F.lit(True)
    fits = estimate_tokens(text) <= cap
    head = F.rtrim(F.substring(text, 1, max(1, cap * 2)))
    return F.when(fits, text).otherwise(F.when(F.length(head) < F.length(text), F.concat(head, F.lit("…"))).otherwise(head)), ~fits


def window_tokens(messages: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Tokens of each conversation's uncompressed messages."""
    return messages.where("not compressed").groupBy(key).agg(F.sum(message_tokens(F.col("token_count"), F.col("content"))).alias("window_tokens"))


def last_rounds(messages: DataFrame, turns: int, key: str, order: list[str]) -> DataFrame:
    """The last ``2 * turns`` messages of each conversation."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    return messages.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 2 * turns).drop("_r")


def compression_split(messages: DataFrame, budget: int, turns: int, key: str, order: list[str]) -> DataFrame:
    """Uncompressed messages with ``action``: none (within budget), compress or retain.

    Over budget, all but the last ``max(1, 2 * turns)`` go; if there are no more than
    that, the older half does.
    """
    keep = max(1, 2 * turns)
    by = Window.partitionBy(key)
    m = messages.where("not compressed").withColumn("_t", F.sum(message_tokens(F.col("token_count"), F.col("content"))).over(by)).withColumn("_n", F.count(F.lit(1)).over(by))
    m = m.withColumn("_i", F.row_number().over(by.orderBy(*order)))
    cut = F.when(F.col("_n") <= keep, F.greatest(F.lit(1), F.floor(F.col("_n") / 2))).otherwise(F.col("_n") - keep)
    return m.withColumn("action", F.when(F.col("_t") <= budget, "none").when(F.col("_i") <= cut, "compress").otherwise("retain")).drop("_t", "_n", "_i")


def latest_summary(summaries: DataFrame) -> DataFrame:
    return summaries.groupBy("conversation_id").agg(F.max("version").alias("version"), F.max_by("content", "version").alias("content"))


def rule_title(message: Column, filename: Column | None = None, most: int = 30) -> Column:
    """First user text on one line, cut; else the file's stem; else the default."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    text = flat(message)
    if filename is not None:
        stem = F.regexp_replace(F.regexp_extract(F.coalesce(filename, F.lit("")), r"[^/]*$", 0), r"(?<=.)\.[^.]*$", "")
        text = F.when(text != "", text).otherwise(flat(stem))
    cut = F.rtrim(F.substring(text, 1, most))
    return F.when(cut == "", F.lit(DEFAULT_TITLE)).otherwise(cut)


def polished_title(raw: Column, most: int = 20) -> Column:
    """A proposed title without quotes, on one line, cut; null if nothing or the default is left."""
    t = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), "^[「」『』\"'“”]+|[「」『』\"'“”]+$", "")
    t = F.rtrim(F.substring(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")), 1, most))
    return F.when((t != "") & (t != DEFAULT_TITLE), t)


def backfill_titles(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Titles of conversations that have the default one, from their first user message."""
    first = messages.where("role = 'user'").groupBy("conversation_id").agg(F.min_by("content", F.struct("created_at", "id")).alias("_c"))
    j = conversations.join(first, "conversation_id", "left")
    return j.withColumn("title", F.when((F.col("title") == DEFAULT_TITLE) & F.col("_c").isNotNull(), rule_title(F.col("_c"))).otherwise(F.col("title"))).drop("_c")


def transcript(messages: DataFrame, key: str, order: str) -> DataFrame:
    """Role-labelled lines of each conversation in order."""
    line = F.concat(F.when(F.col("role") == "user", "用户").otherwise("助手"), F.lit(": "), F.coalesce("content", F.lit("")))
    g = messages.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, line.alias("l")))).alias("_l"))
    return g.select(key, F.array_join(F.transform("_l", lambda x: x["l"]), "\n").alias("transcript"))


def greeting_answer(text: Column, answers: dict[str, str]) -> Column:
    """Canned answer to a greeting (blank and final marks stripped, lower case); null for anything else."""
    key = F.lower(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "[?？!！。.~～ ]+$", ""))
    out = F.lit(None).cast("string")
    for k, v in answers.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def references(hits: DataFrame, key: str) -> DataFrame:
    """Numbered references per question: ``[n] title 第p页`` by rank; the cited text is the child's, the context the parent's."""
    line = F.format_string("[%d] %s 第%d页", F.col("rank"), F.col("title"), F.col("page"))
    g = hits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))).alias("_l"))
    return g.select(key, F.array_join(F.transform("_l", lambda x: x["l"]), "\n").alias("references"))
