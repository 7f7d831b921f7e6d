"""URL filter: host/path rules, then a blocked Bloom filter in front of an exact hash join with the listed URLs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free_name

#: Upper bound of the broadcast filter; a longer list only raises its false-positive rate, which the exact join undoes.
MAX_FILTER_BYTES = 16 << 20
BITS_PER_URL = 16
BLOCK_WORDS = 4  # 64-bit words: a probe touches one block of 256 bits
PROBES = 6


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return _with(url, lambda u: F.when(F.instr(u, "://") > 0, ascii_lower(F.regexp_extract(_after(u), r"^[^/?#]*", 0))).otherwise(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return _with(url, lambda u: F.when(F.instr(u, "://") > 0, F.regexp_extract(_after(u), r"^[^/?#]*([^?#]*)", 1)).otherwise(""))


def _with(url: Column, f) -> Column:
    return f(F.coalesce(url, F.lit("")))


def _after(u: Column) -> Column:
    return F.substring(u, F.instr(u, "://") + F.lit(3), F.length(u))


def rule_column(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (null: none) and its verdict; ``rules`` are (``host/path`` prefix, allow or block)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest ends up outermost
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _masks(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each 64-bit hash, and the bits it sets in each of the block's words."""
    h = h.astype(np.uint64)
    block = ((h >> np.uint64(40)) % np.uint64(blocks)).astype(np.int64)
    masks = np.zeros((len(h), BLOCK_WORDS), np.uint64)
    g = h * np.uint64(0x9E3779B97F4A7C15)
    rows = np.arange(len(h))
    for k in range(PROBES):
        bit = (g >> np.uint64(8 * k)) & np.uint64(64 * BLOCK_WORDS - 1)
        masks[rows, (bit >> np.uint64(6)).astype(np.int64)] |= np.uint64(1) << (bit & np.uint64(63))
    return block, masks


def build_filter(listed: DataFrame, hash_col: str) -> np.ndarray:
    """A blocked Bloom filter of the hashes: partial filters per partition, OR-ed by block, bounded by MAX_FILTER_BYTES."""
    n = listed.count()
    blocks = max(1, min(-(-n * BITS_PER_URL // (64 * BLOCK_WORDS)), MAX_FILTER_BYTES // (8 * BLOCK_WORDS)))

    def partial(batches):
        for b in batches:
            block, masks = _masks(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), blocks)
            order = np.argsort(block, kind="stable")
            block, masks = block[order], masks[order]
            if len(block):
                at = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
                merged = np.bitwise_or.reduceat(masks, at, axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(block[at]), *(pa.array(merged[:, i]) for i in range(BLOCK_WORDS))], names=["block", *(f"w{i}" for i in range(BLOCK_WORDS))])

    words = ", ".join(f"w{i} long" for i in range(BLOCK_WORDS))
    merged = listed.select(hash_col).mapInArrow(partial, f"block long, {words}").groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(BLOCK_WORDS)))
    table = np.zeros((blocks, BLOCK_WORDS), np.uint64)
    got = merged.toArrow()
    table[got["block"].to_numpy()] = np.stack([got[f"w{i}"].to_numpy() for i in range(BLOCK_WORDS)], axis=1).view(np.uint64)
    return table


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], url: str = "url", listed_url: str = "url") -> DataFrame:
    """``pages`` with a struct column ``judged``: host, path, canonical, rule, listed (boolean) and verdict.

    The canonical URL is host + path (no scheme, query or fragment).  A rule decides
    where one fits; else a listed canonical URL is blocked and any other allowed.
    Null URLs and those without ``://`` have empty host and path, no rule, and are
    allowed.  Repeated rows are judged alike; an empty list allows all; an empty table stays empty.  URLs of any
    length are read whole; a column named ``judged`` gets an underscore beside it.
    """
    spark = pages.sparkSession
    out, may, hit = free_name(pages, "judged"), free_name(pages, "_may"), free_name(pages, "_hit")
    of = lambda c: F.when(F.instr(c, "://") > 0, F.concat(host_of(c), path_of(c)))
    known = listed.select(of(listed[listed_url]).alias("_canonical")).where("_canonical is not null").distinct().withColumn("_h", F.xxhash64("_canonical"))
    table = spark.sparkContext.broadcast(build_filter(known, "_h"))

    @F.pandas_udf("boolean")
    def maybe_listed(h):
        import pandas as pd

        bits = table.value
        block, masks = _masks(h.fillna(0).to_numpy(np.int64).view(np.uint64), len(bits))
        return pd.Series(((bits[block] & masks) == masks).all(axis=1) & h.notna().to_numpy())

    rule, says = rule_column(host_of(pages[url]), path_of(pages[url]), rules)
    base = pages.withColumn(out, F.struct(host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"), of(pages[url]).alias("canonical"), rule.alias("rule"), says.alias("says")))
    base = base.withColumn(may, maybe_listed(F.xxhash64(F.col(out)["canonical"])) & F.col(out)["canonical"].isNotNull())
    # rows that cannot be listed skip the join; the exact join removes the filter's false positives
    tested = base.where(F.col(may)).join(known.select("_canonical", F.lit(True).alias(hit)), F.col(out)["canonical"] == F.col("_canonical"), "left").drop("_canonical")
    every = tested.unionByName(base.where(~F.col(may)).withColumn(hit, F.lit(False)))
    is_listed = F.coalesce(F.col(hit), F.lit(False))
    verdict = F.coalesce(F.col(out)["says"], F.when(is_listed, "block").otherwise("allow"))
    return every.withColumn(out, F.struct(*(F.col(out)[c].alias(c) for c in ("host", "path", "canonical", "rule")), is_listed.alias("listed"), verdict.alias("verdict"))).drop(may, hit)
