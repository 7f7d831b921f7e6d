"""K-d tree sharding: split at weighted medians along the widest metadata dimension until every leaf has its share of bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, running_total

#: Cells of the two histograms that locate a median: along the dimension, then inside the median's cell by hash.
CELLS = 4096


def unit_dimensions(df: DataFrame, numeric: list[str], categorical: list[str]) -> list[Column]:
    """Metadata as numbers from 0 to 1: numeric columns by their extent (null: 0), categorical ones by hash (null: 0)."""
    if numeric:
        row = df.agg(*(f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(numeric) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    dims = []
    for i, c in enumerate(numeric):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        dims.append(F.coalesce((F.col(c).cast("double") - lo) / (hi - lo), F.lit(0.0)) if lo is not None and hi > lo else F.lit(0.0))
    return dims + [F.coalesce(F.crc32(F.col(c).cast("string")) / float(1 << 32), F.lit(0.0)) for c in categorical]


def kd_shards(rows: DataFrame, size: str, tie: str, dims: list[Column], shards: int = 16, out: str = "shard") -> DataFrame:
    """``rows`` with an int column ``out`` from 0 to ``shards`` - 1, sizes near equal.

    Each round splits every node once: its widest dimension (of the node's own extents)
    is found, a histogram of sizes along it locates the cell of the weighted median, and
    a second one, over a hash of the row inside that cell, places the cut between rows
    that tie or lie close, so one value held by a third of all rows still splits evenly.
    All aggregates are partial per task; the driver sees a few numbers per node.
    ``shards`` may be any number: a node of k leaves is cut at ceil(k/2)/k of its size.
    ``rows`` is read several times per level: pass a written table.
    """
    node = free_name(rows, "_node")
    names = [f"_x{i}" for i in range(len(dims))]
    # the hash over the tie column orders rows that share a cell
    d = rows.withColumns(dict(zip(names, dims))).withColumn("_f", F.pmod(F.xxhash64(F.col(tie)), F.lit(1 << 30)) / float(1 << 30)).withColumn(node, F.lit(0))
    leaves = {0: (0, shards)}  # node -> first shard, number of shards
    done: dict[int, int] = {}
    while leaves:
        for k in [k for k, (_, n) in leaves.items() if n == 1]:
            done[k] = leaves.pop(k)[0]
        if not leaves:
            break
        live = d.where(F.col(node).isin(*leaves))
        stats = {r[node]: r for r in live.groupBy(node).agg(*(f(x).alias(n + x) for x in names for n, f in (("lo", F.min), ("hi", F.max)))).collect()}
        cell, plan = F.lit(0), {}
        for k in leaves:
            r = stats.get(k)
            widths = [(r[f"hi{x}"] - r[f"lo{x}"], -i) for i, x in enumerate(names)] if r else []
            if widths and max(widths)[0] > 0:
                i = -max(widths)[1]
                lo, width = r[f"lo{names[i]}"], max(widths)[0]
                plan[k] = F.least(F.floor((F.col(names[i]) - lo) / width * CELLS), F.lit(CELLS - 1))
            else:
                plan[k] = F.lit(0).cast("long")
            cell = F.when(F.col(node) == k, plan[k]).otherwise(cell)
        along = live.withColumn("_cell", cell.cast("int")).groupBy(node, "_cell").agg(F.sum(size).alias("_s"))
        w = Window.partitionBy(node).orderBy("_cell")
        share = F.lit(0.5)
        for k, (_, n) in leaves.items():
            share = F.when(F.col(node) == k, F.lit(-(-n // 2) / n)).otherwise(share)
        along = along.withColumn("_cum", F.sum("_s").over(w)).withColumn("_goal", F.sum("_s").over(Window.partitionBy(node)) * share)
        mid = {r[node]: r for r in along.where("_cum >= _goal").groupBy(node).agg(F.min("_cell").alias("cell"), F.min_by(F.col("_goal") - (F.col("_cum") - F.col("_s")), "_cell").alias("left")).collect()}
        inside = F.lit(False)
        for k in leaves:
            if k in mid:
                inside = inside | ((F.col(node) == k) & (plan[k] == mid[k]["cell"]))
        # within the median's cell: the boundary between hash cells that comes nearest to the goal
        fine = live.where(inside).groupBy(node, F.floor(F.col("_f") * CELLS).alias("_h")).agg(F.sum(size).alias("_s"))
        fine = fine.withColumn("_cum", F.sum("_s").over(Window.partitionBy(node).orderBy("_h")))
        left = F.lit(0.0)
        for k in mid:
            left = F.when(F.col(node) == k, F.lit(float(mid[k]["left"]))).otherwise(left)
        ends = fine.select(node, (F.col("_h") + 1).alias("_cut"), F.abs(F.col("_cum") - left).alias("_off")).unionByName(fine.groupBy(node).agg(F.lit(0).cast("long").alias("_cut"), F.abs(F.max(left)).alias("_off")))
        cuts = {r[node]: r["cut"] for r in ends.groupBy(node).agg(F.min_by("_cut", F.struct("_off", "_cut")).alias("cut")).collect()}
        to, nexts = F.col(node), {}
        for k, (first, n) in leaves.items():
            a, b = 2 * k + 1, 2 * k + 2
            nexts[a], nexts[b] = (first, -(-n // 2)), (first + -(-n // 2), n // 2)
            if k in mid:
                goes_left = (plan[k] < mid[k]["cell"]) | ((plan[k] == mid[k]["cell"]) & (F.floor(F.col("_f") * CELLS) < cuts[k]))
                to = F.when(F.col(node) == k, F.when(goes_left, a).otherwise(b)).otherwise(to)
        d, leaves = cut(d.withColumn(node, to)), nexts
    shard = F.lit(None).cast("int")
    for k, s in done.items():
        shard = F.when(F.col(node) == k, F.lit(s)).otherwise(shard)
    return d.withColumn(out, shard).drop(node, "_f", *names)


def shard_documents(docs: DataFrame, shards: int = 16, text: str = "text") -> DataFrame:
    """Narrow table ``doc_id, size, text_crc32, law, shard, slot, grown_shard``: the law is ``bytes``.

    Size is UTF-8 bytes of the text plus 1 (null text: 1), metadata dimensions are doc_id,
    n_chars, source and lang where those columns exist.  ``slot`` numbers the rows of a
    shard without gaps, in a fixed pseudorandom order.  Equal rows are placed row by row;
    an empty table gives an empty one.  Only the size of a text travels, so a very long one costs no more than
    another; other columns are ignored whatever their names; null ids are placed like any other.
    """
    t = docs[text].cast("string")
    have = {c.lower(): c for c in docs.columns}
    meta = [docs[have[c]].alias(f"_m_{c}") for c in ("n_chars", "source", "lang") if c in have and have[c] != text]
    narrow = docs.select(
        docs["doc_id"], (F.octet_length(F.coalesce(t, F.lit(""))) + 1).cast("long").alias("size"), F.crc32(F.coalesce(t, F.lit(""))).alias("text_crc32"), *meta
    )
    # rows alike in id and text get their own tie value from their place in the table as read
    narrow = cut(narrow.withColumn("_tie", F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id())))
    n = narrow.count()
    numeric = ["doc_id"] + (["_m_n_chars"] if "n_chars" in have else [])
    dims = unit_dimensions(narrow, numeric, [f"_m_{c}" for c in ("source", "lang") if c in have])
    placed = kd_shards(narrow, "size", "_tie", dims, shards)
    placed = running_total(placed.withColumn("_one", F.lit(1)), ["shard"], ["_tie"], "_one", "slot", n)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
