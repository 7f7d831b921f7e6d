"""Mixing sources to target weights, with DataFrame functions only.

The words of each source form one stream, cut into blocks of fixed length.  Output
shards draw multinomial source counts, the counts are settled so that every source
meets its quota of blocks, each drawn slot is mapped through a pseudorandom
permutation of its source's block indices, and blocks join slots by index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, cut, running_total

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 256
SHARD_SLOTS = 4096
SEED = 11
#: Multipliers of the permutations x -> (a x + b) mod n: primes, so coprime to any n that they don't divide.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII blanks; null: 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{BLANKS}]+")).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """``sources`` (_g, source, words) with ``target``: shares of all words by weight, at most ``cap`` times a source's own.

    Weights repeat in code-point order of the names, null last.  With sources sorted by
    cap over weight those that are capped come first; the level of the others is what
    the capped ones leave, by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("_i", F.row_number().over(by_name) - 1)
    s = s.withColumn("_w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_i") % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("words") * float(cap)).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    before = Window.orderBy("_ratio", "_i").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("words").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    s = s.withColumn("_level", level)
    s = s.withColumn("_level", F.max(F.when(F.col("_ratio") > F.col("_level"), F.col("_level"))).over(every))
    return s.withColumn("target", F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap")))).drop("_w", "_cap", "_ratio", "_level")


def position(x: Column, n: Column, source: Column, epoch: Column, seed: int) -> Column:
    """Where block ``x`` of ``n`` stands in its source's order of this epoch: a permutation, in decimal so that it can't overflow."""
    pick = F.pmod(epoch, F.lit(len(PRIMES))) + 1
    a = F.element_at(F.array(*(F.lit(p) for p in PRIMES)), pick.cast("int"))
    a = F.when(F.pmod(n, a) == 0, F.lit(1)).otherwise(a)
    b = F.pmod(F.xxhash64(F.lit(seed), source, epoch), F.lit(1 << 40))
    wide = x.cast("decimal(20,0)") * a.cast("decimal(11,0)") + b.cast("decimal(14,0)")
    return F.pmod(wide, n.cast("decimal(20,0)")).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED, text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(slots, documents) of the mix.

    ``slots``: source, shard, slot, epoch, index (of the block in the source's stream), words taken of it.
    ``documents``: doc_id, _tie, source, size, source_size, target, taken.
    A source's taken words equal its rounded target: whole passes over the source, then
    the first blocks of one more permutation, the last of them cut.  So no document
    is taken more than ``cap`` times, since targets aren't above ``cap`` times the source.
    Null text has size 0 and is never taken, null source is a source, repeated rows count
    each, an empty table (or one without words) gives no slots.  A very long text is many blocks and is never held as
    one value beyond its row; other columns are ignored whatever their names.
    """
    spark = docs.sparkSession
    name = docs[source].cast("string")
    key = F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), name))
    sized = cut(docs.select("doc_id", name.alias("source"), key.alias("_g"), word_count(docs[text].cast("string")).alias("size"), F.xxhash64("doc_id", docs[text].cast("string")).alias("_tie"), F.monotonically_increasing_id().alias("_n")))
    n_docs = sized.count()
    src = targets(sized.groupBy("_g", "source").agg(F.sum("size").alias("words")), weights, cap)
    blocks = F.ceil(F.col("words") / F.lit(block))
    whole = F.when(F.col("words") > 0, F.expr("cast(round(target) as bigint) div words")).otherwise(F.lit(0))
    src = src.withColumn("blocks", blocks).withColumn("_epochs", whole.cast("long")).withColumn("_rest", (F.round("target") - F.col("_epochs") * F.col("words")).cast("long"))
    # blocks before position p hold p * block words, less what the short last block lacks if it is among them
    short_at = position(F.col("blocks") - 1, F.col("blocks"), F.col("_g"), F.col("_epochs"), seed)
    src = src.withColumn("_lack", F.col("blocks") * block - F.col("words")).withColumn("_short", F.when(F.col("blocks") > 0, short_at))
    naive = F.ceil(F.col("_rest") / F.lit(block))
    more = F.ceil((F.col("_rest") + F.col("_lack")) / F.lit(block))
    src = src.withColumn("_part", F.when(F.col("_rest") <= 0, F.lit(0)).when(F.col("_short") < naive, more).otherwise(naive))
    src = src.withColumn("quota", F.when(F.col("words") > 0, F.col("_epochs") * F.col("blocks") + F.col("_part")).otherwise(F.lit(0)).cast("long"))
    src = cut(src.withColumn("_to", F.sum("quota").over(Window.orderBy("_i"))))
    total = src.agg(F.sum("quota")).first()[0] or 0

    slots = _draw(spark, src, total, shard_slots, seed)
    slots = slots.join(F.broadcast(src.select("_g", "source", "words", "blocks", "_epochs", "_rest", "_lack", "_short")) if src.count() <= 100_000 else src.select("_g", "source", "words", "blocks", "_epochs", "_rest", "_lack", "_short"), "_g")
    slots = slots.withColumn("epoch", F.expr("ordinal div blocks")).withColumn("pos", F.pmod("ordinal", "blocks"))
    before = F.col("pos") * block - F.when(F.col("pos") > F.col("_short"), F.col("_lack")).otherwise(F.lit(0))
    # words of a block that the slot takes: all it has, but for the cut end of the partial pass
    last = F.col("pos") == position(F.col("blocks") - 1, F.col("blocks"), F.col("_g"), F.col("epoch"), seed)
    full = F.when(last, block - F.col("_lack")).otherwise(F.lit(block))
    slots = slots.withColumn("take", F.when(F.col("epoch") < F.col("_epochs"), full).otherwise(F.least(full, F.col("_rest") - before)).cast("long"))

    placed = running_total(sized.where("size > 0"), ["_g"], ["_tie", "_n"], "size", "start", n_docs)
    placed = placed.join(src.select("_g", "blocks", "_epochs", "_part", F.col("words").alias("source_size"), "target"), "_g")
    placed = cut(placed)
    pieces = placed.select("_g", "start", "size", "blocks", "_epochs", "_part", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("index"))
    pieces = pieces.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_epochs"))))
    pieces = pieces.withColumn("pos", position(F.col("index"), F.col("blocks"), F.col("_g"), F.col("epoch"), seed))
    pieces = pieces.where((F.col("epoch") < F.col("_epochs")) | (F.col("pos") < F.col("_part")))
    lo = F.greatest(F.col("start"), F.col("index") * block)
    hi = F.least(F.col("start") + F.col("size"), F.col("index") * block + F.col("take"))
    joined = pieces.join(slots.select("_g", "epoch", "pos", "take"), ["_g", "epoch", "pos"])
    taken = joined.groupBy("_g", "start").agg(F.sum(F.greatest(hi - lo, F.lit(0))).alias("_taken"))
    full_docs = placed.join(taken, ["_g", "start"], "left").select("doc_id", "_tie", "source", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))
    empty = sized.where("size = 0").join(src.select("_g", F.col("words").alias("source_size"), "target"), "_g").select("doc_id", "_tie", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return slots.select("source", "shard", "slot", "epoch", "pos", F.col("take").alias("words")), full_docs.unionByName(empty)


def _draw(spark, src: DataFrame, total: int, shard_slots: int, seed: int) -> DataFrame:
    """One row per slot: _g, ordinal (of the source's slots, gapless), shard, slot.

    Every slot of a shard draws a source with probability quota / total, which makes the
    shard's counts multinomial.  A source that was drawn more often than its quota gives
    its last slots to the sources that were drawn less often.
    """
    cells = max(1, 2 * src.count())
    # the draw finds its source by equal cell of the cumulative quotas, then by bounds
    width = F.lit(float(max(total, 1)))
    lo = (F.col("_to") - F.col("quota")) / width
    hi = F.col("_to") / width
    grid = src.where("quota > 0").select("_g", lo.alias("_lo"), hi.alias("_hi"), F.explode(F.sequence(F.floor(lo * cells), F.least(F.floor(hi * cells), F.lit(cells - 1)))).alias("_cell"))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 52)) / float(1 << 52)
    draws = spark.range(total).select(F.expr(f"id div {shard_slots}").alias("shard"), u.alias("_u")).withColumn("_cell", F.floor(F.col("_u") * cells))
    drawn = draws.join(grid, "_cell").where("_u >= _lo and _u < _hi").groupBy("_g", "shard").count()
    by_shard = Window.partitionBy("_g").orderBy("shard")
    drawn = cut(drawn.withColumn("_before", F.sum("count").over(by_shard) - F.col("count")))
    quota = src.select("_g", "_i", "quota")
    got = drawn.join(quota, "_g").withColumn("_keep", F.greatest(F.lit(0), F.least("count", F.col("quota") - F.col("_before"))))
    kept = got.where("_keep > 0").select("_g", "shard", F.col("_before").alias("_from"), "_keep")
    # surplus slots and missing ones, both numbered, meet by number
    totals = quota.join(drawn.groupBy("_g").agg(F.sum("count").alias("_n")), "_g", "left").na.fill(0, ["_n"])
    over = totals.withColumn("_over", F.greatest(F.lit(0), F.col("_n") - F.col("quota"))).withColumn("_over_at", F.sum("_over").over(Window.orderBy("_i")) - F.col("_over"))
    under = totals.withColumn("_under", F.greatest(F.lit(0), F.col("quota") - F.col("_n"))).withColumn("_under_at", F.sum("_under").over(Window.orderBy("_i")) - F.col("_under"))
    spare = got.where("count > _keep").join(over.select("_g", "_over_at"), "_g")
    first = F.col("_over_at") + F.greatest(F.lit(0), F.col("_before") - F.col("quota"))
    spare = spare.select("shard", F.explode(F.sequence(first, first + F.col("count") - F.col("_keep") - 1)).alias("_k"))
    wanted = under.where("_under > 0").select("_g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_under") - 1)).alias("_j"), "_under_at", F.col("_n").alias("_have")).select("_g", (F.col("_under_at") + F.col("_j")).alias("_k"), (F.col("_have") + F.col("_j")).alias("ordinal"))
    moved = spare.join(wanted, "_k").select("_g", "ordinal", "shard")
    slots = kept.select("_g", F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col("_keep") - 1)).alias("ordinal"), "shard").unionByName(moved)
    return slots.withColumn("slot", F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "_g", "ordinal"), "_g", "ordinal")) - 1)
