"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a self-join over binary tries."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, with_key
from .graph import components

SHINGLE = 3
SEED = 42
#: Largest number of fingerprints that one trie holds before it is split into pairs of subtries.
TRIE_LIMIT = 4096
#: Pairs of subtries in which a fingerprint of an over-full trie meets others, at most: bounds the bits that it is split by.
MASKS = 512
CHUNK_BYTES = 2 << 20
_PAIRS = 1 << 20


def fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text: A-Z lower-cased, words between ASCII blanks, XXH64 of every run of ``shingle`` words."""
    import xxhash

    digest, sizes, parts = xxhash.xxh64_digest, [], []
    for t in texts:
        w = t.lower().split()
        if len(w) > shingle:
            runs = map(b" ".join, zip(*(w[i:] for i in range(shingle))))
            parts += [digest(r, SEED) for r in runs]
            sizes.append(len(w) - shingle + 1)
        elif w:
            parts.append(digest(b" ".join(w), SEED))
            sizes.append(1)
        else:
            sizes.append(0)
    n = np.array(sizes, np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        bits = np.unpackbits(np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 8), axis=1)
        starts = np.cumsum(n[full]) - n[full]
        counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[full] = np.packbits(counts * 2 > n[full, None], axis=1).view(">u8").ravel()
    return out


def _close(keys: np.ndarray, fps: np.ndarray, budget: int):
    """Pairs (i, j) of places of distinct fingerprints of one key that differ in at most ``budget`` bits, as arrays.

    ``keys`` are sorted and ``fps`` sorted inside each key, so every node of a key's binary
    trie is a range.  Pairs of nodes are traversed together from the roots: each step goes
    one bit down, adds 1 to a pair's differing bits where its sides part, and drops
    the pair beyond the budget.
    """
    n = len(fps)
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if n else np.zeros(0, np.int64)
    ends = np.r_[at[1:], n]
    many = ends - at > 1
    at, ends = at[many], ends[many]
    # (depth, a range, b range, differing bits); a == b: a node with itself
    stack = [(0, at, ends, at.copy(), ends.copy(), np.zeros(len(at), np.int8))] if len(at) else []
    while stack:
        d, al, ah, bl, bh, diff = stack.pop()
        if len(al) > _PAIRS:
            half = len(al) // 2
            stack += [(d, *(x[s] for x in (al, ah, bl, bh, diff))) for s in (slice(half, None), slice(None, half))]
            continue
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():
            i, j = al[single], bl[single]
            near = (i != j) & (np.bitwise_count(fps[i] ^ fps[j]) <= budget)
            yield i[near], j[near]
            al, ah, bl, bh, diff = (x[~single] for x in (al, ah, bl, bh, diff))
        if d == 64 or not len(al):
            continue
        ones = np.r_[0, np.cumsum((fps >> np.uint64(63 - d)) & np.uint64(1))].astype(np.int64)
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        own = al == bl  # ranges of equal depth coincide if they start together
        kids = [(al, am, bl, bm, diff), (am, ah, bm, bh, diff), (al, am, bm, bh, diff + 1)]
        kids.append(tuple(x[~own] for x in (am, ah, bl, bm, diff + 1)))
        al, ah, bl, bh, diff = (np.concatenate(x) for x in zip(*kids))
        on = (ah > al) & (bh > bl) & (diff <= budget)
        stack.append((d + 1, *(x[on] for x in (al, ah, bl, bh, diff))))


def trie_links(keys: np.ndarray, fps: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links of each key's trie, as (fingerprint, least linked one): no pairs are kept."""
    label = np.arange(len(fps))
    for i, j in _close(keys, fps, budget):
        _union(label, i, j)
    label = _flatten(label)
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def trie_pairs(keys: np.ndarray, fps: np.ndarray, budget: int):
    """All pairs (i, j) of rows of one key within the budget, rows of equal fingerprints too, a bounded number at a time."""
    if not len(fps):
        return
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1])])
    size = np.diff(np.r_[first, len(fps)])
    for i, j in _products(first, size, *[np.flatnonzero(size > 1)] * 2):
        yield i[i < j], j[i < j]
    for i, j in _close(keys[first], fps[first], budget):
        yield from _products(first, size, i, j)


def _products(first: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray):
    """Every member of group i[k] with every member of group j[k], for all k, in slices."""
    total = np.r_[0, np.cumsum(size[i] * size[j])]
    for at in range(0, int(total[-1]), _PAIRS):
        flat = np.arange(at, min(at + _PAIRS, int(total[-1])))
        k = np.searchsorted(total, flat, "right") - 1
        left, right = np.divmod(flat - total[k], size[j[k]])
        yield first[i[k]] + left, first[j[k]] + right


def _flatten(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if (up == label).all():
            return label
        label[:] = up


def _union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    while len(i):
        _flatten(label)
        a, b = label[i], label[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(shift, width) of budget + 1 stretches of the 64 bits: fingerprints within the budget agree on one of them."""
    k = budget + 1
    edges = [64 * i // k for i in range(k + 1)]
    return [(64 - b, b - a) for a, b in zip(edges, edges[1:])]


def _masks(budget: int) -> list[int]:
    """Ways in which the split bits of two fingerprints within the budget can differ, by number of split bits; at most MASKS."""
    most = 1
    while most < 40 and sum(comb(most + 1, i) for i in range(min(budget, most + 1) + 1)) <= MASKS:
        most += 1
    return [sum(1 << b for b in bits) for k in range(min(budget, most) + 1) for bits in combinations(range(most), k)]


def tries(rows: DataFrame, budget: int, limit: int = TRIE_LIMIT) -> DataFrame:
    """``rows`` (trie, fp and more), with tries over ``limit`` split by their most balanced bits, in order of trie and fp.

    A trie is split by as many bits as make its subtries about ``limit`` long.  Subtries meet in
    pairs whose split bits are within the budget, so no pair of rows is lost (one may meet
    twice) and none is compared in one place only because a group is large.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = [F.sum(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(64)]
    counts = rows.groupBy("trie").agg(F.count(F.lit(1)).alias("n"), *sums)
    skew = F.array(*(F.struct(F.abs(F.col(f"b{b}") * 2 - F.col("n")).alias("off"), F.lit(b).alias("bit")) for b in range(64)))
    masks = _masks(budget)
    wanted = F.ceil(F.log2(F.col("n") / limit)).cast("int")
    large = counts.where(F.col("n") > limit).select("trie", F.least(wanted, F.lit(max(masks).bit_length())).alias("k"), F.sort_array(skew).alias("skew"))
    large = cut(large.select("trie", F.transform(F.slice("skew", F.lit(1), F.col("k")), lambda s: s["bit"]).alias("bits")))
    if not large.isEmpty():
        own = [c for c in rows.columns if c != "trie"]
        both = rows.join(large, "trie", "left")
        code = F.expr("aggregate(bits, 0L, (acc, b) -> acc * 2 + (shiftrightunsigned(fp, b) & 1L))")
        fits = F.filter(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: m < F.shiftleft(F.lit(1).cast("long"), F.size("bits")))
        split = both.where("bits is not null").withColumn("code", code).withColumn("mask", F.explode(fits))
        other = F.col("code").bitwiseXOR(F.col("mask"))
        split = split.select(F.xxhash64("trie", F.least("code", other), F.greatest("code", other)).alias("trie"), *own)
        rows = both.where("bits is null").select("trie", *own).unionByName(split)
    return rows.repartition(n, "trie").sortWithinPartitions("trie", F.col("fp").bitwiseXOR(F.lit(-(1 << 63))))  # unsigned order


def by_trie(batches, most: int = 50_000):
    """Arrow tables of about ``most`` rows from sorted batches; no trie (first column) is in two of them."""
    held, size, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        if size > most and keys[0] != last:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
        elif size > most and keys[-1] != last:  # where the trie that was begun ends
            end = int(np.flatnonzero(keys != last)[0])
            yield pa.Table.from_batches([*held, batch.slice(0, end)]).combine_chunks()
            held, size, batch = [], 0, batch.slice(end)
        held.append(batch)
        size, last = size + batch.num_rows, keys[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def links(distinct: DataFrame, budget: int, limit: int = TRIE_LIMIT) -> DataFrame:
    """Edges (a, b) of a forest with the components of all pairs of fingerprints (long column fp) within the budget.

    Each fingerprint goes to one trie per stretch of bits.
    """
    rows = None
    for i, (shift, width) in enumerate(_blocks(budget)):
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
        part = distinct.select(F.xxhash64(F.lit(i), value).alias("trie"), "fp")
        rows = part if rows is None else rows.unionByName(part)

    def join(batches):
        for t in by_trie(batches):
            a, b = trie_links(t.column(0).to_numpy(), t.column(1).to_numpy().view(np.uint64), budget)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return tries(rows, budget, limit).select("trie", "fp").mapInArrow(join, "a long, b long")


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE, text: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` without its text, plus the fingerprint as a long."""
    kept = [c for c in docs.columns if c != text]
    d = docs.select(*kept, F.coalesce(docs[text].cast("string"), F.lit("")).alias("_text"))
    col = len(kept)
    schema = docs.select(*kept).withColumn(out, F.lit(0).cast("long")).schema

    def run(batches):
        for b in batches:
            texts = b.column(col).cast(pa.large_binary())
            first = 0
            while first < len(texts):
                last, size, part = first, 0, []
                while last < len(texts) and (last == first or size < CHUNK_BYTES):
                    part.append(texts[last].as_py())
                    size += len(part[-1])
                    last += 1
                cut_ = b.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*cut_.columns[:col], pa.array(fingerprints(part, shingle).view(np.int64))], names=[*kept, out])
                first = last

    return d.mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, budget: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``_key`` (unique), ``fp``, ``component_key`` and ``component_id`` (the least key and id of its group).

    Documents are linked if their fingerprints differ in at most ``budget`` bits; groups
    are the connected components.  Null and blank texts have fingerprint zero and are
    linked like any other.  Equal fingerprints are one node, so a group of exact
    copies costs one.  Null ids are ignored in ``component_id`` unless all are null;
    repeated ids are told apart by ``_key``; an empty table gives an empty one.  Very long texts are read whole, in
    time and memory in proportion to them; other columns are ignored whatever their names.
    """
    d = with_key(docs.select(docs[id_col].alias("doc_id"), docs[text].alias("text")))
    prints = cut(with_fingerprint(d, shingle))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("_key").alias("least_key")))
    roots = components(links(nodes.select("fp"), budget))
    linked = nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "root", "least", "least_key")
    groups = linked.groupBy("root").agg(F.min("least").alias("g"), F.min("least_key").alias("gk"))
    named = linked.join(groups, "root").select(F.col("fp").alias("_fp"), "g", "gk")
    nodes = nodes.join(named, nodes["fp"] == named["_fp"], "left").select("fp", F.coalesce("g", "least").alias("component_id"), F.coalesce("gk", "least_key").alias("component_key"))
    return prints.join(nodes, "fp").select("doc_id", "_key", "fp", "component_key", "component_id")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, budget: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group kept: the one with the least id."""
    key = free_name(docs, "_key")
    d = with_key(docs, id_col, key)
    groups = near_duplicates(d.select(d[key].alias("doc_id"), d[text].alias("text")), shingle, budget)
    others = groups.where("doc_id != component_id").select(F.col("doc_id").alias("_drop"))
    return d.join(others, d[key] == others["_drop"], "left_anti").select(*(d[c] for c in docs.columns))
