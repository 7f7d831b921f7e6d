"""Near-duplicates by Jaccard similarity of word shingles: SimHash tries find the pairs, the texts decide.

Sets of five-word shingles with a similarity of 0.8 have SimHashes that differ in up to
22 of 64 bits.  Stretches of bits that such fingerprints must agree on would be of three
bits, and every trie a large part of the corpus.  So the tries are keyed by bands of least
hashes of the same shingles instead; inside a trie, node pairs are traversed with the
wide budget.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import byte_slices, cut, free_name, release, text_of, with_key
from .graph import components

SHINGLE = 5
SEED = 42
#: Least hashes of one band, and bands: sets of similarity s share a band with probability 1 - (1 - s^ROWS)^BANDS (0.8: 0.998).
ROWS, BANDS = 6, 20
#: Bits by which SimHashes of sets of similarity 0.8 differ at most: 10 on average, and four standard deviations more.
BUDGET = 22
#: Cells of the histogram of a set's hashes by their first bits; counts stop at 255, which only lets more pairs through.
CELLS = 128


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of the runs of ``shingle`` words; a shorter text is one run, a blank one has none."""
    import xxhash

    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) > shingle else [b" ".join(w)]
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(r, SEED) for r in runs]), ">u8").astype(np.uint64))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of at least 0.8: nine times the common part is at least four times both sizes."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def sketch(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the set, SimHash of its members, hash of each band) of every set; empty sets have no bands' worth of hashes."""
    import xxhash

    node = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64)
    sizes = np.array([len(h) for h in sets], np.int64)
    full = np.flatnonzero(sizes)
    fp, bands = np.zeros(len(sets), np.uint64), np.zeros((len(sets), BANDS), np.uint64)
    if len(full):
        n = sizes[full]
        every, starts = np.concatenate(sets), np.cumsum(n) - n
        bits = np.unpackbits(every.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        fp[full] = np.packbits(np.add.reduceat(bits, starts, axis=0, dtype=np.int32) * 2 > n[:, None], axis=1).view(">u8").ravel()
        odd = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for b in range(BANDS):
            got = np.full(len(full), np.uint64(b + 1))
            for r in range(ROWS):
                low = np.minimum.reduceat(every * odd[b, r], starts)
                got = (got ^ low) * np.uint64(0x9E3779B97F4A7C15)
                got ^= got >> np.uint64(32)
            bands[full, b] = got
    return node, fp, bands


def possible(i: tuple, j: tuple, budget: int) -> np.ndarray:
    """Which pairs of (fp, n, cells) can be alike: sizes and SimHashes are near, and so are the histograms.

    Two histograms differ by no more than their sets do, which is a ninth of both sizes at similarity 0.8.
    """
    (fa, na, ca), (fb, nb, cb) = i, j
    on = (np.bitwise_count(fa ^ fb) <= budget) & (5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb))
    at = np.flatnonzero(on)
    for lo in range(0, len(at), 1 << 15):
        k = at[lo : lo + (1 << 15)]
        on[k] = 9 * np.abs(ca[k].astype(np.int16) - cb[k]).sum(axis=1, dtype=np.int64) <= na[k].astype(np.int64) + nb[k]
    return on


def _cells(column) -> np.ndarray:
    """A column of histograms (binary, each of CELLS bytes) as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CELLS)


def _sketches(d: DataFrame, key: str) -> DataFrame:
    """key, node (hash of the shingle set), n (its size), fp, cells (histogram), bands of every document."""

    def run(batches):
        for batch in batches:
            for b in byte_slices(batch, 1, 2 << 20):
                sets = [shingles(t.as_py()) for t in b.column(1).cast(pa.large_binary())]
                node, fp, bands = sketch(sets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel().view(np.int64)))
                cells = [np.minimum(np.bincount((h >> np.uint64(57)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes() for h in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node.view(np.int64)), pa.array([len(h) for h in sets], pa.int32()), pa.array(fp.view(np.int64)), pa.array(cells, pa.binary()), lists], names=["key", "node", "n", "fp", "cells", "bands"])

    return cut(d.select(F.col(key).alias("key"), text_of(d).alias("text")).mapInArrow(run, "key long, node long, n int, fp long, cells binary, bands array<long>"))


def _possible(pairs: DataFrame, about: DataFrame, budget: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that can be alike by what ``about`` says of both."""
    side = lambda to: about.select(F.col("node").alias(to), *(F.col(c).alias(c + to) for c in ("fp", "n", "cells")))
    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def run(batches):
        for t in batches:
            side = lambda k: (t.column(k).to_numpy().view(np.uint64), t.column(k + 1).to_numpy(), _cells(t.column(k + 2)))
            if t.num_rows:
                yield t.select([0, 1]).filter(pa.array(possible(side(2), side(5), budget)))

    return both.select("a", "b", "fpa", "na", "cellsa", "fpb", "nb", "cellsb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, nodes: DataFrame, d: DataFrame, key: str) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are alike, by the texts themselves."""
    ids = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    some = nodes.select("node", "least").join(ids, "node", "left_semi")
    texts = cut(d.select(F.col(key).alias("least"), text_of(d).alias("text")).join(some, "least").select("node", "text"))
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")

    def run(batches):
        at, own = None, None  # pairs of one a mostly follow each other
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            x, y, keep = x.cast(pa.large_binary()), y.cast(pa.large_binary()), []
            for i, node in enumerate(a.to_pylist()):
                if node != at:
                    at, own = node, shingles(x[i].as_py())
                keep.append(alike(own, shingles(y[i].as_py())))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = cut(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))
    release(d.sparkSession)
    return found


def _apart(rows: DataFrame, budget: int) -> DataFrame:
    """All pairs (a, b) of one trie that can be alike and whose labels differ; rows: trie, fp, n, cells, node, label."""

    def run(batches):
        for t in simhash.by_trie(batches):
            trie, fp, n, _, node, label = (t.column(i).to_numpy() if i != 3 else None for i in range(6))
            fp, cells = fp.view(np.uint64), _cells(t.column(3))
            for i, j in simhash.trie_pairs(trie, fp, budget):
                other = label[i] != label[j]
                i, j = i[other], j[other]
                on = possible((fp[i], n[i], cells[i]), (fp[j], n[j], cells[j]), budget)
                if on.any():
                    p = np.unique(np.sort(np.stack([node[i[on]], node[j[on]]], axis=1), axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    return simhash.tries(rows, budget, simhash.TRIE_LIMIT).select("trie", "fp", "n", "cells", "node", "label").mapInArrow(run, "a long, b long").distinct()


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """``docs`` with one document of each group kept: the one with the least id.

    Groups are the connected components of the pairs whose sets of five-word shingles have a
    Jaccard similarity of 0.8 or more, of those that meet in a trie: all but a few in a
    thousand.  No pair is taken that is less alike.  Documents of equal sets are one node.
    Nodes of a band are first compared with that of them which shares most bands with others;
    only those that stay apart from others of their band then meet in the band's trie, and
    only pairs that SimHash, sizes and histograms let through are written, so a large
    group of near copies costs about its size.  Null and blank texts are one group; repeated and null ids are told
    apart by a key of their own; an empty table gives an empty one.
    """
    key = free_name(docs, "_key")
    d = with_key(docs, id_col, key)
    named = d.select(d[key], d[text].alias("text"))
    prints = _sketches(named, key)
    nodes = cut(prints.groupBy("node").agg(F.min("key").alias("least"), *(F.first(c).alias(c) for c in ("n", "fp", "cells", "bands"))))
    rows = nodes.where("n > 0").select(F.explode("bands").alias("trie"), "node")
    shared = cut(rows.join(rows.groupBy("trie").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "trie"))
    release(docs.sparkSession)
    weight = shared.groupBy("node").agg(F.sum("c").alias("w"))
    heads = shared.join(weight, "node").groupBy("trie").agg(F.max(F.struct("w", "node"))["node"].alias("h"))
    stars = shared.join(heads, "trie").where("node != h").select(F.least("node", "h").alias("a"), F.greatest("node", "h").alias("b")).distinct()
    about = nodes.select("node", "fp", "n", "cells")
    stars = cut(_possible(stars, about, budget))
    edges = _verified(stars, nodes, named, key)
    roots = components(edges)
    labelled = shared.join(roots, "node", "left").select("trie", "node", F.coalesce("root", "node").alias("label"))
    split = labelled.groupBy("trie").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("trie")
    apart = cut(labelled.join(split, "trie").join(about, "node").select("trie", "fp", "n", "cells", "node", "label"))
    pairs = cut(_apart(apart, budget).join(stars, ["a", "b"], "left_anti"))
    roots = components(edges.unionByName(_verified(pairs, nodes, named, key)))
    groups = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("g"))
    keep = groups.groupBy("g").agg(F.min("least").alias("_keep"))
    drop = prints.select("key", "node").join(groups.join(keep, "g").select("node", "_keep"), "node").where("key != _keep").select(F.col("key").alias("_drop"))
    return d.join(drop, d[key] == drop["_drop"], "left_anti").select(*(d[c] for c in docs.columns))
