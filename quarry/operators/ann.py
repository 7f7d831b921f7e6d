"""Approximate dense search: inverted lists of vectors under k-means centroids, one folder a list, with an exact mode.

The centroids are fitted on a bounded sample; every sound vector is in the list of its nearest centroid.  A search
reads the lists nearest to its queries, so what it reads grows with lists probed and not with the corpus.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .retrieval import CELLS, QUERY_BLOCK, Best, _blocks, _top, sound_vectors, unit_rows

#: Vectors that the centroids are fitted on, lists at most, rounds of k-means.
SAMPLE, MOST_LISTS, ROUNDS = 1 << 16, 4096, 12
#: What an index's number of probes is measured by: sample vectors as queries, their nearest, and the share of those to be found.
ASKED, NEAREST, RECALL = 512, 10, 0.95


def fit_centroids(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """At most ``k`` unit vectors by spherical k-means; each starts far from those before it, and one that loses all its vectors is left out."""
    rng = np.random.default_rng(seed)
    picks, near = [int(rng.integers(len(x)))], np.full(len(x), -1.0)
    while len(picks) < min(k, len(x)):
        near = np.maximum(near, x @ x[picks[-1]])
        far = np.maximum(1 - near, 0) ** 2
        if far.sum() <= 1e-12:
            break
        picks.append(int(rng.choice(len(x), p=far / far.sum())))
    c = x[picks]
    for _ in range(rounds):
        at = nearest(x, c, 1)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = sums[np.bincount(at, minlength=len(c)) > 0]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
    return c


def nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest rows of ``c`` for each row of ``x``, a slice of rows at a time."""
    out, step = [np.zeros((0, min(n, len(c))), np.int64)], max(1, CELLS // len(c))
    for lo in range(0, len(x), step):
        s = -(x[lo : lo + step] @ c.T)
        out.append(np.argmin(s, axis=1)[:, None] if n == 1 else np.argsort(s, axis=1, kind="stable")[:, :n])
    return np.concatenate(out)


def probes_for(x: np.ndarray, c: np.ndarray, share: float = RECALL) -> int:
    """Lists that a query must probe to find ``share`` of its nearest, as measured on the sample.

    The nearest of a sample lie farther than those of the whole, so that this errs on the side of more lists.
    """
    if len(x) < 2:
        return 1
    q = x[:: max(1, len(x) // ASKED)][:ASKED]
    s = q @ x.T
    s[s >= 1 - 1e-12] = -np.inf  # the query itself
    near = np.argsort(-s, axis=1, kind="stable")[:, : min(NEAREST, len(x) - 1)]
    place = np.argsort(nearest(q, c, len(c)), axis=1)  # of each list in the query's order
    return int(np.quantile(np.take_along_axis(place, nearest(x, c, 1)[:, 0][near], 1), share, method="higher")) + 1


def build(chunks: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE) -> None:
    """Write the index of chunks (id, vector) to ``path``: ``vectors`` by list, and ``lists``, which is written last.

    There are ``lists`` lists, by default the square root of the number of vectors (MOST_LISTS at most).  The sample is about ``sample``
    vectors, those with the least hashes.  Lists are balanced by the engine as they are written: a list that
    holds a third of all rows goes into many files.

    Defined cases: vectors that aren't sound, or not of the commonest length, are not indexed; repeated rows and ids are
    chunks of their own; zero vectors are in some list; an empty table gives an index that finds nothing.
    """
    spark = chunks.sparkSession
    held = chunks.select("id", sound_vectors(chunks).alias("v")).where("v is not null")
    sizes = held.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    width, rows = (sizes["w"], sizes["count"]) if sizes else (1, 0)
    held = held.where(F.size("v") == width)
    share = min(1.0, sample / max(1, rows))
    some = held.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("v").limit(2 * sample).toArrow()["v"]
    x = np.concatenate([np.zeros((0, width)), *(unit_rows(c, width) for c in some.chunks)])
    k = min(MOST_LISTS, lists or max(1, round(rows**0.5)))
    x = x[np.lexsort(x.T)]
    sent = spark.sparkContext.broadcast(fit_centroids(x, k) if len(x) else np.zeros((1, width)))

    def assign(batches):
        for b in batches:
            at = nearest(unit_rows(b.column(1), width), sent.value, 1)[:, 0].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=["id", "v", "list"])

    kind = chunks.schema["id"].dataType.simpleString()
    placed = held.mapInArrow(assign, f"id {kind}, v array<double>, list int")
    placed.hint("rebalance", F.col("list")).write.partitionBy("list").parquet(f"{path}/vectors")
    columns = F.lit(placed.schema.json()).alias("columns")
    each = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(sent.value)], "list int, centroid array<double>")
    each.select("*", F.lit(probes_for(x, sent.value)).alias("probes"), columns).coalesce(1).write.parquet(f"{path}/lists")


def search(spark: SparkSession, path: str, queries: DataFrame, n: int, probes: int | None = 0, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, id, score, rank of ``n`` near chunks by cosine per query (query_id, vector): the best of the ``probes`` nearest lists.

    By default that is the number that the index was measured to need (``probes_for``).  With ``probes=None`` all lists are read and the result is that of ``dense_top``.  Only the folders of lists that some query of a
    block probes are read, and a list's vectors meet only the queries that probe it.  Queries are a stated set, sent in
    blocks; odd vectors and ids, and several vectors of one query id, are handled as in ``dense_top``.
    """
    rows = spark.read.parquet(f"{path}/lists").orderBy("list").collect()  # MOST_LISTS at most
    c = np.array([r.centroid for r in rows])
    columns = StructType.fromJson(json.loads(rows[0].columns))
    vectors = spark.read.schema(columns).parquet(f"{path}/vectors")
    of, width = queries.schema["query_id"].dataType, c.shape[1]
    schema = f"query_id {of.simpleString()}, id {columns['id'].dataType.simpleString()}, score double"
    asked = queries.select("query_id", sound_vectors(queries).alias("v")).where(F.size("v") == width).orderBy("query_id")
    probes = rows[0].probes if probes == 0 else probes
    out = None

    def scan(part):
        q = np.array([r.v for r in part])
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        near = nearest(q, c, probes or len(c))
        by_list = {int(at): np.flatnonzero((near == at).any(axis=1)) for at in np.unique(near)}
        sent = spark.sparkContext.broadcast((q, by_list, pa.array([r.query_id for r in part], to_arrow_type(of))))

        def run(batches):
            q, by_list, names = sent.value
            best = Best(len(q), n)
            for b in batches:
                at = b.column(2).to_numpy()
                cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else []
                for lo, hi in zip(cuts, [*cuts[1:], len(at)]):
                    which = by_list[int(at[lo])]
                    for k in range(lo, hi, step := max(1, CELLS // len(which))):
                        some = b.slice(k, min(step, hi - k))
                        best.add(unit_rows(some.column(1), width) @ q[which].T, some.column(0), -np.inf, which)
            yield from best.rows(names)

        return vectors.where(F.col("list").isin(list(by_list))).select("id", "v", "list").mapInArrow(run, schema)

    for part in _blocks(asked.toLocalIterator(), block, lambda r: width):
        found = scan(part)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    return _top(out.groupBy("query_id", "id").agg(F.max("score").alias("score")), n)


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """One row: queries of ``true``, pairs (query_id, id) of it, and the share of them that ``found`` has."""
    hit = true.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("pairs"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))
