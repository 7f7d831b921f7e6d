"""BM25 and dense search against brute force, odd ids and vectors, and the persistent inverted index."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import inverted, retrieval
from quarry.operators.shared import shared_folder


def _brute(chunks, queries, n, k1=1.2, b=0.75):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    docs = [(i, words(t)) for i, t in chunks]
    avg = sum(len(w) for _, w in docs) / len(docs)
    df = Counter(w for _, ws in docs for w in set(ws))
    asked = defaultdict(Counter)
    for q, t in queries:
        asked[q].update(words(t))
    out = []
    for q, ws in asked.items():
        scored = []
        for i, d in docs:
            tf = Counter(d)
            s = sum(c * math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(d) / avg)) for w, c in ws.items() if tf[w])
            if s > 0:
                scored.append((round(s, 9), i))
        out += [(q, i, k + 1, round(s, 6)) for k, (s, i) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:n])]
    return sorted(out, key=repr)


def _texts(n=700, seed=4):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    pick = lambda: vocab[min(int(rng.paretovariate(0.7)) - 1, 299)]
    rows = [(i, " ".join(pick() for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "W1 w2, W1!")]


QUERIES = [(1, "w1 w7 w250"), (2, "w3 w3 nothing"), (3, None), (4, "w120"), (None, "w5 w6"), (1, "w9"), (5, " ".join(f"w{i}" for i in range(40)))]


def _rows(df):
    return sorted(((r.query_id, r.id, r["rank"], round(r.score, 6)) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = _texts()
    return rows, spark.createDataFrame(rows, "id long, text string").repartition(4).cache()


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_bm25_against_brute_force(spark, corpus, block, monkeypatch):
    monkeypatch.setattr(retrieval, "CELLS", 50 if block == 3 else 1 << 20)
    rows, chunks = corpus
    q = spark.createDataFrame(QUERIES, "query_id long, text string")
    assert _rows(retrieval.bm25_top(chunks, q, 7, block=block)) == _brute(rows, QUERIES, 7)


def test_bm25_of_text_ids_and_empty_sides(spark):
    c = spark.createDataFrame([("a", "red fox"), ("b", "red red hen"), (None, "grey hen")], "id string, text string")
    q = spark.createDataFrame([("x", "red"), ("y", "hen fox")], "query_id string, text string")
    got = retrieval.bm25_top(c, q, 2).collect()
    assert {(r.query_id, r.id) for r in got} == {("x", "a"), ("x", "b"), ("y", "a"), ("y", None)}
    assert retrieval.bm25_top(c.limit(0), q, 2).collect() == [] and retrieval.bm25_top(c, q.limit(0), 2).collect() == []
    assert retrieval.bm25_top(c, q, 2).schema["query_id"].dataType.simpleString() == "string"


def test_dense_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [1.0, 1.0]), ("d", None), ("e", []), ("f", [1.0]), ("g", [nan, 1.0]), ("h", [None, 1.0]), ("i", [inf, 0.0]), ("j", [0.0, 0.0]), ("k", [1.0, 2.0, 3.0])]
    c = spark.createDataFrame(rows, "id string, vector array<double>")
    q = spark.createDataFrame([("p", [1.0, 0.0]), ("p", [0.0, 1.0]), ("q", [1.0, 1.0, 1.0]), ("r", [nan, 0.0]), ("s", None)], "query_id string, vector array<double>")
    got = defaultdict(list)
    for r in sorted(retrieval.dense_top(c, q, 10).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.id, round(r.score, 6)))
    assert got == {"p": [("a", 1.0), ("b", 1.0), ("c", 0.707107), ("j", 0.0)], "q": [("k", round(6 / math.sqrt(42), 6))]}
    assert retrieval.dense_top(c.limit(0), q, 3).collect() == [] and retrieval.dense_top(c, q.limit(0), 3).collect() == []


def test_dense_ties_at_the_edge_go_to_the_least_ids(spark):
    c = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50, 0, -1)], "id long, vector array<double>").repartition(3)
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    assert [r.id for r in retrieval.dense_top(c, q, 4).orderBy("rank").collect()] == [1, 2, 3, 4]


@pytest.fixture(scope="module")
def index(spark, corpus):
    path = shared_folder(spark, "inverted")
    inverted.build(corpus[1], path, size=16, buckets=8)
    return path


@pytest.mark.parametrize("first", [1, 4])
def test_index_search_is_exact(spark, corpus, index, first):
    q = spark.createDataFrame(QUERIES, "query_id long, text string")
    assert _rows(inverted.search(spark, index, q, 7, first=first)) == _brute(corpus[0], QUERIES, 7)
    assert inverted.search(spark, index, q.limit(0), 7).collect() == []


def test_index_has_every_posting_once_in_blocks_with_true_bounds(spark, corpus, index):
    rows = inverted.postings(spark, index).collect()
    got = Counter((r.term, i) for r in rows for i in r.ids)
    assert got == Counter((w, i) for i, t in corpus[0] for w in set(re.findall(r"\w+", (t or "").lower())))
    assert all(r.best == max(r.impacts) and len(r.ids) <= 16 and len(set(r.slots)) == len(r.slots) for r in rows)
    assert {r.term: r.df for r in inverted.terms(spark, index).collect()} == Counter(w for w, _ in got)


def test_bounds_skip_blocks_and_files(spark, corpus, index):
    q = spark.createDataFrame([(1, "w250 w1")], "query_id long, text string")
    sought, where = inverted._sought(spark, index, q)
    bounds = inverted.block_bounds(inverted.postings(spark, index), sought, where).collect()
    edge = min(r.score for r in inverted.search(spark, index, q, 3).collect())
    assert sum(b.bound >= edge for b in bounds) < len(bounds) / 2
    plan = inverted.postings(spark, index).where(where)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term" in plan


def test_index_of_repeated_ids_and_of_nothing(spark):
    rows = [("a", "x y"), ("a", "x y"), ("b", "y"), (None, "x")]
    path = shared_folder(spark, "inverted")
    inverted.build(spark.createDataFrame(rows, "id string, text string"), path, size=2, buckets=3)
    q = spark.createDataFrame([("q", "x y")], "query_id string, text string")
    assert [r.id for r in inverted.search(spark, path, q, 9).orderBy("rank").collect()] == [r.id for r in retrieval.bm25_top(spark.createDataFrame(rows, "id string, text string"), q, 9).orderBy("rank").collect()]
    empty = shared_folder(spark, "inverted")
    inverted.build(spark.createDataFrame([], "id long, text string"), empty)
    assert inverted.search(spark, empty, q, 9).collect() == [] and inverted.terms(spark, empty).count() == 0
    with pytest.raises(Exception, match="(?i)already exists"):
        inverted.build(spark.createDataFrame([], "id long, text string"), empty)


def test_worker_code_keeps_numbers_whole(spark):
    best = retrieval.Best(2, 2)
    import pyarrow as pa

    best.add(np.array([[1.0, 0.5], [2.0, 0.5], [3.0, 0.5]]), pa.array([7, 8, 9]), 0.0)
    best.add(np.array([[2.5, 0.5]]), pa.array([1]), 0.0)
    got = [b.to_pydict() for b in best.rows(pa.array(["p", "q"]))]
    assert sorted(got[0]["id"]) == [1, 9] and sorted(got[1]["id"]) == [1, 7]
