import numpy as np

from quarry.llm import graph, neardup


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    cuts = []
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: cuts.append(1) or real(df))
    for path in (list(range(1000)), [*range(0, 400, 2), *range(399, 0, -2)]):
        cuts.clear()
        edges = spark.createDataFrame(list(zip(path, path[1:])), "a long, b long")
        got = graph.components(edges).collect()
        assert sorted(r.node for r in got) == sorted(path) and {r.root for r in got} == {0}
        assert len(cuts) <= 20


def test_no_alike_pair_is_pruned():
    rng = np.random.default_rng(5)
    for n in (5, 40, 900):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.r_[a[: n - n // 10], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)]
        a, b = np.unique(a), np.unique(b)
        assert neardup.alike(a, b)
        about = [(np.zeros(1, np.uint64), np.array([len(h)]), np.minimum(np.bincount((h >> np.uint64(57)).astype(int), minlength=neardup.CELLS), 255).astype(np.uint8)[None]) for h in (a, b)]
        assert neardup.possible(*about, 0).all()
