import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import mixing, quality, simhash
from tests.llm.test_small import naive_groups, naive_hits, naive_print


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    d = str(tmp_path_factory.mktemp("pipeline"))
    say = lambda n: " ".join(rng.choice(["tree", "river", "stone", "bird", "cloud", "field", "house", "light"]) + rng.choice("abcdefgh") for _ in range(n))
    items = [(i, say(14)) for i in range(4)]
    rows = []
    for i in range(150):
        t = "\n".join(say(12) + "." for _ in range(rng.randint(1, 6)))
        if i % 4 == 0:
            t = "\n".join("!! ".join(w.upper() for w in say(10).split()) + "!!" for _ in range(3))
        if i % 10 == 3:
            t += "\n" + items[i % 4][1]
        rows.append((i, t, "en", f"s{i % 5}", len(t)))
    rows += [(200 + i, *rows[i][1:]) for i in (1, 2, 5, 5)] + [(300, None, None, None, None), (301, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, items


def test_stages_do_what_they_say(spark, folder, tmp_path):
    d, items = folder
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{i}")
        kept.append(docs.collect())
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert i == 4 or docs.columns == columns
    kept.append(docs.collect())
    ids = lambda rows: sorted(r.doc_id for r in rows)

    model = quality.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    x, per, size = quality.line_features([(r.text or "").encode() for r in kept[0]])
    score = model.documents(model.marginals(quality.chain_features(x, per), per)[0], per, size)
    assert ids(kept[1]) == sorted(r.doc_id for r, s in zip(kept[0], score) if s >= 0.5)
    held = [r for r in kept[0] if r.doc_id < 150 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert {r.doc_id for r in held} & {r.doc_id for r in kept[1]} == {r.doc_id for r in held if r.doc_id % 4}

    rows = sorted(kept[1], key=lambda r: r.doc_id)
    roots = naive_groups([naive_print(r.text) for r in rows], 2)
    assert ids(kept[2]) == [rows[i].doc_id for i in sorted(set(roots))] or len(kept[2]) == len(set(roots))

    assert ids(kept[3]) == sorted(r.doc_id for r in kept[2] if not naive_hits(r.text, items)[1])

    taken = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(kept[3], docs_schema(spark, d)))[1].collect()}
    times = {}
    for r in kept[4]:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    for k, r in taken.items():
        whole = r.taken // max(r.size, 1)
        assert times.get(k, 0) in (whole, whole + 1) and (times.get(k, 0) == whole or r.taken > whole * r.size)

    assert ids(kept[5]) == ids(kept[4]) and {r.size for r in kept[5]} == {len((r.text or "").encode()) + 1 for r in kept[4]}
    assert corpus_pipeline.run(spark, d).groupBy("shard").count().count() <= 16


def docs_schema(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").schema


def test_empty_documents_run_through(spark, folder):
    d, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, d).count() == 0
    assert simhash.deduplicate(docs).columns == docs.columns and F is not None
