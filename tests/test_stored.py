"""The vector index, the object store, decisions, published versions, queue replay, payloads, keyed state."""

import glob
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import payloads
from quarry.operators import access, ann, decisions, retrieval
from quarry.operators.shared import shared_folder
from quarry.sources import objects
from quarry.streaming import jobs, state

# --- vectors


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 2
    x = centres[rng.integers(12, size=900)] + rng.normal(size=(900, 16))
    x[:300] = x[0] + rng.normal(size=(300, 16)) * 0.01  # a list with a third of all rows
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [1.0]), (1002, [float("nan")] * 16), (1003, [0.0] * 16)]
    return spark.createDataFrame(rows, "id long, vector array<double>").repartition(4).cache()


@pytest.fixture(scope="module")
def vector_index(spark, vectors):
    path = shared_folder(spark, "vectors")
    ann.build(vectors, path)
    return path


def test_index_covers_every_sound_row_and_recall_holds(spark, vectors, vector_index):
    held = spark.read.parquet(f"{vector_index}/vectors")
    assert sorted(r.id for r in held.select("id").collect()) == [*range(900), 1003]
    q = vectors.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    exact = retrieval.dense_top(vectors.where("size(vector) = 16"), q, 10)
    assert ann.recall(ann.search(spark, vector_index, q, 10), exact).first().recall >= 0.9
    full = ann.search(spark, vector_index, q, 10, probes=None)
    key = lambda d: sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in d.collect())
    assert key(full) == key(exact)


def test_only_probed_lists_are_read(spark, vectors, vector_index):
    q = vectors.where("id = 500").select(F.col("id").alias("query_id"), "vector")
    plan = ann.search(spark, vector_index, q, 3, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "list" in plan.split("PartitionFilters: [")[1].split("]")[0]
    empty = shared_folder(spark, "vectors")
    ann.build(vectors.limit(0), empty)
    assert ann.search(spark, empty, q, 3).collect() == [] and ann.search(spark, vector_index, q.limit(0), 3).collect() == []


# --- files


def _files(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, version_id string, kind string, name string, content binary")


def test_store_and_read_with_pushed_conditions(spark, tmp_path):
    rows = [(f"d{i % 3}", f"v{i % 2}", "file", f"a/b c{i}.txt", b"x" * i) for i in range(12)] + [("d0", "v0", "image", "p.PNG", b"pic"), ("d0", "v0", "table", "t 1", b"{}"), ("d1", "v9", "file", "none", None)]
    objects.store(_files(spark, rows).repartition(4), str(tmp_path))
    got = objects.stored(spark, str(tmp_path))
    assert got.count() == 15 and not os.path.exists(f"{tmp_path}/.staging") or os.listdir(f"{tmp_path}/.staging") == []
    some = got.where("doc_id = 'd0' and version_id in ('v0', 'v7') and kind != 'image'")
    assert sorted((r.kind, r.name) for r in some.collect()) == [("file", "b_c0.txt"), ("file", "b_c6.txt"), ("table", "t_1.json")]
    reader = objects._Reader(str(tmp_path))
    from pyspark.sql.datasource import EqualTo, In, StringContains

    left = list(reader.pushFilters([EqualTo(("doc_id",), "d0"), In(("version_id",), ("v0", "../d1")), StringContains(("name",), "x")]))
    assert len(left) == 1 and [(p.doc_id, p.version_id) for p in reader.partitions()] == [("d0", "v0")]
    objects.drop_assets(str(tmp_path), "d0", "v0")
    assert {r.kind for r in got.where("doc_id = 'd0'").collect()} == {"file"}


@pytest.mark.parametrize("bad", [("..", "v", "file", "x"), ("d", "../../etc", "file", "x"), ("d", "v", "file", ".."), ("d", "v", "odd", "x"), (None, "v", "file", "x"), ("d/e", "v", "file", "x"), (".staging", "v", "file", "x")])
def test_a_failing_task_leaves_nothing_visible(spark, tmp_path, bad):
    rows = [(f"d{i}", "v", "file", "ok", b"1") for i in range(20)] + [(*bad, b"1")]
    with pytest.raises(Exception, match="not a|kind"):
        objects.store(_files(spark, rows).repartition(3), str(tmp_path))
    assert glob.glob(f"{tmp_path}/*") == [] and objects.stored(spark, str(tmp_path)).count() == 0
    objects.sweep(str(tmp_path), hours=0)
    assert os.listdir(tmp_path) == [] or os.listdir(f"{tmp_path}/.staging") == []


def test_stream_of_files(spark, tmp_path):
    source = str(tmp_path / "in")
    for i in range(3):
        _files(spark, [(f"d{i}", "v", "file", "n", bytes([i]))]).write.mode("append").parquet(source)
    spark.dataSource.register(objects.StoredObjects)
    stream = spark.readStream.schema(objects.SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    w = stream.writeStream.format("stored_objects").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out"))
    w.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.doc_id for r in objects.stored(spark, str(tmp_path / "out")).collect()) == ["d0", "d1", "d2"]


# --- decisions


def test_refresh_equals_full_recompute_and_leaves_other_parts(spark):
    path, part, whole = (shared_folder(spark, n) for n in ("decisions", "part", "whole"))
    facts = spark.createDataFrame([(f"p{i % 30}", i) for i in range(300)], "person string, n long")

    def compute(of, standing):
        return of(facts, "person").join(of(standing, "person").select("person", "action").distinct(), "person", "left").groupBy("person").agg(F.sum("n").alias("n"), F.max("action").alias("action"))

    said = lambda who, action: spark.createDataFrame([(f"s-{p}", p, action) for p in who], "subject string, person string, action string")
    decisions.decide(said(["p1", "p2", "p3"], "a"), path, 1)
    assert len(decisions.refresh(spark, path, part, compute, parts=8)) == 8
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{part}/_part=*/*.parquet")}
    decisions.decide(said(["p2"], "b"), path, 2)
    decisions.decide(said(["p2"], "b"), path, 2)
    decisions.decide(said(["p3"], None), path, 3)
    changed = decisions.refresh(spark, path, part, compute, since=1, parts=8)
    after = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{part}/_part=*/*.parquet")}
    assert 1 <= len(changed) <= 2 and all(after.get(f) == t for f, t in before.items() if int(f.split("_part=")[1].split("/")[0]) not in changed)
    decisions.refresh(spark, path, whole, compute, parts=8)
    rows = lambda at: sorted(map(tuple, decisions.results(spark, at).collect()))
    assert rows(part) == rows(whole) and {r[0]: r[2] for r in rows(part) if r[2]} == {"p1": "a", "p2": "b"}
    assert decisions.refresh(spark, path, part, compute, since=3, parts=8) == []


# --- queues and versions


def test_a_killed_handler_ends_with_each_job_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(3):
        spark.createDataFrame([(10 * i + k, "compress" if k % 2 else "ingest") for k in range(6)] + [(0, "ingest")], "id long, type string").coalesce(1).write.mode("append").parquet(source)
    calls = []

    def memory(b):
        calls.append("memory")
        return b

    def ingest(b):
        calls.append("ingest")
        if len(calls) == 4:
            b.write.mode("append").parquet(str(tmp_path / "effects"))
            raise RuntimeError("killed")
        return b

    stream = lambda: spark.readStream.schema("id long, type string").option("maxFilesPerTrigger", 1).parquet(source)
    steps = [(F.col("type") == "compress", memory), (F.lit(True), ingest)]
    with pytest.raises(Exception, match="killed"):
        jobs.work(stream(), "id", steps, out)
    done = spark.read.parquet(jobs.work(stream(), "id", steps, out)).collect()
    assert sorted((r.id, r.type, r.step) for r in done) == sorted((10 * i + k, "compress" if k % 2 else "ingest", 1 - k % 2) for i in range(3) for k in range(6))
    assert calls == ["memory", "ingest"] * 4


def test_publish_versions_replaces_and_repeats_without_effect(spark):
    path = shared_folder(spark, "versions")
    rows = lambda *v: spark.createDataFrame(list(v), "version_id string, n int")
    jobs.publish_versions(rows(("a", 1), ("a", 2), ("b", 3)), rows(("a", 0), ("b", 0)), path)
    for _ in range(2):
        jobs.publish_versions(rows(("a", 9), ("c", 8)), rows(("a", 0)), path)
    jobs.publish_versions(rows(), rows(("b", 0)), path)
    assert sorted((r.version_id, r.n) for r in jobs.published(spark, path).collect()) == [("a", 9)]


# --- payloads


def test_walk_to_any_depth(spark):
    deep = '{"id": "x"}'
    for i in range(40):
        deep = f'{{"n": [{deep}]}}' if i % 2 else f'{{"m": {deep}, "other": [1, null, "t"]}}'
    rows = [(1, deep), (2, '{"a": {"id": "low"}, "b": [{"ID": "no"}], "id": ""}'), (3, "[]"), (4, None), (5, "{broken"), (6, '{"key": "second", "id": 5}'), (7, '{"z": {"id": "z"}, "a": {"id": "a"}}'), (8, '"id"')]
    got = {r.k: (r.level, r.path, r.value) for r in payloads.search(spark.createDataFrame(rows, "k int, p string"), "k", "p", ["id", "key"]).collect()}
    assert {k: v for k, v in got.items() if k != 1} == {2: (2, "$.a.id", "low"), 6: (1, "$.key", "second"), 7: (2, "$.a.id", "a")}
    assert got[1][2] == "x" and got[1][0] == 61


# --- keyed state


def _feed(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in{i:03}")


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_compression_goes_on_after_a_restart_and_equals_a_fold(spark, tmp_path):
    rng = random.Random(6)
    schema = "conversation_id long, id long, tokens long"
    messages = [(c, i, rng.randint(1, 90)) for i in range(30) for c in range(5)]
    start = spark.createDataFrame([(0, 7, -1, [(-3, 10), (-2, 20)]), (9, 2, 5, [])], "conversation_id long, version int, covered_to long, kept array<struct<id: long, tokens: long>>")
    folder, source = str(tmp_path / "job"), str(tmp_path / "in")
    want, left = [], {}
    for c in range(5):
        kept, version, upto = ([(-3, 10), (-2, 20)], 7, -1) if c == 0 else ([], 0, -1)
        for _, i, t in [m for m in messages if m[0] == c]:
            kept, gone = state.compress_step(kept, (i, t), 200, 4)
            if gone:
                version, upto = version + 1, gone[-1][0]
                want.append((c, version, gone[0][0], upto, sum(t for _, t in gone), len(kept)))
        left[c] = (version, upto, [i for i, _ in kept])
    left[9] = (2, 5, [])
    for lo in (0, 60, 90):  # each part is a restart from the checkpoint
        os.makedirs(source, exist_ok=True)
        _feed(spark, f"{source}/{lo}", [messages[lo : lo + 30]] + ([messages[30:60]] if lo == 0 else [messages[120:150]] if lo == 90 else []), schema)
        got = state.run(state.rolling_compression(_stream(spark, source, schema), 200, 2, start), folder)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    kept = state.compression_state(spark, folder).collect()
    assert {r.conversation_id: (r.version, r.covered_to, list(r.kept)) for r in kept} == left


def test_a_lease_lapses_and_is_refused_and_released(spark, tmp_path):
    schema = "key string, holder string, action string, ts timestamp"
    at = lambda s: __import__("datetime").datetime(2024, 1, 1, 0, s // 60, s % 60)
    one = [("k", "a", "acquire", at(0)), ("k", "b", "acquire", at(60)), ("m", "a", "acquire", at(0)), ("m", "a", "release", at(30)), ("m", "b", "acquire", at(31))]
    two = [("other", "x", "release", at(400))]
    three = [("k", "b", "acquire", at(500)), ("m", "x", "release", at(501))]
    folder, source = str(tmp_path / "job"), str(tmp_path / "in")
    for i, rows in enumerate((one, two, three)):
        _feed(spark, f"{source}/{i}", [rows], schema)
        got = state.run(state.leases(_stream(spark, source, schema), 120), folder)
    seen = sorted((r.key, int(r.at.timestamp()) % 3600, r.holder, r.event) for r in got.collect())
    assert seen == [("k", 0, "a", "granted"), ("k", 60, "b", "refused"), ("k", 120, "a", "lapsed"), ("k", 500, "b", "granted"), ("m", 0, "a", "granted"), ("m", 30, "a", "released"), ("m", 31, "b", "granted"), ("m", 151, "b", "lapsed")]


def test_waits_end_by_status_or_timeout(spark, tmp_path):
    schema = "version_id string, kind string, status string, chunks long, ts timestamp"
    at = lambda s: __import__("datetime").datetime(2024, 1, 1, 0, s // 60, s % 60)
    rows = [("done", "s", "ready", 3, at(0)), ("done", "w", None, None, at(10)), ("slow", "w", None, None, at(0)), ("slow", "s", "parsing", 0, at(5)), ("fails", "w", None, None, at(0)), ("fails", "s", "failed", 0, at(50)), ("gone", "w", None, None, at(0)), ("gone", "s", None, 0, at(5)), ("late", "w", None, None, at(0))]
    folder, source = str(tmp_path / "job"), str(tmp_path / "in")
    for i, part in enumerate((rows, [("late", "s", "ready", 4, at(200))])):
        _feed(spark, f"{source}/{i}", [part], schema)
        s = _stream(spark, source, schema)
        got = state.run(state.wait_for_end(s.where("kind = 'w'"), s.where("kind = 's'"), 100), folder)
    assert sorted((r.version_id, r.status, r.chunks, int(r.at.timestamp()) % 3600) for r in got.collect()) == [("done", "ready", 3, 10), ("fails", "failed", 0, 50), ("late", "timeout", 0, 100), ("slow", "timeout", 0, 100)]


# --- access


def test_closure_of_a_deep_chain_and_of_a_cycle(spark):
    rows = [(str(i), str(i - 1) if i else "120", f"u{i}") for i in range(121)]  # a circle of 121 units
    units = spark.createDataFrame(rows, "id string, parent_id string, code string")
    assert access.closure_sql(units, "u0").count() == 121 and access.closure_sql(units, "x' OR '1'='1").count() == 0
    assert access.closure_sql(units.limit(0), "u0").count() == 0
