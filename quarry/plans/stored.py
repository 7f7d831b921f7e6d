"""Queries over what is written and read back: decisions, versions, queues, files, payloads, the vector index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payloads
from ..operators import ann, decisions, ledger
from ..operators import retrieval as r
from ..operators.shared import shared_folder
from ..sources import objects
from ..streaming import jobs
from . import inputs, timeline
from .inputs import ctes, table
from .search import _DENSE, _vectors


def _vector_index(spark, d):
    v, path = _vectors(spark, d), shared_folder(spark, "vectors")
    ann.build(v, path)
    return v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), path


def ann_exact_topk(spark, d):
    q, path = _vector_index(spark, d)
    return ann.search(spark, path, q, 10, probes=None).select("query_id", "id", "rank", F.round("score", 4).alias("score"))


def ann_recall(spark, d):
    """Share of the exact best ten that the nearest lists have."""
    q, path = _vector_index(spark, d)
    return ann.recall(ann.search(spark, path, q, 10), r.dense_top(_vectors(spark, d), q, 10))


def resolved_credits(spark, d):
    """Overtime credits under stored decisions: a full computation, then a second version that touches some persons only."""
    o = inputs.overtime(spark, d).where("status = '已通过'")
    segments, punch, holidays = timeline._segments(spark, d), inputs.punch(spark, d), inputs.holidays(spark, d)
    open_ = ledger.overtime_credits(o, segments, punch, holidays, None).where("reason = 'ot_missing_punch'").select("person_name", "work_date").distinct()
    n = F.substring("person_name", 2, 9).cast("int")
    day = open_.select(F.concat_ws(":", "person_name", F.col("work_date").cast("string")).alias("subject"), F.col("person_name").alias("person"), n.alias("n"))
    path, out = shared_folder(spark, "decisions"), shared_folder(spark, "credits")

    def compute(of, standing):
        said = of(standing, "person").select("person", F.to_date(F.substring_index("subject", ":", -1)).alias("date"), "action")
        c = ledger.overtime_credits(of(o, "applicant"), of(segments, "person_name"), of(punch, "person_name"), holidays, said)
        return c.select("seq", F.col("person_name").alias("person"), "reason", "credit", "holiday")

    decisions.decide(day.where("n % 3 = 0").withColumn("action", F.lit("accept_half")), path, 1)
    decisions.refresh(spark, path, out, compute)
    again = day.where("n % 15 = 0").withColumn("action", F.when(F.col("n") % 2 == 0, "accept_full"))
    decisions.decide(again, path, 2)
    decisions.refresh(spark, path, out, compute, since=1)
    return decisions.results(spark, out).withColumnRenamed("person", "person_name")


def version_publish(spark, d):
    """Chunks by version, published and then published again for a third of them, some without rows."""
    c = table(spark, d, "documents").select((F.col("doc_id") % 20).cast("string").alias("version_id"), "doc_id")
    path = shared_folder(spark, "versions")
    jobs.publish_versions(c, c, path)
    some = c.where("cast(version_id as int) % 3 = 0")
    for _ in range(2):
        jobs.publish_versions(some.where("version_id != '6'").withColumn("doc_id", -F.col("doc_id")), some, path)
    return jobs.published(spark, path).select(F.col("version_id").cast("string").alias("version_id"), "doc_id")


def stream_work(spark, d):
    """A queue of two kinds, memory jobs first; each job once, under the kind that took it."""
    e = jobs.read_table(spark, d, "events").select("event_id", "event_type")
    steps = [(F.col("event_type").isin("click", "view"), lambda b: b.withColumn("kind", F.lit("memory"))), (F.lit(True), lambda b: b.withColumn("kind", F.lit("ingest")))]
    return spark.read.parquet(jobs.work(e, "event_id", steps)).groupBy("event_type", "kind").agg(F.count(F.lit(1)).alias("n"))


def stored_tables(spark, d):
    """A table grid, a picture and an original of every customer, stored as files and read back."""
    c = table(spark, d, "customer")
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), n.alias("name"), t.alias("t")) for k, n, t in (("table", F.concat(F.lit("t/"), "c_mktsegment"), F.to_json(F.struct("c_custkey", "c_name"))), ("image", F.lit("p.png"), F.col("c_mktsegment")), ("file", F.lit("客户 1.txt"), F.col("c_name"))))))
    files = c.select(F.concat(F.lit("n"), "c_nationkey").alias("doc_id"), F.concat(F.lit("c"), "c_custkey").alias("version_id"), kinds.alias("k")).select("doc_id", "version_id", "k.kind", "k.name", F.encode("k.t", "UTF-8").alias("content"))
    path = shared_folder(spark, "objects")
    objects.store(files, path)
    return objects.stored(spark, path).where("doc_id in ('n1', 'n3')").select("doc_id", "version_id", "kind", "name", F.decode("content", "UTF-8").alias("text"))


_WRAP = "case cast(o_orderkey % 4 as int) when 0 then concat('{\"data\": ', j, '}') when 1 then concat('[1, {\"x\": [', j, ']}]') when 2 then concat('{\"a\": {\"b\": {\"c\": [null, ', j, ']}}}') else j end"


def payload_search(spark, d):
    """Task ids wherever they lie in answers nested by the order's key, found least deep first."""
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit('{"task_id": "t'), "o_orderkey", F.lit('", "id": 7, "tail": {"task_id": "deeper"}}')).alias("j"))
    o = o.withColumn("payload", F.expr(_WRAP)).unionByName(o.select((-F.col("o_orderkey")).alias("o_orderkey"), "j", F.lit('{"task_id": ""').alias("payload")))
    return payloads.search(o, "o_orderkey", "payload", ["taskId", "task_id"])


def payload_fields(spark, d):
    """Fields of service answers of several shapes."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    shape = F.col("o_orderkey") % 3
    text = F.when(shape == 0, F.concat(F.lit('{"task_id": 5, "data": {"task_id": "d'), "o_orderkey", F.lit('", "status": "done", "file_names": ["f.pdf"], "md_content": "plain"}, "message": "m"}'))).when(shape == 1, F.concat(F.lit('{"status": "'), "o_orderstatus", F.lit('", "error": "", "results": {"a.pdf": {"md_content": "A"}, "x/b.pdf": {"md_content": "'), "o_orderpriority", F.lit('"}, "c": {"md_content": " "}, "d": 3}}'))).otherwise(F.lit("no json"))
    a = payloads.answers(o.withColumn("payload", text).withColumn("filename", F.when(F.col("o_orderkey") % 2 == 0, "b.pdf")), "payload", "filename")
    return a.select("o_orderkey", "task_id", "status", "error", "primary_file", "markdown")


QUERIES = {f.__name__: f for f in (ann_exact_topk, ann_recall, resolved_credits, version_publish, stream_work, stored_tables, payload_search, payload_fields)}

_PATHS = "CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN '$.data.task_id' WHEN 1 THEN '$[1].x[0].task_id' WHEN 2 THEN '$.a.b.c[1].task_id' ELSE '$.task_id' END"
_LEVELS = "CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 5 ELSE 1 END"
ORACLE_SQL = {
    "ann_exact_topk": "WITH " + _DENSE.format(w="q.vec_id % 50 = 0", n=10) + " SELECT query_id, id, rank, round(score, 4) score FROM dn",
    "resolved_credits": ctes(*(x for x in timeline._BASE if x != "leave")) + """, z AS (SELECT *, CAST(substr(person, 2) AS INT) n FROM credits),
y AS (SELECT *, CASE WHEN reason = 'ot_missing_punch' AND n % 15 = 0 THEN CASE WHEN n % 2 = 0 THEN 1.0 END WHEN reason = 'ot_missing_punch' AND n % 3 = 0 THEN 0.5 END c FROM z)
SELECT seq, person person_name, CASE WHEN c IS NOT NULL THEN 'resolved' ELSE reason END reason, coalesce(c, CASE WHEN reason = 'credited' THEN 1.0 ELSE 0.0 END)::DOUBLE credit, holiday FROM y""",
    "version_publish": "SELECT CAST(doc_id % 20 AS VARCHAR) version_id, CASE WHEN doc_id % 20 % 3 = 0 THEN -doc_id ELSE doc_id END doc_id FROM documents WHERE doc_id % 20 != 6",
    "stream_work": "SELECT event_type, CASE WHEN event_type IN ('click', 'view') THEN 'memory' ELSE 'ingest' END kind, count(*) n FROM events GROUP BY event_type",
    "stored_tables": "SELECT 'n' || c_nationkey doc_id, 'c' || c_custkey version_id, u.k kind, u.n AS name, u.t AS text FROM (SELECT *, unnest([{'k': 'table', 'n': c_mktsegment || '.json', 't': '{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}'}, {'k': 'image', 'n': sha256(c_mktsegment) || '.png', 't': c_mktsegment}, {'k': 'file', 'n': '客户_1.txt', 't': c_name}]) u FROM customer WHERE c_nationkey IN (1, 3))",
    "payload_search": f"SELECT o_orderkey, CAST({_LEVELS} AS INT) AS level, {_PATHS} path, 't' || o_orderkey AS value FROM orders",
    "payload_fields": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'd' || o_orderkey END task_id, CASE o_orderkey % 3 WHEN 0 THEN 'done' WHEN 1 THEN o_orderstatus END status, CASE WHEN o_orderkey % 3 = 0 THEN 'm' END error, CASE WHEN o_orderkey % 3 = 0 THEN 'f.pdf' END AS primary_file, CASE o_orderkey % 3 WHEN 0 THEN 'plain' WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'A' END ELSE '' END markdown FROM orders",
}
