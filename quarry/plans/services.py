"""Queries over the composites: search, answers, jobs, imports, conversion; records are derived from the star-schema tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import services as V
from . import inputs as I
from . import search
from .inputs import table
from .timeline import _WARN

TOP_N, TOP_K, LEAST = 20, 5, -1000.0


def length_encoder():
    """A stand-in encoder that SQL can follow: three remainders of the text's length."""
    return lambda texts: np.array([[len(t) % 7 + 1, len(t) % 11 + 1, len(t) % 13 + 1] for t in texts], np.float32).reshape(-1, 3)


def length_scorer():
    """A stand-in re-ranker: texts of like length are alike."""
    return lambda pairs: [-float(abs(len(q) - len(t))) for q, t in pairs]


def _kind():
    return F.concat("l_returnflag", "l_linestatus")


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("title"), "lang")


def search_service(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    h = V.search(V.embed_chunks(_docs(spark, d), length_encoder), q, length_encoder, length_scorer, TOP_N, TOP_K, F.col("lang").isin("en", "fr"), LEAST, lambda hits: hits.withColumn("expanded", F.length("title")))
    return h.select("query_id", "id", "final_rank", "rerank_score", F.col("expanded").cast("long").alias("expanded"))


def embedded_chunks(spark, d):
    return V.embed_chunks(_docs(spark, d), length_encoder).select("id", F.get("vector", F.lit(0)).cast("int").alias("a"), F.get("vector", F.lit(2)).cast("int").alias("c"))


def retrieval_cache(spark, d):
    now = F.lit("2024-06-01 00:10:00").cast("timestamp")
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("k"), F.col("o_custkey")).alias("key"))
    e = table(spark, d, "customer").select(F.concat(F.lit("k"), F.col("c_custkey")).alias("key"), (now - F.make_dt_interval(secs=F.col("c_custkey") % 600)).alias("at"), F.col("c_nationkey").alias("hits"))
    run, known = V.split_cached(q, e.unionByName(e.withColumns({"at": F.col("at") - F.expr("interval 1 minute"), "hits": F.lit(-1).cast(e.schema["hits"].dataType)})), now)
    return run.select("query_id", F.lit(None).cast("long").alias("hits")).unionByName(known.select("query_id", F.col("hits").cast("long").alias("hits")))


def qa_routes(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.expr("case when item_id % 4 = 0 then ' Hello？? ' else text end").alias("question"), (F.col("item_id") % 4 != 2).alias("need_retrieval"), F.expr("case when item_id % 3 = 0 then 'before' end").alias("previous_answer"))
    h = table(spark, d, "documents").select((F.col("doc_id") % 331).alias("query_id"), F.col("doc_id").alias("final_rank"), F.col("doc_id").alias("id"), F.col("source").alias("title"), (F.col("doc_id") % 9).cast("int").alias("page"), F.expr("case when doc_id % 2 = 0 then lang end").alias("section"), "text")
    a = V.answer_plan(q, h.where("query_id % 4 != 3"))
    return a.select("query_id", "route", "answer", F.md5("prompt").alias("prompt"), F.coalesce(F.size("citations"), F.lit(-1)).alias("cited"))


_ENDS = ("剩余调休", "加班哪天？", "出差几天", "他备注", "多少人", "有没有某某", "hello", "怎么合并", "额度", "加班", "他的谁")


def _people(spark, d):
    k = F.col("s_suppkey")
    ot = (k % 3) * 0.5
    days = F.when(k % 3 > 0, F.array(F.struct(F.lit("2024-01-02").alias("date"), ot.alias("credit"), (k % 2 == 0).alias("holiday")))).otherwise(F.array().cast(L.OT_DAY))
    return table(spark, d, "supplier").select(F.concat(F.lit("s"), k).alias("person_name"), ((k % 5) * 2.0).alias("travel_comp_days"), ot.alias("ot_comp_days"), ((k % 5) * 2.0 + ot).alias("total_comp_days"), (k % 4).cast("double").alias("used_comp_days"), ((k % 5) * 2.0 + ot - k % 4).alias("remaining_comp_days"), F.when(k % 7 == 0, "r").otherwise("").alias("remark"), days.alias("ot_days"))


def ledger_answers(spark, d):
    k = F.col("c_custkey")
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (k % len(_ENDS) + 1).cast("int"))
    who = F.when((k % len(_ENDS)).isin(3, 4, 5, 6, 10), "").otherwise(F.concat(F.lit("s"), k))
    q = table(spark, d, "customer").select(k.alias("query_id"), F.concat(who, end).alias("text"), F.when(k % 2 == 0, F.concat(F.lit("s"), k % 5)).alias("last_person"))
    return V.ledger_answers(q, _people(spark, d), "parsed", 3, 1)


def job_recompute(spark, d):
    """Open blocking warnings of a job whose own ledger was merged into it before: the overtime codes of its days are gone."""
    parts = [f(spark, d) for f in (I.travel, I.overtime, I.leave, I.punch)]
    none = spark.createDataFrame([], "code string, key string, actions map<string,string>")
    prior = L.compute_ledger(*parts, I.HQ, I.holidays(spark, d))
    _, _, waits = V.recompute(*parts, I.HQ, I.holidays(spark, d), none, prior)
    return waits.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def job_confirm(spark, d):
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.expr("case o_orderstatus when 'F' then 'parsed' when 'O' then 'confirmed' else 'voided' end").alias("status"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), _kind().alias("role"), "l_returnflag", "l_quantity")
    j, snapshot = V.confirm(jobs, li.where("l_returnflag = 'R' and l_quantity > 25"), li, li)
    n = snapshot.groupBy("job_id").agg(F.count(F.lit(1)).alias("rows"))
    return j.join(n, "job_id", "left").select("job_id", "status", "outcome", "open", F.array_join("roles", ",").alias("roles"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def source_uploads(spark, d):
    e = table(spark, d, "events")
    up = e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.expr("case event_type when 'purchase' then 'overtime' when 'signup' then 'leave' when 'view' then 'punch' else 'other' end").alias("role"))
    jobs = table(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), F.expr("case when c_custkey % 4 = 0 then 'confirmed' else 'draft' end").alias("status"))
    held = jobs.select("job_id", F.lit("punch").alias("role")).where("job_id % 5 = 0")
    return V.add_sources(jobs, held, up)


_TOKEN = "case o_orderkey % 3 when 0 then n_name when 1 then substring(n_name, 1, length(n_name) - 1) else 'zz' end"


def _named(spark, d):
    n = table(spark, d, "nation")
    return table(spark, d, "orders").join(n, F.col("o_orderkey") % 25 == F.col("n_nationkey")).withColumn("person_name", F.expr(_TOKEN))


def import_batches(spark, d):
    n = table(spark, d, "nation")
    rows = _named(spark, d).select(F.col("o_custkey").alias("batch_id"), "person_name", "n_name", "o_orderkey")
    codes = rows.select("batch_id", F.expr("case batch_id % 3 when 0 then concat('P', 100 + batch_id % 25) when 1 then 'P1' else 'X' end").alias("code")).distinct()
    projects = n.select(F.col("n_nationkey").cast("string").alias("id"), F.expr("concat('P', 100 + n_nationkey)").alias("code"))
    split = rows.where("o_orderkey % 2 = 0").select("batch_id", F.lit("suspected_name_split").alias("code"), F.expr("substring(n_name, 1, length(n_name) - 1)").alias("token"))
    b, fixed, w = V.import_batches(rows, codes, projects, n.select(F.col("n_name").alias("name")), split)
    count = lambda df, name: df.groupBy("batch_id").agg(F.count(F.lit(1)).alias(name))
    out = b.join(count(w, "warnings"), "batch_id", "left").join(count(fixed.where("person_name = n_name"), "named"), "batch_id", "left")
    return out.select("batch_id", "project_id", "match", "status", F.coalesce("warnings", F.lit(0)).cast("long").alias("warnings"), F.coalesce("named", F.lit(0)).cast("long").alias("named"))


def repaired_facts(spark, d):
    f = _named(spark, d).select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 50).alias("project_id"), F.date_format("o_orderdate", "yyyy-MM").alias("work_date"), F.col("o_orderpriority").alias("person_kind"), "person_name", F.expr("case when o_orderstatus = 'P' then 'voided' else 'active' end").alias("status"), F.lit(None).cast("string").alias("void_reason"))
    out, _ = V.repair_facts(f, table(spark, d, "nation").select(F.col("n_name").alias("name")))
    return out


def retried_versions(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.expr("case when doc_id % 3 = 0 then 'failed' else 'ready' end").alias("status"))
    v = docs.select("doc_id", F.explode(F.expr("slice(array(1, 2, 3), 1, cast(doc_id % 4 as int))")).alias("n")).select("doc_id", F.concat(F.lit("v"), "n").alias("version_id"), F.expr("(n * 2) % 5").alias("created_at"))
    return V.retry_versions(docs.select(F.expr("case when doc_id % 5 = 0 then -doc_id - 1 else doc_id end").alias("doc_id")), docs, v)


def cited_tables(spark, d):
    t = table(spark, d, "part").select(F.expr("concat('t', p_partkey % 3)").alias("tenant_id"), F.concat(F.lit("x"), "p_partkey").alias("table_id"), F.col("p_name").alias("name"), F.array("p_brand").alias("header"), F.col("p_size").cast("long").alias("row_count"), F.expr("case when p_partkey % 2 = 0 then p_type end").alias("summary"))
    c = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("concat('t', l_orderkey % 3)").alias("tenant_id"), F.expr("case when l_linenumber = 7 then '' else concat('x', l_partkey) end").alias("table_id"))
    return V.citation_tables(c, t).select("l_orderkey", "l_linenumber", "table_id", "table.name", "table.summary", "table.row_count")


def _attempts(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("position"))
    return o.select("doc_id", "position", F.concat(F.lit("c"), "position").alias("label"), F.expr("(doc_id + position * 3) % 4 = 0").alias("ok"), F.expr("(doc_id + position) % 5 != 0").alias("recoverable"), F.concat(F.lit("m"), "doc_id", "position").alias("markdown"), F.expr("doc_id % 97 + position").alias("ms"))


def converter_fallbacks(spark, d):
    return V.converted(_attempts(spark, d))


def conversion_report(spark, d):
    return V.conversion_report(_attempts(spark, d))


def collected_tables(spark, d):
    li = table(spark, d, "lineitem")
    s = li.where("l_linenumber = 1").select((F.col("l_orderkey") % 500).alias("doc_id"), _kind().alias("name"), F.col("l_orderkey").alias("row_start"), F.array(F.lit("h")).alias("header"), F.when(F.col("l_orderkey") % 7 != 0, F.col("l_orderkey").cast("string")).otherwise(" ").alias("item"))
    g = li.where("l_linenumber = 2").select((F.col("l_orderkey") % 500).alias("doc_id"), _kind().alias("sheet")).distinct()
    g = g.select("*", F.array("sheet").alias("header"), F.array(F.array("sheet")).alias("rows"))
    b = table(spark, d, "documents").select("doc_id", F.lit("表格 1").alias("name"), F.when(F.col("doc_id") % 2 == 0, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("header"), F.array().cast("array<array<string>>").alias("rows"))
    t = V.collect_tables(s, g, b)
    return t.select("doc_id", "source", "name", F.size("rows").alias("n"), F.md5(F.array_join(F.flatten("rows"), ",")).alias("cells"))


QUERIES = {f.__name__: f for f in (search_service, embedded_chunks, retrieval_cache, qa_routes, ledger_answers, job_recompute, job_confirm, source_uploads, import_batches, repaired_facts, retried_versions, cited_tables, converter_fallbacks, conversion_report, collected_tables)}

_LEN = "list_cosine_similarity([{a} % 7 + 1, {a} % 11 + 1, {a} % 13 + 1]::DOUBLE[], [{b} % 7 + 1, {b} % 11 + 1, {b} % 13 + 1]::DOUBLE[])".format(a="coalesce(length(b.text), 0)", b="length(d.text)")
_WHO = "CASE WHEN c_custkey % 11 IN (3, 4, 5, 6, 10) THEN '' ELSE 's' || c_custkey END || [" + ", ".join(f"'{e}'" for e in _ENDS) + "][c_custkey % 11 + 1]"
_SQL_TOKEN = "CASE o_orderkey % 3 WHEN 0 THEN n_name WHEN 1 THEN substr(n_name, 1, length(n_name) - 1) ELSE 'zz' END"
_CLASSES = f"""o AS (SELECT *, {_SQL_TOKEN} tok FROM orders JOIN nation ON o_orderkey % 25 = n_nationkey),
c AS (SELECT t.tok, count(e.n_name) > 0 exact, count(DISTINCT x.n_name) n, min(x.n_name) too FROM (SELECT DISTINCT tok FROM o) t LEFT JOIN nation e ON e.n_name = t.tok LEFT JOIN nation x ON length(x.n_name) - length(t.tok) BETWEEN 1 AND 2 AND (starts_with(x.n_name, t.tok) OR ends_with(x.n_name, t.tok)) GROUP BY t.tok)"""
_TRIES = "a AS (SELECT o_orderkey doc_id, p, (o_orderkey + p * 3) % 4 = 0 ok, (o_orderkey + p) % 5 != 0 rec, o_orderkey % 97 + p ms FROM orders, (SELECT unnest([0, 1, 2]) p))"

ORACLE_SQL = {
    "search_service": f"""WITH {search._bm25("lang IN ('en', 'fr')", TOP_N)},
dn AS (SELECT item_id query_id, doc_id id, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, doc_id) rank FROM (SELECT item_id, doc_id, {_LEN} s FROM benchmark b, documents d WHERE lang IN ('en', 'fr') AND d.text IS NOT NULL) QUALIFY rank <= {TOP_N}),
f AS (SELECT query_id, id, sum(1.0 / (60 + rank)) s FROM (SELECT query_id, id, rank FROM bm UNION ALL SELECT * FROM dn) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) rank FROM f QUALIFY rank <= {TOP_N}),
h AS (SELECT query_id, id, rank, -abs(length(b.text) - length(d.text))::DOUBLE score, length(source) expanded FROM r JOIN documents d ON doc_id = id JOIN benchmark b ON item_id = query_id)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS INT) final_rank, score rerank_score, expanded FROM h WHERE score >= {LEAST} QUALIFY final_rank <= {TOP_K}""",
    "embedded_chunks": "SELECT doc_id id, CAST(length(text) % 7 + 1 AS INT) a, CAST(length(text) % 13 + 1 AS INT) c FROM documents",
    "retrieval_cache": "SELECT o_orderkey query_id, CASE WHEN c_custkey % 600 < 300 THEN c_nationkey END::BIGINT hits FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "qa_routes": f"""WITH h AS (SELECT doc_id % 331 query_id, count(*) n, string_agg('[' || i || ']《' || source || '》第' || (doc_id % 9) || '页' || CASE WHEN doc_id % 2 = 0 THEN '（' || lang || '）' ELSE '' END || '：' || coalesce(text, ''), chr(10) ORDER BY doc_id) refs
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id % 331 ORDER BY doc_id) i FROM documents) WHERE doc_id % 331 % 4 != 3 GROUP BY 1),
q AS (SELECT item_id, text, n, refs, CASE WHEN item_id % 4 IN (0, 2) THEN 'direct' WHEN n IS NULL THEN 'refused' ELSE 'generate' END route FROM benchmark LEFT JOIN h ON query_id = item_id)
SELECT item_id query_id, route, CASE WHEN item_id % 4 = 0 THEN '{V.GREETING_REPLIES["hello"]}' WHEN route = 'refused' THEN '{V.REFUSAL}' END answer,
md5(CASE WHEN route = 'generate' THEN '{V.PROMPT[:-4]}' || chr(10) || chr(10) || refs WHEN item_id % 4 = 2 THEN CASE WHEN item_id % 3 = 0 THEN '上一轮回答：before' || chr(10) || chr(10) ELSE '' END || text END) prompt,
CAST(CASE WHEN route = 'generate' THEN n ELSE -1 END AS INT) cited FROM q""",
    "ledger_answers": f"""WITH p AS (SELECT 's' || s_suppkey person, s_suppkey k, (s_suppkey % 5 * 2)::DOUBLE tr, s_suppkey % 3 * 0.5::DOUBLE ot, (s_suppkey % 4)::DOUBLE us FROM supplier),
say AS (SELECT *, printf('%g', tr) t, printf('%g', ot) o, printf('%g', tr + ot) s, printf('%g', us) u, printf('%g', tr + ot - us) l FROM p),
q AS (SELECT c_custkey k, {_WHO} AS text, CASE WHEN c_custkey % 2 = 0 THEN 's' || (c_custkey % 5) END lastp FROM customer),
m AS (SELECT q.k, person FROM q JOIN p ON contains(q.text, person) QUALIFY row_number() OVER (PARTITION BY q.k ORDER BY length(person) DESC) = 1),
w AS (SELECT q.k, q.k % 11 e, text, lastp, coalesce(m.person, CASE WHEN regexp_matches(text, '他') THEN lastp END) who FROM q LEFT JOIN m ON m.k = q.k),
j AS (SELECT w.k, e, lastp, say.* EXCLUDE (k), say.k n FROM w LEFT JOIN say ON person = who),
x AS (SELECT *, CASE WHEN e = 6 THEN NULL WHEN e = 7 THEN 'merge' WHEN person IS NOT NULL THEN 'person' WHEN e IN (3, 10) AND lastp IS NULL THEN 'unnamed' WHEN e = 4 THEN 'summary' WHEN e = 5 THEN 'absent' WHEN e IN (0, 1, 2, 3, 8, 9, 10) THEN 'unknown' END kind FROM j),
z AS (SELECT count(*) n, CASE WHEN sum(tr + ot) = floor(sum(tr + ot)) THEN CAST(CAST(sum(tr + ot) AS BIGINT) AS VARCHAR) ELSE printf('%g', sum(tr + ot)) END a, CAST(CAST(sum(us) AS BIGINT) AS VARCHAR) b, CASE WHEN sum(tr + ot - us) = floor(sum(tr + ot - us)) THEN CAST(CAST(sum(tr + ot - us) AS BIGINT) AS VARCHAR) ELSE printf('%g', sum(tr + ot - us)) END c FROM p)
SELECT x.k query_id, kind, CASE kind WHEN 'merge' THEN '请在进度卡选择上一版台账，或上传导出的台账，再点合并写回。' WHEN 'unnamed' THEN '请先说明姓名，或先问某人额度后再用「他/她」追问。'
WHEN 'summary' THEN '当前调休任务状态：parsed；共 ' || z.n || ' 人；合计可调休 ' || z.a || ' 天，已休 ' || z.b || ' 天，剩余合计 ' || z.c || ' 天；告警 3 条（未决议阻塞 1）。'
WHEN 'absent' THEN '没有。当前台账结果中未找到「某某」。' WHEN 'unknown' THEN '未在当前台账结果中找到对应人员。可直接说「张三剩余调休」或「多少人/汇总」。'
WHEN 'person' THEN CASE e WHEN 0 THEN person || '：剩余调休 ' || l || ' 天。' WHEN 2 THEN person || '：出差可调休 ' || t || ' 天。' WHEN 9 THEN person || '：加班可调休 ' || o || ' 天。' WHEN 3 THEN person || '：备注「' || CASE WHEN x.n % 7 = 0 THEN 'r' ELSE '（无）' END || '」。'
WHEN 1 THEN person || CASE WHEN x.n % 3 = 0 THEN '：无计入加班可调休日。' ELSE '：加班可调休日为 2024-01-02' || CASE WHEN x.n % 2 = 0 THEN '（法定）' ELSE '' END || ' ' || o || ' 天。' END
ELSE person || '：出差可调休 ' || t || ' 天，加班可调休 ' || o || ' 天，合计 ' || s || ' 天；已休 ' || u || ' 天，剩余 ' || l || ' 天。' || CASE WHEN x.n % 7 = 0 THEN chr(10) || '备注：r' ELSE '' END END END answer,
CASE WHEN kind = 'person' THEN person WHEN e = 6 OR kind = 'unnamed' THEN NULL ELSE lastp END person FROM x, z""",
    "job_recompute": I.ctes("travel", "overtime", "leave", "punch", "holidays", "pday", "trips", "merged", "credits") + f",\n{_WARN} SELECT code, count(*) n FROM w WHERE blocking AND NOT starts_with(code, 'ot_') GROUP BY code",
    "job_confirm": """WITH li AS (SELECT l_orderkey, count(*) n, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 25) waits, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) roles FROM lineitem GROUP BY 1),
j AS (SELECT o_orderkey, roles, coalesce(waits, 0) waits, coalesce(n, 0) n, CASE WHEN o_orderstatus = 'O' THEN 'unchanged' WHEN o_orderstatus != 'F' THEN 'refused_voided' WHEN coalesce(waits, 0) > 0 THEN 'refused_open' ELSE 'confirmed' END outcome FROM orders LEFT JOIN li ON l_orderkey = o_orderkey)
SELECT o_orderkey job_id, CASE outcome WHEN 'refused_voided' THEN 'voided' WHEN 'refused_open' THEN 'parsed' ELSE 'confirmed' END status, outcome, waits AS open, roles, CASE WHEN outcome = 'confirmed' THEN n ELSE 0 END AS rows FROM j""",
    "source_uploads": "WITH u AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'overtime' WHEN 'signup' THEN 'leave' WHEN 'view' THEN 'punch' ELSE 'other' END AS role FROM events) SELECT user_id job_id, event_id seq, role, CASE WHEN c_custkey IS NULL OR c_custkey % 4 = 0 THEN 'closed' WHEN role = 'other' THEN 'unknown_role' WHEN (role = 'punch' AND c_custkey % 5 = 0) OR row_number() OVER (PARTITION BY user_id, role ORDER BY event_id) > 1 THEN 'duplicate' ELSE 'stored' END outcome FROM u LEFT JOIN customer ON c_custkey = user_id",
    "import_batches": f"""WITH {_CLASSES}, names AS (SELECT DISTINCT o_custkey b, o.tok, CASE WHEN n = 1 THEN 'roster_name_corrected' ELSE 'roster_name_unresolved' END code FROM o JOIN c ON c.tok = o.tok WHERE NOT exact),
sp AS (SELECT o_custkey b, substr(n_name, 1, length(n_name) - 1) tok FROM o WHERE o_orderkey % 2 = 0),
w AS (SELECT b, code FROM names UNION ALL SELECT b, 'suspected_name_split' FROM sp WHERE NOT EXISTS (SELECT 1 FROM names x WHERE x.b = sp.b AND x.tok = sp.tok AND x.code = 'roster_name_corrected') UNION ALL SELECT DISTINCT o_custkey, 'project' FROM o WHERE o_custkey % 3 > 0),
g AS (SELECT b, count(*) n, count(*) FILTER (code != 'roster_name_corrected') bad FROM w GROUP BY b),
m AS (SELECT o_custkey b, count(*) FILTER (exact OR (n = 1 AND too = n_name)) k FROM o JOIN c ON c.tok = o.tok WHERE NOT (exact AND o.tok != n_name) GROUP BY 1)
SELECT d.b batch_id, CASE WHEN d.b % 3 = 0 THEN CAST(d.b % 25 AS VARCHAR) END project_id, ['matched', 'ambiguous', 'unmatched'][d.b % 3 + 1] AS match, CASE WHEN coalesce(bad, 0) > 0 THEN 'needs_review' ELSE 'parsed' END status, coalesce(g.n, 0) warnings, coalesce(k, 0) named FROM (SELECT DISTINCT o_custkey b FROM orders) d LEFT JOIN g ON g.b = d.b LEFT JOIN m ON m.b = d.b""",
    "repaired_facts": f"""WITH {_CLASSES}, f AS (SELECT o_orderkey seq, o_custkey % 50 project_id, strftime(o_orderdate, '%Y-%m') work_date, o_orderpriority person_kind, o.tok, CASE WHEN o_orderstatus = 'P' THEN 'voided' ELSE 'active' END status, CASE WHEN o_orderstatus != 'P' AND NOT exact AND n = 1 THEN too END too FROM o JOIN c ON c.tok = o.tok),
r AS (SELECT *, too IS NOT NULL AND row_number() OVER (PARTITION BY project_id, work_date, person_kind, coalesce(too, tok), status ORDER BY too IS NOT NULL, tok, seq) > 1 again FROM f)
SELECT seq, project_id, work_date, person_kind, CASE WHEN too IS NOT NULL AND NOT again THEN too ELSE tok END person_name, CASE WHEN again THEN 'voided' ELSE status END status, CASE WHEN again THEN 'merged' END void_reason FROM r""",
    "retried_versions": "SELECT CASE WHEN doc_id % 5 = 0 THEN -doc_id - 1 ELSE doc_id END doc_id, CASE WHEN doc_id % 5 = 0 THEN 'not_found' WHEN doc_id % 3 != 0 THEN 'not_failed' WHEN doc_id % 4 = 0 THEN 'no_version' ELSE 'queued' END outcome, CASE WHEN doc_id % 5 != 0 AND doc_id % 3 = 0 AND doc_id % 4 > 0 THEN ['v1', 'v2', 'v2'][doc_id % 4] END version_id FROM documents",
    "cited_tables": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN '' ELSE 'x' || l_partkey END table_id, p_name AS name, CASE WHEN p_partkey IS NULL THEN NULL WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END summary, p_size::BIGINT row_count FROM lineitem LEFT JOIN part ON l_linenumber != 7 AND p_partkey = l_partkey AND p_partkey % 3 = l_orderkey % 3",
    "converter_fallbacks": f"WITH {_TRIES}, e AS (SELECT *, coalesce(min(CASE WHEN ok OR NOT rec THEN p END) OVER (PARTITION BY doc_id), 2) stop FROM a) SELECT doc_id, 'c' || p AS label, ok, CASE WHEN ok THEN 'm' || doc_id || p END markdown, p fallbacks FROM e WHERE p = stop",
    "conversion_report": f"WITH {_TRIES} SELECT 'c' || p AS label, count(*) FILTER (ok) ok, count(*) FILTER (NOT ok) failed, CAST(floor(coalesce(avg(ms) FILTER (ok), 0)) AS BIGINT) mean_ms FROM a GROUP BY p",
    "collected_tables": """WITH s AS (SELECT l_orderkey % 500 d, l_returnflag || l_linestatus m, count(*) FILTER (l_orderkey % 7 != 0) n, coalesce(string_agg(CASE WHEN l_orderkey % 7 != 0 THEN CAST(l_orderkey AS VARCHAR) END, ',' ORDER BY l_orderkey, CAST(l_orderkey AS VARCHAR)), '') t FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL)
SELECT d doc_id, 'semantic' AS source, m AS name, CAST(n AS INT) n, md5(t) cells FROM s UNION ALL SELECT d, 'artifact', k, 1, md5(k) FROM (SELECT DISTINCT l_orderkey % 500 d, l_returnflag || l_linestatus k FROM lineitem WHERE l_linenumber = 2) x WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.d = x.d AND s.m = x.k)
UNION ALL SELECT doc_id, 'structure', '表格 1', 0, md5('') FROM documents WHERE doc_id % 2 = 0""",
}
