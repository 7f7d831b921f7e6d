"""Queries over staffing facts, access, conversation memory, audit events and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access, audit, memory, reconcile, staffing
from .inputs import table

S = F.col


def _facts(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.expr("concat('b', event_id % 3)").alias("batch_id"), S("event_id").alias("seq"), F.to_date("ts").alias("work_date"), F.expr("concat('n', user_id)").alias("person_name"),
        F.expr("case when event_id % 5 = 0 then 'internal_contract' else 'internal_formal' end").alias("person_kind"), F.expr("case when event_id % 4 = 0 then ' ' else event_type end").alias("stage"), S("event_id").cast("int").alias("source_row"),
    )


FACTS = "facts AS (SELECT 'b' || (event_id % 3) batch_id, event_id seq, CAST(ts AS DATE) work_date, 'n' || user_id person_name, CASE WHEN event_id % 5 = 0 THEN 'internal_contract' ELSE 'internal_formal' END person_kind, CASE WHEN event_id % 4 = 0 THEN ' ' ELSE event_type END stage, CAST(event_id AS INT) source_row FROM events)"


def _active(spark, d):
    return _facts(spark, d).withColumns({"project_id": F.lit("p1"), "status": F.lit("active"), "void_reason": F.lit(None).cast("string")})


def _roster(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.expr("concat('n', c_custkey % 120)").alias("name"), F.expr("concat('dep', c_nationkey)").alias("department"), S("c_mktsegment").alias("title"), F.expr("c_custkey % 3 = 0").alias("left"), S("c_custkey").alias("seq"))


ROSTER = "roster AS (SELECT 'n' || (c_custkey % 120) name, arg_min('dep' || c_nationkey, (CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END) * 1e12 + c_custkey) department, arg_min(c_mktsegment, (CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END) * 1e12 + c_custkey) title FROM customer GROUP BY 1)"


def supersede_facts(spark, d):
    f = _active(spark, d)
    out = staffing.supersede(staffing.keep_first(f.where("batch_id != 'b0'"), staffing.KEY, "seq"), _facts(spark, d).where("batch_id = 'b0' and dayofmonth(work_date) <= 10"), "p1")
    return out.groupBy("batch_id", "status", "void_reason").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"))


def void_scope(spark, d):
    f = staffing.void(_active(spark, d), "day_person", dates=["2024-01-05"], persons=["n1", "n2", "n3"])
    return staffing.void(f, "batch", batches=["b2"]).groupBy("status", "void_reason").agg(F.count(F.lit(1)).alias("n"))


def dedupe_keep_first(spark, d):
    return staffing.keep_first(_facts(spark, d), staffing.KEY, "seq").select("seq", "person_name")


def dedupe_by_content(spark, d):
    return staffing.dedupe_by_hash(table(spark, d, "documents"), "text", "doc_id").select("doc_id", "sha256")


def person_summary(spark, d):
    s = staffing.person_summary(_active(spark, d))
    return s.select("person_name", "person_kind", "days", S("first_day").cast("string").alias("first_day"), S("last_day").cast("string").alias("last_day"), F.array_join("stages", ",").alias("stages"), "stints")


def kind_rollup(spark, d):
    k = staffing.kind_rollup(_active(spark, d))
    return k.select("person_kind", "persons", "person_days", S("first_day").cast("string").alias("first_day"), S("last_day").cast("string").alias("last_day"))


def facts_department(spark, d):
    return staffing.department_title(_facts(spark, d), _roster(spark, d), "合同部").select("seq", "department", "title")


def export_person_days(spark, d):
    e = staffing.export_person_days(_active(spark, d), _roster(spark, d), "合同部")
    return e.select("number", S("work_date").cast("string").alias("work_date"), "person_name", "person_kind", "department")


def fuzzy_name_pairs(spark, d):
    names = table(spark, d, "customer").select(F.expr("concat('n', c_custkey)").alias("name"))
    return staffing.name_split_pairs(names)


def name_classification(spark, d):
    tokens = table(spark, d, "supplier").select(F.expr("concat('n', s_suppkey)").alias("token")).union(table(spark, d, "nation").select(F.expr("concat('x', n_nationkey)").alias("token")))
    roster = table(spark, d, "customer").select(F.expr("concat('n', c_custkey * 7)").alias("name"))
    c = staffing.classify_names(tokens, roster)
    return c.select("token", "status", "to_name", F.array_join("candidates", ",").alias("candidates"))


def roster_correction(spark, d):
    roster = table(spark, d, "nation").select(F.concat("n_name", F.lit("XY")).alias("name"))
    rows = table(spark, d, "nation").select(S("n_name").alias("person_name"), "n_nationkey")
    return staffing.correct_names(rows, roster)[0]


def project_prefix_match(spark, d):
    """All parts as projects against all names and their first six letters."""
    p = table(spark, d, "part")
    codes = p.select((S("p_partkey") * 2).alias("doc"), F.substring("p_name", 1, 6).alias("code")).union(p.select(S("p_partkey") * 2 + 1, "p_name"))
    return staffing.match_projects(codes, p.select(S("p_partkey").alias("id"), S("p_name").alias("code")))


def collision_resolution(spark, d):
    res = spark.createDataFrame([("n1", "keep_kind", "internal_formal", None), ("n2", "discard", None, None), ("n3", "rename", None, "n33")], "token string, action string, keep_kind string, name string")
    return staffing.apply_resolutions(_facts(spark, d), res).groupBy("person_name", "person_kind").agg(F.count(F.lit(1)).alias("n"))


def rename_merge(spark, d):
    f = staffing.keep_first(_active(spark, d), staffing.KEY, "seq")
    return staffing.rename_person(f, "n5", "n6").groupBy("person_name", "status", "void_reason").agg(F.count(F.lit(1)).alias("n"))


def kind_collisions(spark, d):
    return staffing.kind_collisions(_facts(spark, d)).select(S("work_date").cast("string").alias("work_date"), "person_name")


def repeated_source_rows(spark, d):
    r = staffing.repeated_rows(_facts(spark, d))
    return r.select(S("work_date").cast("string").alias("work_date"), "person_name", "person_kind", "rows", "stage_conflict")


def disjoint_sources(spark, d):
    return staffing.sources_overlap(_facts(spark, d)).select(S("work_date").cast("string").alias("work_date"), "overlap")


def import_status(spark, d):
    b = table(spark, d, "orders").select(S("o_orderkey").alias("batch_id"), F.expr("case when o_orderkey % 3 != 0 then 'p' end").alias("project_id"))
    codes = table(spark, d, "orders").where("o_orderstatus = 'P'").select(S("o_orderkey").alias("batch_id"), F.lit("c").alias("code"))
    return staffing.batch_status(b, codes)


# access
def _labelled(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr("concat('o', doc_id % 9)").alias("org_unit_id"), F.expr("case when doc_id % 3 = 0 then '' else concat('p', doc_id % 5) end").alias("project_id"), S("lang").alias("domain"), F.expr("case when doc_id % 4 = 0 then 'core' else 'general' end").alias("classification"))


def visibility_filter(spark, d):
    return _labelled(spark, d).where(access.visible(["o1", "o2"], ["p1", "p2"], ["en"], "general")).select("doc_id")


def visibility_no_scope(spark, d):
    return _labelled(spark, d).where(access.visible([], [], ["en"], "core")).select("doc_id")


def upload_permission(spark, d):
    x = access.can_upload(S("org_unit_id"), S("project_id"), S("domain"), ["o1", "o4"], ["p1"], ["en", "fr"])
    return _labelled(spark, d).select("doc_id", x.alias("allowed"))


def _units(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.expr("cast(c_custkey as string)").alias("id"), F.expr("case when c_custkey > 1 then cast(c_custkey div 3 as string) end").alias("parent_id"), F.expr("concat('u', c_custkey)").alias("code"))


def org_closure(spark, d):
    roots = spark.createDataFrame([("u2",), ("u7",), ("u20",)], "code string")
    return access.descendants(_units(spark, d), roots)


def org_closure_recursive(spark, d):
    return access.closure_sql(_units(spark, d), "u5")


def user_permissions(spark, d):
    o = table(spark, d, "orders")
    up = o.select(S("o_custkey").alias("user_id"), (S("o_orderkey") % 12).alias("position_id")).distinct()
    pos = spark.range(12).select(S("id").alias("position_id"), (S("id") % 4 != 0).alias("active"))
    pr = spark.range(24).select((S("id") % 12).alias("position_id"), (S("id") % 5).alias("role_id"))
    rp = spark.range(10).select((S("id") % 5).alias("role_id"), F.concat(F.lit("perm"), S("id")).alias("permission"))
    p = access.permissions(up, pos, pr, rp)
    return p.select("user_id", F.array_join("permissions", ",").alias("permissions"))


def positions_with_roles(spark, d):
    n = table(spark, d, "nation").select(S("n_nationkey").alias("position_id"), "n_name")
    pr = table(spark, d, "supplier").select(S("s_nationkey").alias("position_id"), (S("s_suppkey") % 3).alias("role_id"))
    role = table(spark, d, "region").select(S("r_regionkey").cast("long").alias("role_id"), S("r_name").alias("code"))
    return access.positions_with_roles(n, pr, role).select("position_id", F.array_join("roles", ",").alias("roles"))


def feature_gates(spark, d):
    c = table(spark, d, "customer")
    ids = F.array(S("c_nationkey").cast("string"), (S("c_custkey") % 7).cast("string"))
    ok = access.feature_gate(ids, F.array(F.lit("3"), F.lit("5")), F.when(S("c_custkey") % 2 == 0, F.array(F.lit("write"))).otherwise(F.array(F.lit("read"))), "write")
    return c.select("c_custkey", ok.alias("allowed"))


# memory
def _messages(spark, d):
    c = table(spark, d, "conversations")
    return c.select(S("conv_id").alias("conversation_id"), S("turn").alias("id"), S("turn").alias("created_at"), "role", S("text").alias("content"), F.expr("turn % 5 = 4").alias("compressed"), F.expr("cast(case when turn % 3 = 0 then 0 else turn * 10 end as bigint)").alias("token_count"))


def window_tokens(spark, d):
    return memory.window_tokens(_messages(spark, d))


def last_n_rounds(spark, d):
    return memory.last_rounds(_messages(spark, d), 1, "conversation_id", ["created_at", "id"]).select("conversation_id", "id")


def memory_split(spark, d):
    return memory.compression_split(_messages(spark, d), 200, 2, "conversation_id", ["created_at", "id"]).select("conversation_id", "id", "action")


def latest_summary(spark, d):
    s = table(spark, d, "orders").select(S("o_custkey").alias("conversation_id"), S("o_orderkey").alias("version"), S("o_orderpriority").alias("content"))
    return memory.latest_summary(s)


def rule_titles(spark, d):
    m = _messages(spark, d)
    conv = m.select("conversation_id").distinct().withColumn("title", F.when(S("conversation_id") % 3 == 0, "kept").otherwise(memory.DEFAULT_TITLE))
    return memory.backfill_titles(conv, m)


def history_transcript(spark, d):
    t = memory.transcript(_messages(spark, d), "conversation_id", "created_at")
    return t.select("conversation_id", F.md5("transcript").alias("h"))


def token_caps(spark, d):
    text, cut = memory.cap_tokens(F.coalesce("text", F.lit("")), 100)
    return table(spark, d, "documents").select("doc_id", memory.estimate_tokens(S("text")).alias("tokens"), F.md5(text).alias("h"), cut.alias("capped"))


# audit
def _audit(spark, d):
    e = table(spark, d, "events")
    return e.select(S("event_id").alias("id"), F.expr("concat('t', user_id % 2)").alias("tenant_id"), F.expr("concat('a', user_id)").alias("actor"), S("event_type").alias("action"), S("ts").alias("created_at"), "value")


def audit_page(spark, d):
    a = _audit(spark, d).where(audit.audit_filter("t1", "error", None, "2024-01-03", "2024-01-28"))
    return audit.page(a, [S("created_at").desc(), S("id")], 50, 20).select("id", "actor")


def audit_count(spark, d):
    return _audit(spark, d).where(audit.audit_filter("t0", None, None, "2024-01-10")).agg(F.count(F.lit(1)).alias("total"))


def rate_limit_windows(spark, d):
    r = audit.rate_limited(_audit(spark, d), "actor", "created_at", 3, "1 day")
    return r.select("actor", S("window_start").cast("string").alias("window_start"), "n", "allowed", "rejected")


def log_scrub(spark, d):
    m = F.create_map(F.lit("user_token"), S("event_type"), F.lit("note"), F.repeat("event_type", 20))
    s = audit.scrub(m, 30)
    return table(spark, d, "events").select("event_id", s["user_token"].alias("masked"), s["note"].alias("note"))


def session_expiry(spark, d):
    s = table(spark, d, "events").select("event_id", (S("ts") + F.expr("interval 7 days")).alias("expires_at"))
    return audit.valid_sessions(s, "2024-01-20 00:00:00").select("event_id")


def status_transitions(spark, d):
    machine = {"view": ["click", "view"], "click": ["purchase", "view"], "purchase": ["view"], "signup": ["view", "click"]}
    return audit.legal_transitions(_audit(spark, d), machine, "actor", "id", "action").select("id", "legal")


def latency_summary(spark, d):
    c = _audit(spark, d).select("action", (S("action") != "error").alias("ok"), F.round("value", 2).alias("seconds"))
    s = audit.latency_summary(c, ["action"])
    return s.select("action", "calls", "succeeded", F.round("mean", 4).alias("mean"), "least", "most")


# reconciliation
def _sides(spark, d):
    li = table(spark, d, "lineitem")
    person = F.expr("concat('n', l_suppkey)")
    t = li.groupBy(person.alias("person"), S("l_returnflag").alias("label")).agg(F.sum("l_quantity").alias("value"), F.count(F.lit(1)).alias("n"))
    a = t.where("person != 'n1'").select("person", "label", "value")
    b = t.where("person != 'n2'").select("person", "label", (S("value") + F.when(S("n") % 5 == 0, 1.0).otherwise(0.0)).alias("value"))
    g = li.groupBy(person.alias("person"), F.dayofmonth("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    x = g.select("person", "day", F.when(S("n") % 2 == 0, "✓").otherwise("x").alias("in_symbol"), F.lit("√").alias("out_symbol"))
    y = g.where("day != 31").select("person", "day", F.when(S("n") % 2 == 0, "√").otherwise("×").alias("in_symbol"), F.when(S("n") % 7 == 0, "￥").otherwise("√").alias("out_symbol"))
    ex = spark.createDataFrame([("n3", ["R"], None, "known", 0), ("n4", None, [31, 2], "days", 1), ("n5", None, None, "all", 2)], "person string, columns array<string>, days array<int>, reason string, seq int")
    return a, b, x, y, ex


def ledger_diff_exempt(spark, d):
    c = reconcile.compare(*_sides(spark, d))
    return c.groupBy("person", "kind", "exemption").agg(F.count(F.lit(1)).alias("n"), F.sum("day").alias("days"))


def diff_summary(spark, d):
    return reconcile.diff_summary(reconcile.compare(*_sides(spark, d)))


def diff_columns(spark, d):
    return reconcile.column_frequency(reconcile.compare(*_sides(spark, d)))


def people_sets(spark, d):
    a, b, *_ = _sides(spark, d)
    return reconcile.people_sets(a, b)


def roster_changes(spark, d):
    c = table(spark, d, "customer").select(F.expr("concat('n', c_custkey)").alias("person"), S("c_nationkey").cast("string").alias("center"))
    hr = c.where("person not like '%7'").select("person", F.when(S("person").endswith("3"), "moved").otherwise(S("center")).alias("center")).unionByName(table(spark, d, "nation").select(S("n_name").alias("person"), F.lit("x").alias("center")))
    return reconcile.roster_changes(c, hr)


def orphan_names(spark, d):
    r = table(spark, d, "customer").select(F.expr("concat('n', c_custkey)").alias("person"))
    e = table(spark, d, "events")
    p = e.where("event_type = 'view'").select(F.expr("concat('n', user_id * 2)").alias("person"))
    t = e.where("event_type = 'signup'").select(F.expr("concat('n', user_id * 3)").alias("person"))
    return reconcile.orphans(r, travel=t, punch=p)


def symbols_and_numbers(spark, d):
    o = table(spark, d, "orders")
    s = F.element_at(F.array(*(F.lit(x) for x in ("√", "✓", "¥", "$", "x", "★", " X ", "?"))), (S("o_orderkey") % 8 + 1).cast("int"))
    n = F.element_at(F.array(*(F.lit(x) for x in ("1,250.5", "", " 3 ", "n/a"))), (S("o_orderkey") % 4 + 1).cast("int"))
    return o.select("o_orderkey", reconcile.symbol(s).alias("symbol"), reconcile.number(n).alias("number"))


QUERIES = {f.__name__: f for f in (supersede_facts, void_scope, dedupe_keep_first, dedupe_by_content, person_summary, kind_rollup, facts_department, export_person_days, fuzzy_name_pairs, name_classification, roster_correction, project_prefix_match, collision_resolution, rename_merge, kind_collisions, repeated_source_rows, disjoint_sources, import_status, visibility_filter, visibility_no_scope, upload_permission, org_closure, org_closure_recursive, user_permissions, positions_with_roles, feature_gates, window_tokens, last_n_rounds, memory_split, latest_summary, rule_titles, history_transcript, token_caps, audit_page, audit_count, rate_limit_windows, log_scrub, session_expiry, status_transitions, latency_summary, ledger_diff_exempt, diff_summary, diff_columns, people_sets, roster_changes, orphan_names, symbols_and_numbers)}

_F1 = "f1 AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY work_date, person_name, person_kind ORDER BY seq) = 1)"
_MSG = "m AS (SELECT conv_id conversation_id, turn id, role, text AS content, turn % 5 = 4 compressed, CASE WHEN turn % 3 = 0 THEN CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, length(text) // 2) END ELSE turn * 10 END tok FROM conversations)"
_TITLE = "CASE WHEN rtrim(substr(trim(regexp_replace(c, '\\s+', ' ', 'g')), 1, 30)) = '' THEN '新对话' ELSE rtrim(substr(trim(regexp_replace(c, '\\s+', ' ', 'g')), 1, 30)) END"
_SIDES = """t AS (SELECT 'n' || l_suppkey person, l_returnflag label, sum(l_quantity) v, count(*) n FROM lineitem GROUP BY ALL),
g AS (SELECT 'n' || l_suppkey person, CAST(day(l_shipdate) AS INT) dd, count(*) n FROM lineitem GROUP BY ALL),
ppl AS ((SELECT person FROM t WHERE person != 'n1' UNION SELECT person FROM g) INTERSECT (SELECT person FROM t WHERE person != 'n2' UNION SELECT person FROM g)),
df AS (SELECT coalesce(a.person, b.person) person, 'tally' kind, coalesce(a.label, b.label) col, NULL::INT dd FROM (SELECT * FROM t WHERE person != 'n1') a FULL JOIN (SELECT person, label, v + CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END v FROM t WHERE person != 'n2') b ON a.person = b.person AND a.label = b.label WHERE abs(coalesce(a.v, 0) - coalesce(b.v, 0)) >= 1e-9
UNION ALL SELECT person, 'day', '日格', dd FROM g WHERE dd = 31 OR n % 7 = 0),
ex AS (SELECT *, CASE WHEN kind = 'tally' THEN CASE WHEN person = 'n3' AND col = 'R' THEN 'known' WHEN person = 'n5' THEN 'all' END ELSE CASE WHEN person = 'n3' THEN 'known' WHEN person = 'n4' AND dd IN (31, 2) THEN 'days' WHEN person = 'n5' THEN 'all' END END exemption FROM df WHERE person IN (SELECT person FROM ppl))"""

ORACLE_SQL = {
    "supersede_facts": f"WITH {FACTS}, o AS (SELECT * FROM facts WHERE batch_id != 'b0' QUALIFY row_number() OVER (PARTITION BY work_date, person_name, person_kind ORDER BY seq) = 1), b AS (SELECT * FROM facts WHERE batch_id = 'b0' AND day(work_date) <= 10), n AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY work_date, person_name, person_kind ORDER BY seq) = 1), u AS (SELECT batch_id, CASE WHEN work_date IN (SELECT work_date FROM b) THEN 'voided' ELSE 'active' END status, CASE WHEN work_date IN (SELECT work_date FROM b) THEN 'superseded' END void_reason, seq FROM o UNION ALL SELECT batch_id, 'active', NULL, seq FROM n) SELECT batch_id, status, void_reason, count(*) n, CAST(sum(seq) AS BIGINT) seqs FROM u GROUP BY ALL",
    "void_scope": f"WITH {FACTS}, v AS (SELECT (work_date = DATE '2024-01-05' AND person_name IN ('n1', 'n2', 'n3')) OR batch_id = 'b2' gone FROM facts) SELECT CASE WHEN gone THEN 'voided' ELSE 'active' END status, CASE WHEN gone THEN 'manual' END void_reason, count(*) n FROM v GROUP BY ALL",
    "dedupe_keep_first": f"WITH {FACTS}, {_F1} SELECT seq, person_name FROM f1",
    "dedupe_by_content": "SELECT min(doc_id) doc_id, sha256(text) sha256 FROM documents GROUP BY text",
    "person_summary": f"WITH {FACTS}, dy AS (SELECT person_name, person_kind, work_date, arg_min(trim(stage), seq) FILTER (trim(stage) != '') stage FROM facts GROUP BY ALL), r AS (SELECT *, CASE WHEN work_date - lag(work_date) OVER (PARTITION BY person_name, person_kind ORDER BY work_date) = 1 THEN 0 ELSE 1 END opens FROM dy) SELECT person_name, person_kind, count(*) AS days, CAST(min(work_date) AS VARCHAR) first_day, CAST(max(work_date) AS VARCHAR) last_day, coalesce(string_agg(DISTINCT stage, ',' ORDER BY stage), '') stages, CAST(sum(opens) AS BIGINT) stints FROM r GROUP BY ALL",
    "kind_rollup": f"WITH {FACTS}, x AS (SELECT DISTINCT person_name, person_kind, work_date FROM facts) SELECT person_kind, count(DISTINCT person_name) persons, count(*) person_days, CAST(min(work_date) AS VARCHAR) first_day, CAST(max(work_date) AS VARCHAR) last_day FROM x GROUP BY ROLLUP (person_kind)",
    "facts_department": f"WITH {FACTS}, {ROSTER} SELECT seq, coalesce(department, CASE WHEN person_kind = 'internal_contract' THEN '合同部' ELSE '' END) department, coalesce(title, '') title FROM facts LEFT JOIN roster ON name = person_name",
    "export_person_days": f"WITH {FACTS}, {ROSTER} SELECT row_number() OVER (ORDER BY work_date, person_name, CASE person_kind WHEN 'internal_formal' THEN 0 ELSE 1 END, seq) number, CAST(work_date AS VARCHAR) work_date, person_name, person_kind, coalesce(department, CASE WHEN person_kind = 'internal_contract' THEN '合同部' ELSE '' END) department FROM facts LEFT JOIN roster ON name = person_name",
    "fuzzy_name_pairs": "WITH n AS (SELECT DISTINCT 'n' || c_custkey AS name FROM customer), p AS (SELECT name, unnest([substr(name, 1, length(name) - 1), substr(name, 1, length(name) - 2), substr(name, 2), substr(name, 3)]) s FROM n) SELECT DISTINCT s short, p.name AS long FROM p JOIN n ON n.name = p.s WHERE s != ''",
    "name_classification": "WITH t AS (SELECT DISTINCT token FROM (SELECT 'n' || s_suppkey token FROM supplier UNION ALL SELECT 'x' || n_nationkey FROM nation)), r AS (SELECT DISTINCT 'n' || (c_custkey * 7) AS name FROM customer), c AS (SELECT token, list_sort(list(DISTINCT r.name)) l FROM t JOIN r ON length(r.name) - length(token) BETWEEN 1 AND 2 AND (starts_with(r.name, token) OR ends_with(r.name, token)) GROUP BY token) SELECT t.token, CASE WHEN t.token IN (SELECT name FROM r) THEN 'exact' WHEN len(l) = 1 THEN 'auto' ELSE 'unresolved' END status, CASE WHEN t.token IN (SELECT name FROM r) THEN t.token WHEN len(l) = 1 THEN l[1] END to_name, CASE WHEN t.token IN (SELECT name FROM r) THEN '' ELSE coalesce(array_to_string(l[1:5], ','), '') END candidates FROM t LEFT JOIN c ON c.token = t.token",
    "roster_correction": "SELECT n_name || 'XY' person_name, n_nationkey FROM nation",
    "project_prefix_match": "WITH c AS (SELECT p_partkey * 2 doc, substr(p_name, 1, 6) code FROM part UNION ALL SELECT p_partkey * 2 + 1, p_name FROM part), p AS (SELECT p_partkey id, p_name pc FROM part), h AS (SELECT doc, count(DISTINCT id) n, min(id) i FROM c JOIN p ON starts_with(pc, code) OR starts_with(code, pc) GROUP BY doc) SELECT c.doc, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END status, CASE WHEN n = 1 THEN i END project_id, coalesce(n, 0) n FROM c LEFT JOIN h ON h.doc = c.doc",
    "collision_resolution": f"WITH {FACTS} SELECT CASE person_name WHEN 'n3' THEN 'n33' ELSE person_name END person_name, person_kind, count(*) n FROM facts WHERE person_name != 'n2' AND NOT (person_name = 'n1' AND person_kind != 'internal_formal') GROUP BY ALL",
    "rename_merge": f"WITH {FACTS}, {_F1}, z AS (SELECT f1.*, person_name = 'n5' AND EXISTS (SELECT 1 FROM f1 g WHERE g.person_name = 'n6' AND g.work_date = f1.work_date AND g.person_kind = f1.person_kind) dup FROM f1) SELECT CASE WHEN person_name = 'n5' AND NOT dup THEN 'n6' ELSE person_name END person_name, CASE WHEN dup THEN 'voided' ELSE 'active' END status, CASE WHEN dup THEN 'merged' END void_reason, count(*) n FROM z GROUP BY ALL",
    "kind_collisions": f"WITH {FACTS} SELECT CAST(work_date AS VARCHAR) work_date, person_name FROM facts GROUP BY facts.work_date, person_name HAVING count(DISTINCT person_kind) = 2",
    "repeated_source_rows": f"WITH {FACTS} SELECT CAST(facts.work_date AS VARCHAR) work_date, person_name, person_kind, count(DISTINCT source_row) AS rows, count(DISTINCT stage) > 1 stage_conflict FROM facts GROUP BY facts.work_date, person_name, person_kind HAVING count(DISTINCT source_row) > 1 OR count(DISTINCT stage) > 1",
    "disjoint_sources": f"WITH {FACTS}, k AS (SELECT work_date, person_name, count(DISTINCT person_kind) n FROM facts GROUP BY ALL) SELECT CAST(k.work_date AS VARCHAR) work_date, bool_or(n = 2) overlap FROM k GROUP BY k.work_date",
    "import_status": "SELECT o_orderkey batch_id, CASE WHEN o_orderkey % 3 != 0 THEN 'p' END project_id, CASE WHEN o_orderkey % 3 != 0 AND o_orderstatus != 'P' THEN 'parsed' ELSE 'needs_review' END status FROM orders",
    "visibility_filter": "SELECT doc_id FROM documents WHERE (doc_id % 9 IN (1, 2) AND doc_id % 4 != 0) OR (doc_id % 3 != 0 AND doc_id % 5 IN (1, 2) AND lang = 'en')",
    "visibility_no_scope": "SELECT doc_id FROM documents WHERE false",
    "upload_permission": "SELECT doc_id, CASE WHEN doc_id % 3 != 0 THEN doc_id % 5 = 1 AND lang IN ('en', 'fr') ELSE doc_id % 9 IN (1, 4) END allowed FROM documents",
    "org_closure": "WITH RECURSIVE u AS (SELECT CAST(c_custkey AS VARCHAR) id, CASE WHEN c_custkey > 1 THEN CAST(c_custkey // 3 AS VARCHAR) END parent_id, 'u' || c_custkey code FROM customer), c AS (SELECT code root, id FROM u WHERE code IN ('u2', 'u7', 'u20') UNION SELECT c.root, u.id FROM u JOIN c ON u.parent_id = c.id) SELECT * FROM c",
    "org_closure_recursive": "WITH RECURSIVE u AS (SELECT CAST(c_custkey AS VARCHAR) id, CASE WHEN c_custkey > 1 THEN CAST(c_custkey // 3 AS VARCHAR) END parent_id, 'u' || c_custkey code FROM customer), c AS (SELECT id FROM u WHERE code = 'u5' UNION SELECT u.id FROM u JOIN c ON u.parent_id = c.id) SELECT * FROM c",
    "user_permissions": "WITH up AS (SELECT DISTINCT o_custkey user_id, o_orderkey % 12 pos FROM orders), pr AS (SELECT i % 12 pos, i % 5 rl FROM range(24) t(i)), rp AS (SELECT i % 5 rl, 'perm' || i p FROM range(10) t(i)) SELECT user_id, string_agg(DISTINCT p, ',' ORDER BY p) permissions FROM up JOIN pr USING (pos) JOIN rp USING (rl) WHERE pos % 4 != 0 GROUP BY user_id",
    "positions_with_roles": "SELECT n_nationkey position_id, coalesce(string_agg(DISTINCT r_name, ',' ORDER BY r_name), '') roles FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN region ON r_regionkey = s_suppkey % 3 GROUP BY n_nationkey",
    "feature_gates": "SELECT c_custkey, (c_nationkey IN (3, 5) OR c_custkey % 7 IN (3, 5)) AND c_custkey % 2 = 0 allowed FROM customer",
    "window_tokens": f"WITH {_MSG} SELECT conversation_id, CAST(sum(tok) AS BIGINT) window_tokens FROM m WHERE NOT compressed GROUP BY ALL",
    "last_n_rounds": f"WITH {_MSG} SELECT conversation_id, id FROM m QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY id DESC) <= 2",
    "memory_split": f"WITH {_MSG}, w AS (SELECT *, sum(tok) OVER (PARTITION BY conversation_id) t, count(*) OVER (PARTITION BY conversation_id) n, row_number() OVER (PARTITION BY conversation_id ORDER BY id) i FROM m WHERE NOT compressed) SELECT conversation_id, id, CASE WHEN t <= 200 THEN 'none' WHEN i <= CASE WHEN n <= 4 THEN greatest(1, n // 2) ELSE n - 4 END THEN 'compress' ELSE 'retain' END AS action FROM w",
    "latest_summary": "SELECT o_custkey conversation_id, max(o_orderkey) AS version, arg_max(o_orderpriority, o_orderkey) AS content FROM orders GROUP BY o_custkey",
    "rule_titles": f"WITH {_MSG}, f AS (SELECT conversation_id, arg_min(content, id) c FROM m WHERE role = 'user' GROUP BY ALL) SELECT k.conversation_id, CASE WHEN k.conversation_id % 3 = 0 THEN 'kept' WHEN c IS NULL THEN '新对话' ELSE {_TITLE} END title FROM (SELECT DISTINCT conversation_id FROM m) k LEFT JOIN f USING (conversation_id)",
    "history_transcript": f"WITH {_MSG} SELECT conversation_id, md5(string_agg(CASE WHEN role = 'user' THEN '用户' ELSE '助手' END || ': ' || coalesce(content, ''), chr(10) ORDER BY id)) h FROM m GROUP BY conversation_id",
    "token_caps": "WITH t AS (SELECT doc_id, coalesce(text, '') x FROM documents) SELECT doc_id, CAST(CASE WHEN length(x) = 0 THEN 0 ELSE greatest(1, length(x) // 2) END AS BIGINT) tokens, md5(CASE WHEN length(x) // 2 <= 100 THEN x WHEN length(rtrim(substr(x, 1, 200), ' ')) < length(x) THEN rtrim(substr(x, 1, 200), ' ') || '…' ELSE rtrim(substr(x, 1, 200), ' ') END) h, length(x) // 2 > 100 capped FROM t",
    "audit_page": "SELECT event_id id, 'a' || user_id actor FROM events WHERE user_id % 2 = 1 AND event_type = 'error' AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 20",
    "audit_count": "SELECT count(*) total FROM events WHERE user_id % 2 = 0 AND ts >= TIMESTAMP '2024-01-10'",
    "rate_limit_windows": "SELECT 'a' || user_id actor, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') window_start, count(*) n, least(count(*), 3) allowed, greatest(count(*) - 3, 0) rejected FROM events GROUP BY user_id, date_trunc('day', ts)",
    "log_scrub": "SELECT event_id, '***' masked, CASE WHEN length(repeat(event_type, 20)) > 30 THEN substr(repeat(event_type, 20), 1, 30) || '…' ELSE repeat(event_type, 20) END note FROM events",
    "session_expiry": "SELECT event_id FROM events WHERE ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-20'",
    "status_transitions": "SELECT id, CASE WHEN p IS NULL THEN true WHEN p = 'view' THEN a IN ('click', 'view') WHEN p = 'click' THEN a IN ('purchase', 'view') WHEN p = 'purchase' THEN a = 'view' WHEN p = 'signup' THEN a IN ('view', 'click') ELSE false END legal FROM (SELECT event_id id, event_type a, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) p FROM events)",
    "latency_summary": "SELECT event_type AS action, count(*) calls, CAST(sum(CASE WHEN event_type != 'error' THEN 1 ELSE 0 END) AS BIGINT) succeeded, round(avg(round(value, 2)), 4) mean, min(round(value, 2)) least, max(round(value, 2)) most FROM events GROUP BY event_type",
    "ledger_diff_exempt": f"WITH {_SIDES} SELECT person, kind, exemption, count(*) n, CAST(sum(dd) AS BIGINT) AS days FROM ex GROUP BY ALL",
    "diff_summary": f"WITH {_SIDES} SELECT CAST(sum(CASE WHEN exemption IS NULL THEN 1 ELSE 0 END) AS BIGINT) non_exempt, CAST(sum(CASE WHEN exemption IS NULL THEN 0 ELSE 1 END) AS BIGINT) exempt, count(DISTINCT CASE WHEN exemption IS NULL THEN person END) people FROM ex",
    "diff_columns": f"WITH {_SIDES} SELECT col AS \"column\", count(*) n FROM ex WHERE exemption IS NULL AND kind = 'tally' GROUP BY col",
    "people_sets": "WITH p AS (SELECT DISTINCT 'n' || l_suppkey person FROM lineitem) SELECT person, CASE person WHEN 'n1' THEN 'only_correct' WHEN 'n2' THEN 'only_system' ELSE 'both' END side FROM p",
    "roster_changes": "SELECT 'n' || c_custkey person, CASE WHEN c_custkey % 10 = 7 THEN 'left' ELSE 'transfer' END change FROM customer WHERE c_custkey % 10 IN (3, 7) UNION ALL SELECT n_name, 'new' FROM nation",
    "orphan_names": "WITH r AS (SELECT 'n' || c_custkey person FROM customer), p AS (SELECT DISTINCT 'n' || (user_id * 2) person FROM events WHERE event_type = 'view'), t AS (SELECT DISTINCT 'n' || (user_id * 3) person FROM events WHERE event_type = 'signup') SELECT 'orphan_travel' code, person FROM t WHERE person NOT IN (SELECT person FROM r) UNION ALL SELECT 'orphan_punch', person FROM p WHERE person NOT IN (SELECT person FROM r) UNION ALL SELECT 'roster_no_punch', person FROM r WHERE person NOT IN (SELECT person FROM p)",
    "symbols_and_numbers": "SELECT o_orderkey, ['√', '√', '￥', '＄', '×', '★', '×', '?'][o_orderkey % 8 + 1] symbol, [1250.5, 0.0, 3.0, NULL][o_orderkey % 4 + 1]::DOUBLE number FROM orders",
}
