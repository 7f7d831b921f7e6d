"""Composites of the other operators: search, answers up to the model call, ledger questions, jobs, imports, conversion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.providers import embed, score_pairs
from . import ledger as L
from . import retrieval as R
from . import staffing as S

# fixed values: greetings and what they are answered, the refusal, the patterns of ledger questions
GREETING_REPLIES = {
    "你好": "你好！我是企业知识库助手，可以问我产品手册、制度文档里的问题。",
    "您好": "您好！我是企业知识库助手，可以问我产品手册、制度文档里的问题。",
    "hi": "Hello! I can answer questions based on your knowledge base documents.",
    "hello": "Hello! I can answer questions based on your knowledge base documents.",
    "嗨": "你好！有什么可以帮你的吗？",
    "谢谢": "不客气，有问题随时问我。",
    "感谢": "不客气，有问题随时问我。",
    "再见": "再见，有需要再来找我。",
    "拜拜": "再见，有需要再来找我。",
}
REFUSAL = "抱歉，当前知识库中没有找到与这个问题相关的内容。你可以补充上传相关文档，或换一种问法再试一次。"
SUMMARY = "多少人|几个人|合计|汇总|总览|进度|告警|总共|一共"
FIELD = "剩余|已休|已调休|出差|加班|合计|可调休|备注|额度"
ASKS = r"多少|几|谁|哪|怎么|如何|剩余|已休|出差|加班|合计|汇总|进度|告警|可调休|备注|有没有|有无|在不在|包含|在吗|台账|\?|？"
PRESENCE = "有没有|有无|在不在|包含|在吗|台账里有|台账有"
MERGE = "(?i)合并|上一版|上月|以往|prior|导出台账|台账卡片|卡片在哪|在哪.*(?:台账|卡片)|(?:台账|卡片).*在哪|怎么合|如何合"
PRONOUN = "他|她|此人|该人|这人"
WHICH_DAY = "哪一天|哪天|哪几|哪日|日期|几号"
WHO = "谁|哪个人|哪位|多少天|几天"
LONGEST_QUESTION = 200
#: What a model is told; ``%s`` stands for the numbered references.
PROMPT = "只依据下列资料回答，每个论断后用 [序号] 注明出处；资料不足时直说。\n\n%s"
CLOSED = ("confirmed", "voided")


def search(chunks: DataFrame, queries: DataFrame, make_encoder: Callable, make_scorer: Callable, top_n: int = 20, top_k: int = 5, where: Column | None = None, min_score: float | None = None, expand: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Best ``top_k`` chunks (id, text, vector and more) per query (query_id, text): filter, both routes, fusion, re-ranking.

    ``expand`` is applied to the hits, for instance to give each its parent's text.
    The queries are encoded, and the fused hits alone are scored again.
    """
    c = chunks if where is None else chunks.where(where)
    asked = queries.select("query_id", "text", embed(F.col("text"), make_encoder).alias("vector"))
    fused = R.hybrid_search(c, asked, top_n)
    hits = fused.join(c.drop("vector"), "id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    hits = hits.withColumn("rerank_score", score_pairs(F.col("query"), F.col("text"), make_scorer))
    best = R.rerank(hits, F.col("rerank_score"), top_k, min_score)
    return best if expand is None else expand(best)


def split_cached(queries: DataFrame, cache: DataFrame, now: Column, seconds: int = 300) -> tuple[DataFrame, DataFrame]:
    """(queries to run, queries with their ``hits``): by ``key``, from the latest entry (key, at, hits) not older than ``seconds``."""
    live = cache.where(F.col("at") > now - F.make_dt_interval(secs=F.lit(seconds))).groupBy("key").agg(F.max_by("hits", "at").alias("hits"))
    return queries.join(live, "key", "left_anti"), queries.join(live, "key")


def embed_chunks(chunks: DataFrame, make_encoder: Callable, batch: int = 32) -> DataFrame:
    """Chunks with the ``vector`` of their text; equal texts are encoded once."""
    once = chunks.select("text").where("text is not null").distinct()
    vectors = once.select(F.col("text").alias("_t"), embed(F.col("text"), make_encoder, batch).alias("vector"))
    return chunks.join(vectors, F.col("text") == F.col("_t"), "left").drop("_t")


def answer_plan(questions: DataFrame, hits: DataFrame, prompt: str = PROMPT) -> DataFrame:
    """query_id, route (direct, refused, generate), answer (null: a model's), prompt, citations.

    Questions: query_id, question, need_retrieval (null: yes), previous_answer.  Hits: query_id, final_rank, title,
    page, section, text, id and, if they were expanded, context_text.  Greetings are answered at once; a question
    without hits is refused; otherwise the prompt holds the numbered references and the citations name the hits.
    """
    said = F.regexp_replace(F.lower(T.strip(F.coalesce("question", F.lit("")))), "[?？]+$", "")
    canned = F.element_at(F.create_map(*(F.lit(x) for kv in GREETING_REPLIES.items() for x in kv)), said)
    shown = F.coalesce("context_text", "text") if "context_text" in hits.columns else F.col("text")
    section = F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit("（"), "section", F.lit("）"))).otherwise("")
    said_at = F.concat(F.lit("《"), F.coalesce("title", F.lit("")), F.lit("》第"), F.coalesce(F.col("page").cast("string"), F.lit("0")), F.lit("页"), section, F.lit("："), F.coalesce(shown, F.lit("")))
    per = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("final_rank", "id", "title", "page", said_at.alias("_said")))).alias("_h"))
    q = questions.join(per, "query_id", "left").withColumn("_canned", canned)
    direct = F.col("_canned").isNotNull() | ~F.coalesce("need_retrieval", F.lit(True))
    route = F.when(direct, "direct").when(F.col("_h").isNull(), "refused").otherwise("generate")
    listed = F.array_join(F.transform("_h", lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]"), h["_said"])), "\n")
    before, after = prompt.split("%s")
    earlier = F.when(F.coalesce("previous_answer", F.lit("")) != "", F.concat(F.lit("上一轮回答："), "previous_answer", F.lit("\n\n"))).otherwise("")
    return q.withColumn("route", route).select(
        "query_id", "route",
        F.when(F.col("_canned").isNotNull(), F.col("_canned")).when(F.col("route") == "refused", REFUSAL).alias("answer"),
        F.when(F.col("route") == "generate", F.concat(F.lit(before), listed, F.lit(after))).when((F.col("route") == "direct") & F.col("_canned").isNull(), F.concat(earlier, F.coalesce("question", F.lit("")))).alias("prompt"),
        F.when(F.col("route") == "generate", F.transform("_h", lambda h: F.struct(h["id"].alias("id"), h["title"].alias("title"), h["page"].alias("page")))).alias("citations"),
    )


def _days(x: Column | str) -> Column:
    x = F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(0.0)).cast("double")
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(T.format_number(x))


def _person_answer() -> Column:
    """The sentence about a ledger row that a question's words ask for; the columns of the row and ``text`` are given."""
    has = lambda p: F.col("text").rlike(p)
    say = lambda *parts: F.concat(F.col("person"), *(F.lit(p) if isinstance(p, str) else p for p in parts))
    travel, ot, total, used, left = (_days(c) for c in ("travel_comp_days", "ot_comp_days", "total_comp_days", "used_comp_days", "remaining_comp_days"))
    remark = F.trim(F.coalesce("remark", F.lit("")))
    credited = F.filter("ot_days", lambda d: d["credit"] > 0)
    legal = lambda d: F.coalesce(d["holiday"], F.lit(False)) | d["date"].contains("(法定)")
    named = F.array_join(F.transform(credited, lambda d: F.concat(F.trim(F.regexp_replace(d["date"], r"\(法定\)", "")), F.when(legal(d), "（法定）").otherwise(""), F.lit(" "), _days(d["credit"]), F.lit(" 天"))), "；")
    days = (
        F.when(F.coalesce(F.size(credited), F.lit(0)) > 0, say("：加班可调休日为 ", named, "。"))
        .when(F.coalesce("ot_comp_days", F.lit(0.0)) > 0, say("：加班可调休 ", ot, " 天，但结果中未列出具体加班日明细（可能来自导入模板汇总）。"))
        .otherwise(say("：无计入加班可调休日。"))
    )
    whole = say("：出差可调休 ", travel, " 天，加班可调休 ", ot, " 天，合计 ", total, " 天；已休 ", used, " 天，剩余 ", left, " 天。", F.when(remark != "", F.concat(F.lit("\n备注："), remark)).otherwise(""))
    there = F.concat(F.lit("有。"), say("在当前台账中：出差可调休 ", travel, " 天，加班可调休 ", ot, " 天，合计 ", total, " 天；已休 ", used, " 天，剩余 ", left, " 天。"))
    return (
        F.when(has("剩余") & ~has("合计|出差|加班|已休"), say("：剩余调休 ", left, " 天。"))
        .when(has("已休|已调休") & ~has("剩余|出差|加班"), say("：已调休 ", used, " 天。"))
        .when(has("出差") & ~has("加班|剩余|已休"), say("：出差可调休 ", travel, " 天。"))
        .when(has("加班") & ~has("出差|剩余|已休") & has(WHICH_DAY), days)
        .when(has("加班") & ~has("出差|剩余|已休"), say("：加班可调休 ", ot, " 天。"))
        .when(has("备注"), say("：备注「", F.when(remark == "", "（无）").otherwise(remark), "」。"))
        .when(has(PRESENCE) & ~has(FIELD), there)
        .otherwise(whole)
    )


def ledger_answers(questions: DataFrame, ledger: DataFrame, status: str, warnings: int = 0, open_blocking: int = 0) -> DataFrame:
    """query_id, kind, answer, person: what rules answer about one ledger (a row per person); kind null: no question about it.

    Questions: query_id, text, last_person (of the turn before, whom a pronoun means).  The longest name in a text
    counts; several of that length ask back.
    """
    has = lambda p: F.col("text").rlike(p)
    q = questions.select("query_id", F.coalesce("text", F.lit("")).alias("text"), "last_person")
    t = T.strip(F.col("text"))
    asked = (t != "") & (F.length(t) <= LONGEST_QUESTION) & (has(ASKS) | has(SUMMARY) | has(FIELD) | has(PRESENCE) | has(MERGE))
    rows = ledger.withColumn("person", F.trim("person_name")).where("person != ''")
    named = L.longest_named(q.where(asked).select(F.col("query_id").alias("text_id"), "text"), rows.select(F.col("person").alias("name")))
    named = named.groupBy(F.col("text_id").alias("query_id")).agg(F.sort_array(F.collect_set("name")).alias("_names"))
    n = F.coalesce(F.size("_names"), F.lit(0))
    q = q.withColumn("_asked", asked).join(named, "query_id", "left").withColumn("_n", n)
    q = q.withColumn("_who", F.when(F.col("_n") == 1, F.col("_names")[0]).when((F.col("_n") == 0) & F.col("_asked") & has(PRONOUN), F.col("last_person")))
    facts = rows.select("person", "travel_comp_days", "ot_comp_days", "total_comp_days", "used_comp_days", "remaining_comp_days", "remark", "ot_days")
    q = q.join(facts, F.col("_who") == F.col("person"), "left")
    sums = ledger.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("total_comp_days", "used_comp_days", "remaining_comp_days"))).first()
    kind = (
        F.when(~F.col("_asked"), None).when(has(MERGE), "merge").when(F.lit(sums.n == 0), "empty").when(F.col("_n") > 1, "several")
        .when(F.col("person").isNotNull(), "person").when(has(PRONOUN) & F.col("last_person").isNull(), "unnamed")
        .when(has(SUMMARY), "summary").when(has(PRESENCE), "absent").when(has(FIELD) | has(WHO), "unknown")
    )
    who = F.regexp_extract("text", r"(?:有没有|有无|包含)\s*([^\s？?，,。的]{1,20})", 1)
    who = F.when(who != "", who).otherwise(F.regexp_extract("text", r"([^\s？?，,。]{1,20})\s*在不在", 1))
    total = [_days(F.lit(float(sums[c]))) for c in ("total_comp_days", "used_comp_days", "remaining_comp_days")]
    merge = "任务已确认或作废，不能再合并；合并须在确认之前完成。" if status in CLOSED else "请先上传四源并算出结果，再合并上月台账。" if sums.n == 0 else "请在进度卡选择上一版台账，或上传导出的台账，再点合并写回。"
    answer = (
        F.when(F.col("kind") == "merge", merge)
        .when(F.col("kind") == "empty", "当前任务尚无预览行（可能仍缺源文件或尚未算出结果）。请先上传四源并完成计算。")
        .when(F.col("kind") == "several", F.concat(F.lit("匹配到多人（"), F.array_join("_names", "、"), F.lit("），请用完整姓名再问一次。")))
        .when(F.col("kind") == "person", _person_answer())
        .when(F.col("kind") == "unnamed", "请先说明姓名，或先问某人额度后再用「他/她」追问。")
        .when(F.col("kind") == "summary", F.concat(F.lit(f"当前调休任务状态：{status}；共 {sums.n} 人；合计可调休 "), total[0], F.lit(" 天，已休 "), total[1], F.lit(" 天，剩余合计 "), total[2], F.lit(f" 天；告警 {warnings} 条（未决议阻塞 {open_blocking}）。")))
        .when(F.col("kind") == "absent", F.concat(F.lit("没有。当前台账结果中未找到「"), F.when(who == "", "该人").otherwise(who), F.lit("」。")))
        .when(F.col("kind") == "unknown", "未在当前台账结果中找到对应人员。可直接说「张三剩余调休」或「多少人/汇总」。")
    )
    sticky = F.when(F.col("kind") == "person", F.col("person")).when(F.col("_asked") & F.coalesce(F.col("kind") != "unnamed", F.lit(True)), F.col("last_person"))
    return q.withColumn("kind", kind).select("query_id", "kind", answer.alias("answer"), sticky.alias("person"))


def recompute(travel: DataFrame, overtime: DataFrame, leave: DataFrame, punch: DataFrame, hq_keywords: list[str], holidays: DataFrame, resolved: DataFrame, prior: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ledger, warnings, open blocking warnings) of a job's sources under its review decisions.

    ``resolved`` (code, key, actions) are the decisions.  A prior ledger once merged stays merged: it is applied
    again to what is computed, and warnings on days that it has go.  The job is parsed when no warning is open.
    """
    actions = L.decode_resolutions(resolved)
    include = resolved.where("code = 'approval_not_passed'").select("key")
    found = L.warnings(travel, overtime, leave, punch, hq_keywords, holidays, include, actions)
    now = L.compute_ledger(travel, overtime, leave, punch, hq_keywords, holidays, include, actions)
    if prior is not None:
        now, found = L.merge_ledgers(prior, now, holidays), L.uncovered_warnings(found, prior)
    return now, found, L.open_warnings(found, resolved)


def confirm(jobs: DataFrame, open_found: DataFrame, rows: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs with outcome and new status, snapshot rows of the jobs newly confirmed).

    Jobs: job_id, status.  A voided job and one with open blocking warnings (job_id) are refused; a confirmed one
    stays as it is and gets no new snapshot.  ``roles`` are those of its sources (job_id, role).
    """
    waits = open_found.groupBy("job_id").agg(F.count(F.lit(1)).alias("open"))
    roles = sources.groupBy("job_id").agg(F.sort_array(F.collect_set("role")).alias("roles"))
    j = jobs.join(waits, "job_id", "left").join(roles, "job_id", "left").withColumn("open", F.coalesce("open", F.lit(0).cast("long")))
    outcome = F.when(F.col("status") == "voided", "refused_voided").when(F.col("status") == "confirmed", "unchanged").when(F.col("open") > 0, "refused_open").otherwise("confirmed")
    j = j.withColumn("outcome", outcome).withColumn("status", F.when(F.col("outcome") == "confirmed", "confirmed").otherwise(F.col("status")))
    return j, rows.join(j.where("outcome = 'confirmed'").select("job_id"), "job_id", "left_semi")


def add_sources(jobs: DataFrame, held: DataFrame, uploads: DataFrame) -> DataFrame:
    """Uploads (job_id, seq, role) with outcome: closed, unknown_role, duplicate or stored; a job keeps one file per role, the first.

    Jobs: job_id, status.  Held: job_id, role.
    """
    known = F.coalesce(F.col("role").isin(*L.ROLES), F.lit(False))
    u = uploads.join(jobs.select("job_id", F.col("status").alias("_s")), "job_id", "left").join(held.select("job_id", "role", F.lit(True).alias("_h")).distinct(), ["job_id", "role"], "left")
    first = F.row_number().over(Window.partitionBy("job_id", "role").orderBy("seq")) == 1
    shut = F.col("_s").isNull() | F.col("_s").isin(*CLOSED)
    return u.withColumn("outcome", F.when(shut, "closed").when(~known, "unknown_role").when(F.col("_h").isNotNull() | ~first, "duplicate").otherwise("stored")).drop("_s", "_h")


def import_batches(rows: DataFrame, codes: DataFrame, projects: DataFrame, roster: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(batches with project and status, rows with corrected names, warnings) of daily reports.

    Rows: batch_id, person_name and more.  Codes: batch_id, code, at least one row per batch.  Found: batch_id, code, token,
    what the parser warned of.  A batch is parsed when its project is certain and every warning is a correction.
    """
    fixed, names = S.correct_names(rows, roster)
    named = rows.select("batch_id", F.trim("person_name").alias("token")).distinct().join(names.select("token", "code"), "token").select("batch_id", "code", "token")
    mended = named.where("code = 'roster_name_corrected'").select("batch_id", "token", F.lit("suspected_name_split").alias("code"))
    kept = found.select("batch_id", "code", "token").join(mended, ["batch_id", "code", "token"], "left_anti").unionByName(named)
    match = S.match_projects(codes.select(F.col("batch_id").alias("doc"), "code"), projects).select(F.col("doc").alias("batch_id"), "project_id", F.col("status").alias("match"))
    every = kept.unionByName(match.where("match != 'matched'").select("batch_id", F.concat(F.lit("project_"), "match").alias("code"), F.lit(None).cast("string").alias("token")))
    blocked = every.where("code != 'roster_name_corrected'").select("batch_id").distinct().withColumn("_b", F.lit(True))
    status = F.when(F.col("_b").isNotNull(), "needs_review").otherwise("parsed")
    return match.join(blocked, "batch_id", "left").select("batch_id", "project_id", "match", status.alias("status")), fixed, every


def repair_facts(facts: DataFrame, roster: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, unresolved tokens): active facts renamed to the one roster name that extends theirs; repeats of a fact are voided.

    Facts: seq, project_id, work_date, person_kind, person_name, status, void_reason.
    """
    live = F.col("status") == "active"
    c = S.classify_names(facts.where(live).select(F.col("person_name").alias("token")), roster)
    auto = c.where("status = 'auto'").select(F.col("token").alias("_t"), F.col("to_name").alias("_to"))
    j = facts.join(auto, F.trim("person_name") == F.col("_t"), "left").withColumn("_to", F.when(live, F.col("_to")))
    name = F.coalesce("_to", F.trim("person_name"))
    w = Window.partitionBy("project_id", "work_date", "person_kind", name, live).orderBy(F.col("_to").isNotNull(), "person_name", "seq")
    again = F.col("_to").isNotNull() & (F.row_number().over(w) > 1)
    j = j.withColumn("_again", again)
    j = j.withColumns({"status": F.when(F.col("_again"), "voided").otherwise(F.col("status")), "void_reason": F.when(F.col("_again"), "merged").otherwise(F.col("void_reason")), "person_name": F.when(F.col("_to").isNotNull() & ~F.col("_again"), F.col("_to")).otherwise(F.col("person_name"))})
    return j.select(*facts.columns), c.where("status not in ('exact', 'auto')").select("token", "candidates")


def retry_versions(requests: DataFrame, documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Requests (doc_id) with outcome (not_found, not_failed, no_version, queued) and the newest version of a failed document.

    Documents: doc_id, status.  Versions: doc_id, version_id, created_at.
    """
    newest = versions.groupBy("doc_id").agg(F.max_by("version_id", F.struct("created_at", "version_id")).alias("_v"))
    j = requests.select("doc_id").distinct().join(documents.select("doc_id", "status"), "doc_id", "left").join(newest, "doc_id", "left")
    outcome = F.when(F.col("status").isNull(), "not_found").when(F.col("status") != "failed", "not_failed").when(F.col("_v").isNull(), "no_version").otherwise("queued")
    return j.select("doc_id", outcome.alias("outcome"), F.when(outcome == "queued", F.col("_v")).alias("version_id"))


def citation_tables(citations: DataFrame, tables: DataFrame) -> DataFrame:
    """Citations with ``table``: name, header, row_count and summary of the tenant's table that they point at, or null."""
    t = tables.select("tenant_id", "table_id", F.struct("table_id", "name", "header", "row_count", F.coalesce("summary", F.lit("")).alias("summary")).alias("table"))
    return citations.join(t, ["tenant_id", "table_id"], "left")


def converted(attempts: DataFrame) -> DataFrame:
    """doc_id, label, ok, markdown, fallbacks: the first converter that did it, or the failure that ended the chain.

    Attempts: doc_id, position, label, ok, recoverable, markdown.  A failure hands on to the next converter only if
    it is recoverable, so what comes after one that is not doesn't count.
    """
    row = F.struct("position", "label", "ok", "markdown")
    ends = F.col("ok") | ~F.col("recoverable")
    g = attempts.groupBy("doc_id").agg(F.min(F.when(ends, row)).alias("_end"), F.max(row).alias("_last"), F.sort_array(F.collect_list("position")).alias("_p"))
    r = F.coalesce("_end", "_last")
    return g.select("doc_id", r["label"].alias("label"), r["ok"].alias("ok"), F.when(r["ok"], r["markdown"]).alias("markdown"), F.size(F.filter("_p", lambda p: p < r["position"])).alias("fallbacks"))


def conversion_report(attempts: DataFrame) -> DataFrame:
    """label, ok, failed, mean_ms (whole milliseconds of the attempts that worked; 0 if none did)."""
    ms = F.coalesce(F.avg(F.when(F.col("ok"), F.col("ms"))), F.lit(0.0)).cast("long")
    return attempts.groupBy("label").agg(F.sum(F.col("ok").cast("long")).alias("ok"), F.sum((~F.col("ok")).cast("long")).alias("failed"), ms.alias("mean_ms"))


def collect_tables(semantic: DataFrame, grids: DataFrame, block_tables: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, source, name, header, rows of each table once: a sheet's row texts before its grid, then tables in the text.

    Semantic: doc, name, row_start, header, item.  Grids: doc, sheet (blank: every one counts), header, rows.  Tables without header and rows go.
    """
    filled = F.coalesce("item", F.lit("")).rlike(r"\S")
    s = semantic.groupBy(doc, "name").agg(F.min_by("header", F.when(F.size("header") > 0, F.col("row_start"))).alias("header"), F.transform(F.sort_array(F.collect_list(F.when(filled, F.struct("row_start", "item")))), lambda x: F.array(x["item"])).alias("rows"))
    g = grids.join(semantic.select(doc, F.col("name").alias("sheet")).distinct(), [doc, "sheet"], "left_anti")
    g = g.withColumn("_r", F.row_number().over(Window.partitionBy(doc, "sheet").orderBy(F.size("rows").desc(), F.to_json(F.struct("header", "rows"))))).where("_r = 1 or coalesce(sheet, '') = ''")
    out = s.select(doc, F.lit("semantic").alias("source"), "name", "header", "rows")
    out = out.unionByName(g.select(doc, F.lit("artifact").alias("source"), F.col("sheet").alias("name"), "header", "rows"))
    out = out.unionByName(block_tables.select(doc, F.lit("structure").alias("source"), "name", "header", "rows"))
    return out.where("coalesce(size(header), 0) > 0 or coalesce(size(rows), 0) > 0")
