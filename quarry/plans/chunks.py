"""Queries over text functions and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import typed_chunks as K
from .inputs import table

S = F.col


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _markdown(spark, d):
    """Documents as Markdown: title, the text's lines as paragraphs under two headings, a list, a table, a fence and an image."""
    body = F.replace(S("text"), F.lit("\n"), F.lit("\n\n"))
    i = S("doc_id").cast("string")
    md = F.concat(F.lit("<!-- PAGE:1 -->\n# T"), i, F.lit("\n\n"), body, F.lit("\n\n<!-- PAGE:2 -->\n## Part\n\n- one\n- two\n\n| a | b |\n|---|---|\n| 1 | x"), i, F.lit(" |\n| 2 | |\n\n### Deep\n```\ncode | "), i, F.lit("\n\n# not a heading\n```\n# Last\n![cap]("), F.md5(i), F.lit(")\nend\n"))
    return _docs(spark, d).select("doc_id", md.alias("markdown"))


def fixed_window_chunks(spark, d):
    x = _docs(spark, d).select("doc_id", F.posexplode(T.fixed_windows(S("text"), 800, 80)).alias("i", "w"))
    return x.select("doc_id", "i", F.length("w").alias("n"), F.md5("w").alias("h"))


def paragraph_split(spark, d):
    return _docs(spark, d).select("doc_id", F.size(T.paragraphs(S("text"))).alias("n"), F.md5(F.array_join(T.paragraphs(S("text")), "|")).alias("h"))


def _lines(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text"))


def heading_lines(spark, d):
    return _lines(spark, d).select("doc_id", "seq", T.looks_like_heading(S("text")).alias("heading"))


def filled_sections(spark, d):
    return C.filled_sections(_lines(spark, d)).select("doc_id", "seq", F.md5("section").alias("h"))


def table_row_text(spark, d):
    n = table(spark, d, "customer")
    header = F.array(F.lit("name"), F.lit(""), F.lit("seg"))
    row = F.array(S("c_name"), F.when(S("c_custkey") % 3 == 0, F.lit(" ")).otherwise(S("c_nationkey").cast("string")), S("c_mktsegment"), F.lit("x"))
    return n.select("c_custkey", T.row_text(F.lit("t"), T.row_pairs(header, row), S("c_custkey")).alias("text"))


def row_prefix(spark, d):
    t = F.concat(F.when(S("c_custkey") % 2 == 0, F.concat(F.lit("第 "), S("c_custkey").cast("string"), F.lit(" 行： "))).otherwise(""), S("c_name"))
    return table(spark, d, "customer").select("c_custkey", T.strip_row_prefix(t).alias("text"))


def table_summaries(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", T.table_summary(S("n_name"), F.array(F.lit("a"), F.lit("")), S("n_nationkey"), F.when(S("n_regionkey") > 2, "s").otherwise(""), S("n_regionkey")).alias("summary"), T.safe_id(F.lit("v1"), F.concat(S("n_name"), F.lit(" /:x"))).alias("id"))


def unique_column_names(spark, d):
    n = table(spark, d, "nation").orderBy("n_nationkey").groupBy("n_regionkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", F.substring("n_name", 1, 1).alias("x")))), lambda s: s["x"]).alias("names"))
    return n.select("n_regionkey", F.array_join(T.unique_names(S("names")), ",").alias("names"))


def markdown_tables(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", T.markdown_table(F.array(F.lit("k"), F.lit("v")), F.array(F.array(S("n_name")), F.array(S("n_name"), F.lit("2"), F.lit("3")))).alias("text"))


def formula_pages(spark, d):
    t = F.concat(F.when(S("doc_id") % 3 == 0, F.lit("∑ ∫ x = 1")).when(S("doc_id") % 3 == 1, F.lit("\\frac only ")).otherwise(F.lit("y = 2 ≤")), F.substring("lang", 1, 2))
    return table(spark, d, "documents").select("doc_id", T.looks_like_formula(t).alias("formula"))


def doc_type_vote(spark, d):
    l = _lines(spark, d).select("doc_id", F.concat(F.when((S("doc_id") + S("seq")) % 3 == 0, F.lit("Q: ")).when(S("doc_id") % 5 == 0, F.lit("第3条 ")).when(S("doc_id") % 7 == 0, F.lit("步骤 2 ")).when(S("doc_id") % 11 == 0, F.lit("| ")).otherwise(""), S("text")).alias("line"))
    return C.doc_type_vote(l)


def triage_kind(spark, d):
    p = table(spark, d, "lineitem").groupBy(S("l_orderkey").alias("doc_id"), S("l_linenumber").alias("page")).agg((F.sum("l_quantity") * 3).alias("text_chars"), F.sum(F.expr("case when l_tax > 0.07 then 1 else 0 end")).alias("tables"), F.max(S("l_discount") > 0.09).alias("formula"))
    t = C.triage(p)
    return t.select("doc_id", "kind", F.array_join(F.transform("scanned", lambda x: x.cast("string")), ",").alias("scanned"), "text_pages", F.array_join(C.converter_chain(S("kind"), S("doc_id") % 2 == 0), ">").alias("chain"))


def ocr_page_runs(spark, d):
    p = table(spark, d, "lineitem").select((S("l_orderkey") % 50).alias("doc_id"), S("l_partkey").alias("page")).distinct()
    return C.page_groups(p).select("doc_id", "first_page", "last_page")


def page_override(spark, d):
    p = table(spark, d, "orders").select(S("o_custkey").alias("doc_id"), S("o_orderkey").alias("page"), S("o_orderpriority").alias("text"))
    o = table(spark, d, "orders").where("o_orderkey % 4 = 0").select(S("o_custkey").alias("doc_id"), S("o_orderkey").alias("page"), F.when(S("o_orderkey") % 8 == 0, "ocr").otherwise("").alias("text"))
    return C.merge_pages(p, o)


def useful_images(spark, d):
    p = table(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("data"), (S("page_id") % 200).alias("width"), F.expr("case when page_id % 7 = 0 then null else 100 end").alias("height"))
    return C.useful_images(p, 2000, 64).select("page_id")


def sheet_row_groups(spark, d):
    r = table(spark, d, "lineitem").select(S("l_orderkey").alias("doc_id"), S("l_linenumber").alias("row_index"), S("l_linestatus").alias("text")).groupBy("doc_id", "row_index").agg(F.min("text").alias("text"))
    return C.row_groups(r, 3).select("doc_id", "row_start", "row_end", "text")


def chunk_geometry(spark, d):
    p = table(spark, d, "part")
    g = T.geometry(F.element_at(F.array(*(F.lit(x) for x in ("faq", "policy", "table", "other"))), (S("p_partkey") % 4 + 1).cast("int")), S("p_size") * 40, S("p_partkey") % 3 != 0)
    return p.select("p_partkey", g["parent_child"].alias("parent_child"), g["parent_size"].alias("parent_size"), g["child_size"].alias("child_size"), g["child_overlap"].alias("child_overlap"))


def markdown_blocks(spark, d):
    b = C.blocks(_markdown(spark, d))
    return b.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("page").alias("pages"), F.sum("level").alias("levels"))


def section_paths(spark, d):
    s = C.sections(C.blocks(_markdown(spark, d)))
    return s.where("type = 'heading'").select("doc_id", "section", "heading_path", "page")


def markdown_round_trip(spark, d):
    b = C.blocks(_markdown(spark, d))
    again = C.blocks(C.to_markdown(b))
    cols = ["doc_id", "seq", "type", "text", "page", "level"]
    return b.select(*cols).exceptAll(again.select(*cols)).agg(F.count(F.lit(1)).alias("lost"))


def parent_child_plan(spark, d):
    p, _ = C.chunk_plan(_markdown(spark, d))
    return p.select("id", "heading_path", F.length("text").alias("n"), "child_count")


def plan_chunks(spark, d):
    _, c = C.chunk_plan(_markdown(spark, d))
    return c.select("doc_id", "chunk_index", "chunk_kind", "parent_id", F.md5("text").alias("h"))


def table_and_image_chunks(spark, d):
    _, c = C.chunk_plan(_markdown(spark, d))
    return c.where("chunk_kind != 'child'").select("doc_id", "chunk_kind", "text")


def sentence_pack_chunks(spark, d):
    x = _docs(spark, d).select("doc_id", F.posexplode(T.split_sentences(S("text"), 200)).alias("i", "w"))
    return x.select("doc_id", "i", "w")


def line_windows(spark, d):
    x = _docs(spark, d).select("doc_id", F.posexplode(T.line_windows(S("text"), 800, 80)).alias("i", "w"))
    return x.select("doc_id", "i", F.length("w").alias("n"))


def degraded_blocks(spark, d):
    return C.degrade(C.blocks(_markdown(spark, d))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def piece_metadata(spark, d):
    t = F.element_at(F.array(*(F.lit(x) for x in ("第3条 甲", "2.1 乙", "引言"))), (S("n_nationkey") % 3 + 1).cast("int"))
    m = T.piece_metadata(t, "policy")
    f = T.piece_metadata(F.concat(F.lit("Q: "), S("n_name"), F.lit("?")), "faq")
    return table(spark, d, "nation").select("n_nationkey", m["chunk_type"].alias("chunk_type"), m["clause_no"].alias("clause_no"), f["faq_id"].alias("faq_id"))


def _typed(spark, d):
    """Five lines per document: an introduction, two clauses or questions or steps with a line each."""
    i = S("doc_id").cast("string")
    a, b = F.element_at(F.array(*(F.lit(x) for x in ("第一条 ", "问：", "第一步："))), (S("doc_id") % 3 + 1).cast("int")), F.element_at(F.array(*(F.lit(x) for x in ("第2条 ", "Q2: ", "步骤 2："))), (S("doc_id") % 3 + 1).cast("int"))
    md = F.concat(F.lit("# H\nintro\n"), a, i, F.lit("\nmore\n"), b, F.lit("x\nrest\n\n| k | v |\n|---|---|\n| "), i, F.lit(" | 1 |\n"))
    return C.sections(C.blocks(_docs(spark, d).select("doc_id", md.alias("markdown"))))


def policy_chunks(spark, d):
    return K.policy_chunks(_typed(spark, d).where("doc_id % 3 = 0")).select("doc_id", "chunk_type", S("number").alias("clause_no"), "text")


def faq_chunks(spark, d):
    return K.faq_chunks(_typed(spark, d).where("doc_id % 3 = 1")).select("doc_id", "number", "text")


def sop_chunks(spark, d):
    return K.sop_chunks(_typed(spark, d).where("doc_id % 3 = 2")).select("doc_id", S("number").alias("step_no"), "text")


def table_row_groups(spark, d):
    return K.table_groups(_typed(spark, d)).select("doc_id", "table_no", "row_start", "row_end", "text")


def section_chunks(spark, d):
    c = K.typed_chunks(_typed(spark, d), "generic", 30, 5)
    return c.select("doc_id", "chunk_index", "text")


QUERIES = {f.__name__: f for f in (fixed_window_chunks, paragraph_split, heading_lines, filled_sections, table_row_text, row_prefix, table_summaries, unique_column_names, markdown_tables, formula_pages, doc_type_vote, triage_kind, ocr_page_runs, page_override, useful_images, sheet_row_groups, chunk_geometry, markdown_blocks, section_paths, markdown_round_trip, parent_child_plan, plan_chunks, table_and_image_chunks, sentence_pack_chunks, line_windows, degraded_blocks, piece_metadata, policy_chunks, faq_chunks, sop_chunks, table_row_groups, section_chunks)}

_LINES = "l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) t, CAST(unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS INT) seq FROM documents)"
_HEAD = r"(length(t) <= 60 AND t != '' AND NOT regexp_matches(t, '^\d+$') AND NOT regexp_matches(t, '[。！？!?;；]$') AND (NOT regexp_matches(t, '[a-zA-Z]{4,}') OR len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w != '')) <= 12))"

_STRIP = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_END = "。！？!?;；"
_SENTENCES = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') x, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^{_END}]*[{_END}]|[^{_END}]+'), lambda p: {_STRIP("p")}), lambda p: p != '') r FROM documents),
w AS (SELECT doc_id, x, r, CAST(0 AS BIGINT) i, '' cur, CAST([] AS VARCHAR[]) got FROM d
UNION ALL SELECT doc_id, x, r, i + 1, CASE WHEN cur != '' AND length(cur) + length(rest) > 200 THEN rest ELSE cur || rest END, list_concat(list_transform(range(n), lambda k: substr(p, k * 200 + 1, 200)), CASE WHEN cur != '' AND length(cur) + length(rest) > 200 THEN [cur] ELSE [] END)
FROM (SELECT *, substr(p, n * 200 + 1) rest FROM (SELECT *, r[i + 1] p, (length(r[i + 1]) - 1) // 200 n FROM w WHERE i < len(r)))),
g AS (SELECT doc_id, i, unnest(got) w, unnest(range(len(got))) k FROM w UNION ALL SELECT doc_id, i + 1, cur, 0 FROM w WHERE i = len(r) AND cur != ''),
h AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 i FROM g)
SELECT doc_id, CAST(i AS INT) i, w FROM h UNION ALL SELECT doc_id, 0, substr(x, 1, 200) FROM d WHERE doc_id NOT IN (SELECT doc_id FROM h)"""
_WINDOWS = """WITH RECURSIVE d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) r FROM documents),
w AS (SELECT doc_id, r, CAST(0 AS BIGINT) i, CAST([] AS VARCHAR[]) cur, CAST(NULL AS BIGINT) n FROM d
UNION ALL SELECT doc_id, r, i + 1, list_append(CASE WHEN o THEN cur[-greatest(1, len(list_filter(range(1, len(cur) + 1), lambda j: length(array_to_string(cur[-j:], chr(10))) <= 80))) :] ELSE cur END, r[i + 1]), CASE WHEN o THEN length(array_to_string(cur, chr(10))) END
FROM (SELECT *, len(cur) > 0 AND length(array_to_string(cur, chr(10))) + length(r[i + 1]) + 2 > 800 o FROM w WHERE i < len(r))),
g AS (SELECT doc_id, i, n FROM w WHERE n IS NOT NULL UNION ALL SELECT doc_id, i + 1, length(array_to_string(cur, chr(10))) FROM w WHERE i = len(r))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) i, CAST(n AS INT) n FROM g"""
_MD = "'<!-- PAGE:1 -->\n# T' || doc_id || '\n\n' || replace(coalesce(text, ''), chr(10), '\n\n') || '\n\n<!-- PAGE:2 -->\n## Part\n\n- one\n- two\n\n| a | b |\n|---|---|\n| 1 | x' || doc_id || ' |\n| 2 | |\n\n### Deep\n```\ncode | ' || doc_id || '\n\n# not a heading\n```\n# Last\n![cap](' || md5(CAST(doc_id AS VARCHAR)) || ')\nend\n'"
_BLOCKS = f"""WITH m AS (SELECT doc_id, string_split({_MD}, chr(10)) r FROM documents), l AS (SELECT doc_id, unnest(r) raw, unnest(range(len(r))) n FROM m),
a AS (SELECT *, {_STRIP("raw")} s FROM l), f AS (SELECT *, starts_with(s, '```') fence FROM a), b AS (SELECT *, coalesce(sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 inside FROM f),
k AS (SELECT *, CASE WHEN inside = 1 OR fence THEN 'code' WHEN regexp_matches(s, '^<!--\\s*PAGE:\\s*(\\d+)\\s*-->') THEN 'page' WHEN regexp_matches(s, '^(#{{1,6}})\\s+(.+)$') THEN 'heading' WHEN regexp_matches(s, '^\\|.*\\|') THEN 'table' WHEN regexp_matches(s, '^!\\[([^\\]]*)\\]\\(([^)]*)\\)') THEN 'image' WHEN regexp_matches(raw, '^\\s*(?:[-*+]|\\d+[.)])\\s+(.+)$') THEN 'list' WHEN s = '' THEN 'blank' ELSE 'paragraph' END kind FROM b),
o AS (SELECT *, coalesce(lag(kind) OVER w = kind AND kind IN ('table', 'list', 'paragraph', 'code') AND NOT (fence AND inside = 0), false) same, coalesce(last_value(CASE WHEN kind = 'page' THEN CAST(regexp_extract(s, '(\\d+)', 1) AS INT) END IGNORE NULLS) OVER w, 0) page FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
i AS (SELECT *, sum((NOT same)::INT) OVER (PARTITION BY doc_id ORDER BY n) b FROM o),
bl AS (SELECT doc_id, b, any_value(kind) AS type, min(page) page, arg_min(s, n) s, list(raw ORDER BY n) raws, count(*) FILTER (regexp_matches(s, '^\\|.*\\|$') AND NOT regexp_matches(s, '^\\|[\\s:|-]+\\|?$')) grid FROM i WHERE kind NOT IN ('blank', 'page') GROUP BY doc_id, b),
bk AS (SELECT *, CASE WHEN type = 'heading' THEN length(regexp_extract(s, '^(#{{1,6}})\\s+(.+)$', 1)) ELSE 0 END AS level, CASE type WHEN 'heading' THEN regexp_extract(s, '^(#{{1,6}})\\s+(.+)$', 2) WHEN 'image' THEN regexp_extract(s, '^!\\[([^\\]]*)\\]', 1) WHEN 'list' THEN array_to_string(list_transform(raws, lambda x: {_STRIP("regexp_extract(x, '^\\s*(?:[-*+]|\\d+[.)])\\s+(.+)$', 1)")}), chr(10)) ELSE array_to_string(raws, chr(10)) END said FROM bl WHERE type != 'table' OR grid > 0)"""

ORACLE_SQL = {
    "unique_column_names": "WITH n AS (SELECT n_regionkey, n_nationkey, substr(n_name, 1, 1) x, row_number() OVER (PARTITION BY n_regionkey, substr(n_name, 1, 1) ORDER BY n_nationkey) - 1 k FROM nation) SELECT n_regionkey, string_agg(CASE WHEN k > 0 THEN x || '_' || k ELSE x END, ',' ORDER BY n_nationkey) names FROM n GROUP BY n_regionkey",
    "paragraph_split": f"WITH p AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\\n\\s*\\n') p FROM documents) SELECT doc_id, CAST(len(p) AS INT) n, md5(array_to_string(list_transform(p, lambda x: {_STRIP("replace(x, chr(13), '')")}), '|')) h FROM p",
    "sentence_pack_chunks": _SENTENCES,
    "line_windows": _WINDOWS,
    "markdown_blocks": f"{_BLOCKS} SELECT type, count(*) n, CAST(sum(page) AS BIGINT) pages, CAST(sum(level) AS BIGINT) levels FROM bk GROUP BY type",
    "degraded_blocks": f"{_BLOCKS} SELECT doc_id, count(*) n FROM bk WHERE {_STRIP('said')} != '' GROUP BY doc_id",
    "policy_chunks": "SELECT doc_id, unnest(['policy_intro', 'policy_clause', 'policy_clause']) chunk_type, unnest(['', '第一条', '第2条']) clause_no, unnest(['intro', '第一条 ' || doc_id || chr(10) || 'more', '第2条 x' || chr(10) || 'rest']) AS text FROM documents WHERE doc_id % 3 = 0",
    "faq_chunks": "SELECT doc_id, unnest(['1', '2']) number, unnest(['Q: ' || doc_id || chr(10) || 'A: more', 'Q: x' || chr(10) || 'A: rest']) AS text FROM documents WHERE doc_id % 3 = 1",
    "sop_chunks": "SELECT doc_id, unnest(['一', '2']) step_no, unnest(['intro' || chr(10) || '一. ' || doc_id || chr(10) || 'more', '2. x' || chr(10) || 'rest']) AS text FROM documents WHERE doc_id % 3 = 2",
    "table_row_groups": "SELECT doc_id, CAST(1 AS INT) table_no, CAST(1 AS BIGINT) row_start, CAST(1 AS BIGINT) row_end, '| k | v |' || chr(10) || '|---|---|' || chr(10) || '| ' || doc_id || ' | 1 |' AS text FROM documents",
    "fixed_window_chunks": "WITH t AS (SELECT doc_id, coalesce(text, '') x, CASE WHEN length(coalesce(text, '')) <= 800 THEN 0 ELSE CAST(ceil((length(text) - 800) / 720) AS INT) END n FROM documents), w AS (SELECT doc_id, x, unnest(range(n + 1)) i FROM t) SELECT doc_id, CAST(i AS INT) i, CAST(length(substr(x, i * 720 + 1, 800)) AS INT) n, md5(substr(x, i * 720 + 1, 800)) h FROM w",
    "heading_lines": f"WITH {_LINES} SELECT doc_id, seq, {_HEAD} heading FROM l",
    "filled_sections": f"WITH {_LINES} SELECT doc_id, seq, md5(coalesce(last_value(CASE WHEN {_HEAD} THEN substr(t, 1, 200) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq), '前言')) h FROM l",
    "table_row_text": "SELECT c_custkey, '【t】第 ' || c_custkey || ' 行：name=' || c_name || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '；列2=' || c_nationkey END || '；seg=' || c_mktsegment || '；列4=x' AS text FROM customer",
    "row_prefix": "SELECT c_custkey, c_name AS text FROM customer",
    "table_summaries": "SELECT n_nationkey, '表：' || n_name || CASE WHEN n_nationkey > 0 THEN '；共 ' || n_nationkey || ' 行数据' ELSE '' END || '；列：a' || CASE WHEN n_regionkey > 2 THEN '；所属章节：s' ELSE '' END || CASE WHEN n_regionkey > 0 THEN '；页码：第 ' || n_regionkey || ' 页' ELSE '' END summary, 'v1-t-' || substr(regexp_replace(n_name, '[^A-Za-z0-9_]', '_', 'g') || '___x', 1, 40) id FROM nation",
    "markdown_tables": "SELECT n_nationkey, '| k | v |' || chr(10) || '|---|---|' || chr(10) || '| ' || n_name || ' |  |' || chr(10) || '| ' || n_name || ' | 2 |' AS text FROM nation",
    "formula_pages": "SELECT doc_id, doc_id % 3 != 1 formula FROM documents",
    "doc_type_vote": f"WITH {_LINES}, x AS (SELECT doc_id, CASE WHEN (doc_id + seq) % 3 = 0 THEN 'Q: ' WHEN doc_id % 5 = 0 THEN '第3条 ' WHEN doc_id % 7 = 0 THEN '步骤 2 ' WHEN doc_id % 11 = 0 THEN '| ' ELSE '' END || t line FROM l), v AS (SELECT doc_id, count(*) FILTER (regexp_matches(line, '(?i)^\\s*(?:Q\\s*\\d*|问(?:题)?)\\s*[:：.、]?\\s*(.*)$')) f, count(*) FILTER (starts_with(line, '步骤 2')) s, count(*) FILTER (starts_with(line, '第3条')) p, sum(CASE WHEN starts_with(line, '|') THEN length(line) ELSE 0 END) b, sum(length(line)) c FROM x GROUP BY doc_id) SELECT doc_id, CASE WHEN f >= 2 AND f >= s THEN 'faq' WHEN s >= 2 THEN 'sop' WHEN p >= 2 THEN 'policy' WHEN b / greatest(c, 1) >= 0.4 THEN 'table' ELSE 'generic' END doc_type FROM v",
    "triage_kind": "WITH p AS (SELECT l_orderkey doc_id, l_linenumber page, sum(l_quantity) * 3 c, sum(CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END) t, max(l_discount > 0.09) f FROM lineitem GROUP BY ALL), r AS (SELECT doc_id, count(*) n, count(*) FILTER (c < 50) bare, bool_or(t > 0) t, bool_or(f) f, coalesce(string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FILTER (c < 50), '') scanned FROM p GROUP BY doc_id), k AS (SELECT *, CASE WHEN bare = n THEN 'pdf_scanned' WHEN bare > 0 THEN 'pdf_mixed' WHEN t OR f THEN 'pdf_complex' ELSE 'pdf_text' END kind FROM r) SELECT doc_id, kind, scanned, n - bare text_pages, CASE WHEN doc_id % 2 = 0 AND kind != 'pdf_text' THEN 'mineru>' ELSE '' END || CASE kind WHEN 'pdf_text' THEN 'pymupdf' WHEN 'pdf_complex' THEN 'docling>pymupdf' WHEN 'pdf_mixed' THEN 'hybrid_ocr>pymupdf' ELSE 'ocr' END chain FROM k",
    "ocr_page_runs": "WITH p AS (SELECT DISTINCT l_orderkey % 50 doc_id, l_partkey page FROM lineitem), w AS (SELECT *, count(*) OVER (PARTITION BY doc_id) n, CASE WHEN page - lag(page) OVER (PARTITION BY doc_id ORDER BY page) > 1 THEN 1 WHEN lag(page) OVER (PARTITION BY doc_id ORDER BY page) IS NULL THEN 1 ELSE 0 END o FROM p), g AS (SELECT *, sum(CASE WHEN n <= 8 THEN 1 ELSE o END) OVER (PARTITION BY doc_id ORDER BY page) g FROM w) SELECT doc_id, min(page) first_page, max(page) last_page FROM g GROUP BY doc_id, g",
    "page_override": "SELECT o_custkey doc_id, o_orderkey page, CASE WHEN o_orderkey % 8 = 0 THEN 'ocr' ELSE o_orderpriority END AS text FROM orders",
    "useful_images": "SELECT page_id FROM pages WHERE strlen(html) >= 2000 AND (page_id % 7 = 0 OR least(page_id % 200, 100) >= 64) AND (page_id % 7 != 0 OR page_id % 200 >= 64)",
    "sheet_row_groups": "WITH r AS (SELECT l_orderkey doc_id, l_linenumber i, min(l_linestatus) t FROM lineitem GROUP BY ALL) SELECT doc_id, min(i) row_start, max(i) row_end, string_agg(t, chr(10) ORDER BY i) AS text FROM r GROUP BY doc_id, (i - 1) // 3",
    "chunk_geometry": "WITH b AS (SELECT p_partkey, p_partkey % 4 k, greatest(p_size * 40, 100) / 800 s, p_partkey % 3 != 0 AND p_partkey % 4 != 2 pc FROM part), g AS (SELECT *, greatest(CAST(trunc([3000, 2000, 2400, 2400][k + 1] * s) AS INT), 200) ps, greatest(CAST(trunc([1000, 600, 800, 800][k + 1] * s) AS INT), 80) cs, CASE WHEN pc THEN CAST(trunc([0, 60, 0, 80][k + 1] * s) AS INT) ELSE 0 END o FROM b) SELECT p_partkey, pc parent_child, greatest(ps, cs) parent_size, cs child_size, least(o, greatest(cs // 2, 1)) child_overlap FROM g",
    "section_paths": "SELECT doc_id, unnest(['T' || doc_id, 'Part', 'Deep', 'Last']) AS section, unnest(['T' || doc_id, 'T' || doc_id || ' > Part', 'T' || doc_id || ' > Part > Deep', 'Last']) heading_path, unnest([1, 2, 2, 2]) page FROM documents",
    "markdown_round_trip": "SELECT CAST(0 AS BIGINT) lost",
    "table_and_image_chunks": "SELECT doc_id, unnest(['table_summary', 'table_row', 'table_row', 'image']) chunk_kind, unnest(['表：表格 1；共 2 行数据；列：a、b；所属章节：Part；页码：第 2 页；示例：第 1 行：a=1；b=x' || doc_id || '；第 2 行：a=2', '【表格 1】第 1 行：a=1；b=x' || doc_id, '【表格 1】第 2 行：a=2', 'cap']) AS text FROM documents",
    "piece_metadata": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 2 THEN 'policy_intro' ELSE 'policy_clause' END chunk_type, ['第3条', '2.1', ''][n_nationkey % 3 + 1] clause_no, 'Q: ' || n_name || '?' faq_id FROM nation",
}
