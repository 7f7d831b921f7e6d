"""Queries over retrieval: ``documents`` as chunks, ``benchmark`` as queries, ``embeddings`` as vectors (vec_id = doc_id)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inverted
from ..operators import retrieval as r
from ..operators.shared import shared_folder
from .inputs import table

TOP_N, TOP_K = 20, 3


def _chunks(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("title"), "lang", "source")


def _queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def bm25_topk(spark, d):
    t = r.bm25_top(_chunks(spark, d), _queries(spark, d), TOP_N)
    return t.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def _index(spark, d):
    path = shared_folder(spark, "inverted")
    inverted.build(_chunks(spark, d), path, ["lang"])
    return path


def bm25_index(spark, d):
    return inverted.terms(spark, _index(spark, d)).select("term", "df", F.round("best", 6).alias("best"))


def indexed_topk(spark, d):
    return inverted.search(spark, _index(spark, d), _queries(spark, d), TOP_N).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def dense_topk(spark, d):
    v = _vectors(spark, d)
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    return r.dense_top(v, q, 10).select("query_id", "id", "rank", F.round("score", 4).alias("score"))


def _fused(spark, d):
    v = _vectors(spark, d)
    c = _chunks(spark, d)
    q = _queries(spark, d).join(v.select(F.col("id").alias("query_id"), "vector"), "query_id")
    dense = r.dense_top(v.join(c.select("id"), "id", "left_semi"), q, TOP_N)
    return r.rrf([dense, r.bm25_top(c, q, TOP_N)], TOP_N)


def rrf_hybrid(spark, d):
    return _fused(spark, d).where(f"rank <= {TOP_K}").select("query_id", "id", "rank", F.round("score", 8).alias("score"))


def filtered_bm25(spark, d):
    where = r.filter_expr(None, {"lang": ["en", "fr"], "source": "src0", "nonsense": 1, "title": ""})
    return r.bm25_top(_chunks(spark, d).where(where), _queries(spark, d), 5).select("query_id", "id", "rank")


def _questions(spark, d):
    b = table(spark, d, "benchmark")
    words = F.split(F.lower("text"), " ")
    return b.select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("expected_source"), F.lit(1).alias("source_page"), F.array(words[0], words[1]).alias("expected_keywords"), F.when(F.col("item_id") % 3 == 0, "faq").otherwise("policy").alias("doc_type"), F.concat(F.lit("c"), F.col("item_id") % 4).alias("category"))


def _ranked(spark, d):
    c = _chunks(spark, d)
    hits = r.bm25_top(c, _queries(spark, d), TOP_N).join(c, "id").withColumn("page", F.lit(0))
    return r.first_match(hits, _questions(spark, d))


def recall_mrr(spark, d):
    return r.recall_mrr(_ranked(spark, d), TOP_K).select("scored", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


def recall_by_group(spark, d):
    g = r.recall_mrr(_ranked(spark, d), TOP_K, ["category", "doc_type"])
    return g.select("category", "doc_type", "scored", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


def rerank_topk(spark, d):
    hits = r.bm25_top(_chunks(spark, d), _queries(spark, d), TOP_N)
    return r.rerank(hits, ((F.col("id") * 7) % 100).cast("double"), TOP_K, 20.0).select("query_id", "id", "final_rank")


def _parents(spark, d):
    return table(spark, d, "documents").select(F.concat(F.lit("p"), F.col("doc_id")).alias("id"), "text")


def parent_expand_budget(spark, d):
    c = _chunks(spark, d)
    hits = r.bm25_top(c, _queries(spark, d), 10).join(c.select("id", "text"), "id")
    hits = hits.withColumn("parent_id", F.expr("case when id % 11 = 0 then '' else concat('p', id - id % 2) end")).withColumn("chunk_kind", F.expr("case when id % 7 = 0 then 'image' else 'child' end")).withColumn("text", F.concat(F.lit("own "), F.col("id")))
    e = r.expand_parents(hits, _parents(spark, d), 1500, 5)
    return e.select("query_id", "id", "rank", "context_source", F.length("context_text").cast("long").alias("n"), F.md5("context_text").alias("h"))


def chunk_upsert(spark, d):
    c = _chunks(spark, d).select("id", F.md5("text").alias("h"), "lang")
    new = c.where("id % 3 = 0").select((F.col("id") + F.when(F.col("id") % 2 == 0, 0).otherwise(10_000_000)).alias("id"), F.lit("new").alias("h"), "lang")
    return r.upsert(c, new, "id")


def version_swap(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.explode(F.array(F.lit("v1"), F.lit("v2"))).alias("version_id"))
    now = table(spark, d, "documents").select("doc_id", F.expr("case when doc_id % 4 = 0 then 'v1' else 'v2' end").alias("version_id"))
    return r.swap_versions(c, now)


def citation_images(spark, d):
    doc = table(spark, d, "documents")
    c = doc.select(F.col("doc_id").cast("string").alias("citation_id"), F.expr("concat('d', doc_id % 50)").alias("doc_id"), F.lit("v").alias("version_id"), F.expr("case when doc_id % 5 = 0 then concat('i', doc_id % 90) else '' end").alias("image_id"), F.expr("case when doc_id % 3 = 0 then concat('h', doc_id % 4) else '' end").alias("heading_path"), (F.col("doc_id") % 6).alias("page"))
    i = doc.select(F.expr("concat('i', doc_id)").alias("id"), F.expr("concat('d', doc_id % 50)").alias("doc_id"), F.lit("v").alias("version_id"), F.expr("concat('h', doc_id % 8)").alias("heading_path"), (F.col("doc_id") % 12).alias("page"))
    return r.citation_images(c, i)


def messages_with_citations(spark, d):
    m = table(spark, d, "conversations").select("conv_id").distinct()
    cites = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.length("text").alias("n"))
    n = r.nest(m, cites, "conv_id", "turn", ["turn", "n"], "cites")
    return n.select("conv_id", F.array_join(F.transform("cites", lambda c: F.concat_ws(":", c["turn"], c["n"])), ",").alias("cites"))


def conversion_cache_misses(spark, d):
    f = table(spark, d, "pages").select(F.col("page_id").alias("path"), F.encode("html", "UTF-8").alias("content"))
    seen = f.where("path % 3 = 0").select(F.sha2(F.concat("content", F.encode(F.lit("v1"), "UTF-8")), 256).alias("key"))
    return r.uncached(f, seen, "v1").select("path", "key")


def reindex_worklist(spark, d):
    doc = table(spark, d, "documents")
    v = doc.select(F.expr("concat('v', doc_id)").alias("id"), F.expr("concat('k', doc_id)").alias("storage_key"), (F.col("doc_id") % 3).cast("int").alias("attempt"))
    return r.reindex_worklist(v, doc.select("doc_id", F.expr("concat('v', doc_id)").alias("current_version_id")), doc.where("doc_id % 4 != 0").select(F.expr("concat('k', doc_id)").alias("storage_key")))


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_index, indexed_topk, dense_topk, rrf_hybrid, filtered_bm25, recall_mrr, recall_by_group, rerank_topk, parent_expand_budget, chunk_upsert, version_swap, citation_images, messages_with_citations, conversion_cache_misses, reindex_worklist)}

_TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"


def _bm25(where: str, n: int, name: str = "bm") -> str:
    return f"""t AS (SELECT doc_id id, {_TOK} ws FROM documents WHERE {where}),
sz AS (SELECT count(*) n, avg(len(ws)) avgdl FROM t),
q AS (SELECT query_id, term, count(*) qtf FROM (SELECT item_id query_id, unnest({_TOK}) term FROM benchmark) GROUP BY ALL),
po AS (SELECT id, dl, term, count(*) tf FROM (SELECT id, len(ws) dl, unnest(ws) term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
idf AS (SELECT term, ln(1 + ((SELECT n FROM sz) - count(*) + 0.5) / (count(*) + 0.5)) idf FROM po GROUP BY term),
sc AS (SELECT query_id, id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT avgdl FROM sz))) * qtf) score FROM po JOIN idf USING (term) JOIN q USING (term) GROUP BY ALL),
{name} AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INT) rank FROM sc QUALIFY rank <= {n})"""


_DENSE = """dn AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INT) rank FROM (SELECT q.vec_id query_id, v.vec_id id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) score FROM embeddings v, embeddings q WHERE {w}) QUALIFY rank <= {n})"""
_HITS = _bm25("true", TOP_N)
_FIRST = f"""{_HITS}, x AS (SELECT item_id query_id, 'src' || (item_id % 20) src, [lower(text).split(' ')[1], lower(text).split(' ')[2]] kw, CASE WHEN item_id % 3 = 0 THEN 'faq' ELSE 'policy' END doc_type, 'c' || (item_id % 4) category FROM benchmark),
m AS (SELECT query_id, min(rank) rank FROM bm JOIN documents d ON d.doc_id = bm.id JOIN x USING (query_id) WHERE contains(d.source, src) AND (contains(regexp_replace(lower(d.text), '\\s+', '', 'g'), regexp_replace(kw[1], '\\s+', '', 'g')) OR contains(regexp_replace(lower(d.text), '\\s+', '', 'g'), regexp_replace(kw[2], '\\s+', '', 'g'))) GROUP BY query_id),
fm AS (SELECT x.*, rank FROM x LEFT JOIN m USING (query_id))"""
_METRICS = "count(*) scored, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) recall, round(sum(coalesce(1.0 / rank, 0)) / count(*), 6) mrr"

ORACLE_SQL = {
    "bm25_topk": f"WITH {_HITS} SELECT query_id, id, rank, round(score, 6) score FROM bm",
    "bm25_index": f"WITH t AS (SELECT doc_id id, {_TOK} ws FROM documents), sz AS (SELECT avg(len(ws)) avgdl FROM t), po AS (SELECT id, dl, term, count(*) tf FROM (SELECT id, len(ws) dl, unnest(ws) term FROM t) GROUP BY ALL) SELECT term, count(*) df, round(max(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT avgdl FROM sz)))), 6) best FROM po GROUP BY term",
    "indexed_topk": f"WITH {_HITS} SELECT query_id, id, rank, round(score, 6) score FROM bm",
    "dense_topk": "WITH " + _DENSE.format(w="q.vec_id % 50 = 0", n=10) + " SELECT query_id, id, rank, round(score, 4) score FROM dn",
    "rrf_hybrid": f"WITH {_bm25('true', TOP_N)}, " + _DENSE.format(w="q.vec_id IN (SELECT item_id FROM benchmark) AND v.vec_id IN (SELECT doc_id FROM documents)", n=TOP_N) + ", f AS (SELECT query_id, id, sum(1.0 / (60 + rank)) score FROM (SELECT query_id, id, rank FROM bm WHERE query_id IN (SELECT vec_id FROM embeddings) UNION ALL SELECT query_id, id, rank FROM dn) GROUP BY ALL) SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INT) rank, round(score, 8) score FROM f QUALIFY rank <= 3",
    "filtered_bm25": f"WITH {_bm25("lang IN ('en', 'fr') AND source = 'src0'", 5)} SELECT query_id, id, rank FROM bm",
    "recall_mrr": f"WITH {_FIRST} SELECT {_METRICS} FROM fm",
    "recall_by_group": f"WITH {_FIRST} SELECT category, doc_type, {_METRICS} FROM fm GROUP BY GROUPING SETS ((category), (doc_type))",
    "rerank_topk": f"WITH {_HITS}, h AS (SELECT *, id * 7 % 100 s, count(*) OVER (PARTITION BY query_id) n FROM bm), k AS (SELECT * FROM h WHERE n <= 3 OR s >= 20) SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n <= 3 THEN 0 ELSE s END DESC, rank) AS INT) final_rank FROM k QUALIFY final_rank <= 3",
    "parent_expand_budget": f"""WITH {_bm25('true', 10)}, h AS (SELECT query_id, id, rank, CASE WHEN id % 11 = 0 THEN '' ELSE 'p' || (id - id % 2) END pid, id % 7 = 0 img FROM bm),
f AS (SELECT query_id, pid, min(rank) r FROM h WHERE pid != '' AND NOT img GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r) k FROM f QUALIFY k <= 5), p AS (SELECT *, 3000 // count(*) OVER (PARTITION BY query_id) per FROM c),
j AS (SELECT h.*, per, d.text t FROM h LEFT JOIN p USING (query_id, pid) LEFT JOIN documents d ON 'p' || d.doc_id = pid),
o AS (SELECT *, per IS NOT NULL AND coalesce(t, '') != '' use FROM j), z AS (SELECT query_id, id, rank, CASE WHEN use THEN 'parent' ELSE 'child' END context_source, CASE WHEN NOT use THEN 'own ' || id WHEN length(t) <= per THEN t ELSE rtrim(substr(t, 1, per - 1), ' ') || '…' END c FROM o)
SELECT query_id, id, rank, context_source, CAST(length(c) AS BIGINT) n, md5(c) h FROM z""",
    "chunk_upsert": "WITH n AS (SELECT doc_id + CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 10000000 END id, 'new' h, lang FROM documents WHERE doc_id % 3 = 0) SELECT doc_id id, md5(text) h, lang FROM documents WHERE doc_id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n",
    "version_swap": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'v1' ELSE 'v2' END version_id FROM documents",
    "messages_with_citations": "SELECT conv_id, coalesce(string_agg(turn || ':' || length(text), ',' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') cites FROM conversations GROUP BY conv_id",
    "conversion_cache_misses": "SELECT page_id AS path, sha256(html || 'v1') AS \"key\" FROM pages WHERE sha256(html || 'v1') NOT IN (SELECT sha256(html || 'v1') FROM pages WHERE page_id % 3 = 0)",
    "reindex_worklist": "SELECT doc_id, 'v' || doc_id version_id, CAST(doc_id % 3 + 1 AS INT) attempt, CASE WHEN doc_id % 4 != 0 THEN 'queue' ELSE 'skip' END AS action FROM documents",
    "citation_images": """WITH c AS (SELECT CAST(doc_id AS VARCHAR) citation_id, 'd' || (doc_id % 50) d, CASE WHEN doc_id % 5 = 0 THEN 'i' || (doc_id % 90) ELSE '' END img, CASE WHEN doc_id % 3 = 0 THEN 'h' || (doc_id % 4) ELSE '' END h, doc_id % 6 pg FROM documents),
i AS (SELECT 'i' || doc_id id, 'd' || (doc_id % 50) d, 'h' || (doc_id % 8) h, doc_id % 12 pg FROM documents),
r AS (SELECT citation_id, i.id, row_number() OVER (PARTITION BY citation_id ORDER BY i.id) - 1 k FROM c JOIN i ON c.d = i.d AND CASE WHEN c.h != '' THEN c.h = i.h ELSE c.pg = i.pg END WHERE img = '' QUALIFY k < 3)
SELECT citation_id, img image_id, CAST(0 AS INT) AS position FROM c WHERE img IN (SELECT id FROM i) UNION ALL SELECT citation_id, id, CAST(k AS INT) FROM r""",
}
