"""Hybrid retrieval: metadata filter, exact dense and BM25 top-n, reciprocal-rank fusion, re-ranking, parent expansion, evaluation."""

from __future__ import annotations

from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import cut

K1, B, RRF_K = 1.2, 0.75, 60
#: Queries searched in one pass, and terms (or vector elements) of a pass; more queries take more passes.
QUERY_BLOCK, BLOCK_TERMS = 1024, 1 << 20
#: Scores, or (chunk, query, term) products, that a task holds at once.
CELLS = 1 << 20
#: Filter fields by type; others are ignored.
TEXT_FIELDS = ("doc_id", "version_id", "doc_type", "chunk_type", "chunk_kind", "clause_no", "step_no", "faq_id", "table_id", "parent_id", "image_id", "section", "title", "domain", "project_id", "org_unit_id", "classification", "source", "lang")
INT_FIELDS = ("page", "row_index")
#: Kinds of chunk that carry their own context.
SELF_CONTAINED = ("table_row", "table_summary", "image")


def filter_expr(tenant_id: str | None, filters: dict | None, visible: Column | None = None) -> Column:
    """Conjunction of tenant, scalar equality, ``in`` lists and ``heading_path`` prefix; unknown fields and empty values don't count."""
    clean = lambda v: str(v).replace("\\", "").replace('"', "")
    out = F.lit(True) if tenant_id is None else F.col("tenant_id") == clean(tenant_id)
    for field, value in (filters or {}).items():
        if value is None or value == "" or value == []:
            continue
        if field == "heading_path":
            out = out & F.col(field).startswith(clean(value))
        elif field in TEXT_FIELDS or field in INT_FIELDS:
            cast = int if field in INT_FIELDS else clean
            out = out & (F.col(field).isin(*map(cast, value)) if isinstance(value, (list, tuple, set)) else F.col(field) == cast(value))
    return out if visible is None else out & visible


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; one token per Han character."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0))


class QueryTerms:
    """Some queries as a sparse table: the queries of each term, and how often they have it."""

    def __init__(self, texts: list[list[str]]):
        held = [Counter(ts) for ts in texts]
        self.n = len(held)
        self.terms = sorted({w for c in held for w in c})
        code = {w: k for k, w in enumerate(self.terms)}
        pairs = sorted((code[w], j, c) for j, h in enumerate(held) for w, c in h.items())
        at, self.query, self.times = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ((), (), ())))
        self.start = np.searchsorted(at, np.arange(len(self.terms) + 1))


def _blocks(rows, query: int, size):
    """Lists of rows of at most ``query`` each, and of about BLOCK_TERMS in ``size``."""
    held, total = [], 0
    for r in rows:
        if held and (len(held) == query or total + size(r) > BLOCK_TERMS):
            yield held
            held, total = [], 0
        held.append(r)
        total += size(r)
    if held:
        yield held


def matched_terms(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """id, dl (tokens of the chunk) and, of the given terms that it has, ``code`` (place in ``terms``) and ``tf``; one pass over the texts."""
    spark = chunks.sparkSession
    kind = chunks.schema["id"].dataType.simpleString()
    sent = spark.sparkContext.broadcast(terms)

    def run(batches):
        known = pa.array(sent.value, pa.string())
        for b in batches:
            words = b.column(1)
            size = np.diff(words.offsets.to_numpy())
            code = pc.fill_null(pc.index_in(words.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), size)[code >= 0]
            cell, tf = np.unique(row * max(1, len(known)) + code[code >= 0], return_counts=True)
            row, code = np.divmod(cell, max(1, len(known)))
            ends = np.r_[0, np.cumsum(np.bincount(row, minlength=b.num_rows))].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (code, tf)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size.astype(np.int32)), *lists], names=["id", "dl", "code", "tf"])

    return chunks.select("id", tokens(F.col("text")).alias("t")).mapInArrow(run, f"id {kind}, dl int, code array<int>, tf array<int>")


def bm25_top(chunks: DataFrame, queries: DataFrame, n: int, k1: float = K1, b: float = B, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, id, score, rank of the best ``n`` chunks (id, text) per query (query_id, text), exactly.

    Queries are a stated set, sent to the tasks a block at a time (at most ``block`` of them, and about
    BLOCK_TERMS terms).  Per block the texts are read once: what each chunk has of the block's terms is
    written to the checkpoint folder, and gives both the document frequencies and the scores.  A task adds up only
    the (chunk, query) pairs that share a term and passes on its best ``n`` per query, so what is shuffled grows with
    tasks and queries, not with the corpus.  For many searches of one corpus see ``inverted``.

    Defined cases: ids and query ids of any type that Arrow carries; the rows of one query id (null is one) are one query of all their
    words; null texts have no words; chunks without a common word aren't listed; ties rank by id.
    """
    spark = chunks.sparkSession
    kind, of = (d.schema[c].dataType for d, c in ((chunks, "id"), (queries, "query_id")))
    schema = f"query_id {of.simpleString()}, id {kind.simpleString()}, score double"
    out = None

    def search(part):
        ids, q = [r.query_id for r in part], QueryTerms([r.t for r in part])
        held = cut(matched_terms(chunks, q.terms))
        size = held.agg(F.count(F.lit(1)).alias("N"), F.avg("dl").alias("avgdl")).first()
        df = np.zeros(len(q.terms))
        for r in held.select(F.explode("code").alias("c")).groupBy("c").count().collect():  # as many rows as the block has terms, at most
            df[r["c"]] = r["count"]
        weight = q.times * np.repeat(np.log(1 + (size.N - df + 0.5) / (df + 0.5)), np.diff(q.start))
        sent = spark.sparkContext.broadcast((q.n, q.start, q.query, weight, size.avgdl, pa.array(ids, to_arrow_type(of))))

        def run(batches):
            nq, start, query, weight, avgdl, names = sent.value
            best = Best(nq, n)
            for batch in batches:
                lists = batch.column(2)
                ends = lists.offsets.to_numpy()
                code, tf = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
                dl = np.repeat(batch.column(1).to_numpy(), np.diff(ends))
                v = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
                every = start[code + 1] - start[code]
                pairs, lo = np.r_[0, np.cumsum(every)][ends - ends[0]], 0
                while lo < batch.num_rows:
                    hi = min(lo + max(1, CELLS // nq), batch.num_rows, max(lo + 1, int(np.searchsorted(pairs, pairs[lo] + CELLS, "right")) - 1))
                    at = slice(ends[lo] - ends[0], ends[hi] - ends[0])
                    c, many = code[at], every[at]
                    row = np.repeat(np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1])), many)
                    pair = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[c], many)
                    score = np.bincount(row * nq + query[pair], np.repeat(v[at], many) * weight[pair], (hi - lo) * nq).reshape(hi - lo, nq)
                    best.add(score, batch.column(0).slice(lo, hi - lo), 0.0)
                    lo = hi
            yield from best.rows(names)

        return held.where(F.size("code") > 0).mapInArrow(run, schema)

    rows = queries.select("query_id", tokens(F.col("text")).alias("t")).groupBy("query_id").agg(F.flatten(F.collect_list("t")).alias("t")).orderBy("query_id")
    for part in _blocks(rows.toLocalIterator(), block, lambda r: len(r.t)):
        found = search(part)
        out = found if out is None else out.unionByName(found)
    return _top(spark.createDataFrame([], schema) if out is None else out, n)


class Best:
    """A task's running best ``n`` keys of each query; ties at the edge stay for the ranking that follows, the least keys of them."""

    def __init__(self, queries: int, n: int):
        self.n, self.keys, self.scores = n, [None] * queries, [np.zeros(0)] * queries
        self.edge = np.full(queries, -np.inf)

    def add(self, score: np.ndarray, keys: pa.Array, above: float, which: np.ndarray | None = None) -> None:
        """``score`` has a row per key and a column per query (of ``which``, if given); only scores over ``above`` count."""
        which = np.arange(score.shape[1]) if which is None else which
        row, col = np.nonzero((score > above) & (score >= self.edge[which] - 1e-9))
        order = np.lexsort((row, col))
        row, col = row[order], col[order]
        cuts = np.flatnonzero(np.r_[True, col[1:] != col[:-1], True]) if len(col) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            q, at = which[col[lo]], row[lo:hi]
            mine, s = keys.take(pa.array(at)), np.r_[self.scores[q], score[at, col[lo]]]
            mine = mine if self.keys[q] is None else pa.concat_arrays([self.keys[q], mine])
            if len(s) > self.n:
                edge = np.partition(s, len(s) - self.n)[len(s) - self.n]
                sure, tied = np.flatnonzero(s > edge + 1e-9), np.flatnonzero(np.abs(s - edge) <= 1e-9)
                tied = tied[pc.array_sort_indices(mine.take(pa.array(tied)), null_placement="at_start").to_numpy()[: self.n]]
                self.edge[q], keep = edge, np.r_[sure, tied]
                mine, s = mine.take(pa.array(keep)), s[keep]
            self.keys[q], self.scores[q] = mine, s

    def rows(self, names: pa.Array):
        """Batches of query_id, id, score; ``names`` has the queries' ids."""
        for q, k in enumerate(self.keys):
            if k is not None:
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.full(len(k), q))), k, pa.array(self.scores[q])], names=["query_id", "id", "score"])


def _top(scored: DataFrame, n: int) -> DataFrame:
    """Best ``n`` per query by score, then id; scores are compared to nine decimals so that sums in any order tie alike."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def sound_vectors(df: DataFrame) -> Column:
    """``vector`` as doubles; null if it is, is empty or has an element that is null, infinite or not a number."""
    v = F.col("vector").cast("array<double>")
    return F.when((F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)), v)


def unit_rows(vectors: pa.ListArray, width: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def dense_top(chunks: DataFrame, queries: DataFrame, n: int, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, id, score, rank of the ``n`` chunks (id, vector) nearest by cosine to each query (query_id, vector), exactly.

    Each task multiplies its vectors with a block of query vectors and passes on its own
    best ``n`` per query, so what is shuffled does not grow with the corpus but with tasks.

    Defined cases: ids and query ids of any type that Arrow carries; vectors that aren't sound (``sound_vectors``) match nothing;
    vectors meet only vectors of their own length; a zero vector is at 0 from all; a query id with several vectors counts
    each chunk by the nearest of them; ties rank by id.
    """
    spark = chunks.sparkSession
    kind, of = (d.schema[c].dataType for d, c in ((chunks, "id"), (queries, "query_id")))
    schema = f"query_id {of.simpleString()}, id {kind.simpleString()}, score double"
    rows = queries.select("query_id", sound_vectors(queries).alias("v")).where("v is not null").orderBy(F.size("v"), "query_id")
    held = chunks.select("id", sound_vectors(chunks).alias("v"))
    out = None

    def search(part):
        width = len(part[0].v)
        m = np.array([r.v for r in part])
        sent = spark.sparkContext.broadcast((m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300), pa.array([r.query_id for r in part], to_arrow_type(of))))

        def run(batches):
            q, names = sent.value
            best = Best(len(q), n)
            for b in batches:
                for lo in range(0, b.num_rows, step := max(1, CELLS // len(q))):
                    some = b.slice(lo, step)
                    best.add(unit_rows(some.column(1), width) @ q.T, some.column(0), -np.inf)
            yield from best.rows(names)

        return held.where(F.size("v") == width).mapInArrow(run, schema)

    for width, same in groupby(rows.toLocalIterator(), lambda r: len(r.v)):
        for part in _blocks(same, block, lambda r: width):
            found = search(part)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    return _top(out.groupBy("query_id", "id").agg(F.max("score").alias("score")), n)


def rrf(lists: list[DataFrame], n: int, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (query_id, id, rank): score is the sum of 1 / (k + rank)."""
    every = None
    for ranked in lists:
        part = ranked.select("query_id", "id", "rank")
        every = part if every is None else every.unionByName(part)
    return _top(every.groupBy("query_id", "id").agg(F.sum(1 / (k + F.col("rank"))).alias("score")), n)


def hybrid_search(chunks: DataFrame, queries: DataFrame, n: int = 20, where: Column | None = None, k: int = RRF_K) -> DataFrame:
    """Both routes over the same filtered chunks (id, text, vector), fused; the filter is applied once, before scoring."""
    c = chunks if where is None else chunks.where(where)
    return rrf([dense_top(c, queries, n), bm25_top(c, queries, n)], n, k)


def rerank(hits: DataFrame, score: Column, top_k: int, min_score: float | None = None) -> DataFrame:
    """Best ``top_k`` per query by ``score``, then fused rank; queries with no more than ``top_k`` hits keep their order and all hits."""
    by_query = Window.partitionBy("query_id")
    h = hits.withColumn("_n", F.count(F.lit(1)).over(by_query)).withColumn("_s", score)
    few = F.col("_n") <= top_k
    h = h.where(few | F.lit(min_score is None) | (F.col("_s") >= F.lit(min_score if min_score is not None else 0.0)))
    order = by_query.orderBy(F.when(few, F.lit(0.0)).otherwise(F.col("_s")).desc(), "rank")
    return h.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= top_k).drop("_n", "_s")


def scores_by_position(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores (query_id, scores array in candidate order) put beside the hits they belong to."""
    flat = scores.select("query_id", F.posexplode("scores").alias("_p", "rerank_score")).withColumn("rank", F.col("_p") + 1).drop("_p")
    return hits.join(flat, ["query_id", "rank"], "left")


def with_defaults(hits: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Nulls of the listed columns replaced; columns that are missing added."""
    return hits.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in hits.columns else F.lit(v) for c, v in defaults.items()})


def truncate(text: Column, budget: Column, marker: str = "…") -> Column:
    """Head of the text inside a budget of characters, with a marker; budgets of 0 or less don't cut."""
    t = F.coalesce(text, F.lit(""))
    head = F.rtrim(F.substring(t, F.lit(1), F.greatest(budget - len(marker), F.lit(1)).cast("int")))
    return F.when((budget <= 0) | (F.length(t) <= budget), t).otherwise(F.concat(head, F.lit(marker)))


def expand_parents(hits: DataFrame, parents: DataFrame, token_budget: int, max_parents: int, chars_per_token: int = 2, least: int = 400) -> DataFrame:
    """Hits (query_id, rank, text, parent_id, chunk_kind) with ``context_text`` and ``context_source``.

    The first distinct parents of a query, as many as the budget carries at a useful
    size, share it evenly; other hits and missing parents keep their own text.  A self-contained
    kind selects no parent, but shows one that another hit has selected.
    """
    budget = max(token_budget, 1) * chars_per_token
    limit = min(max(max_parents, 1), max(budget // least, 1))
    open_ = (F.coalesce("parent_id", F.lit("")) != "") & ~F.coalesce("chunk_kind", F.lit("child")).isin(*SELF_CONTAINED)
    first = hits.where(open_).groupBy("query_id", "parent_id").agg(F.min("rank").alias("_f"))
    first = first.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("_f"))).where(F.col("_r") <= limit)
    chosen = first.withColumn("_per", F.expr(f"{budget} div count(1) over (partition by query_id)")).select("query_id", "parent_id", "_per")
    h = hits.join(chosen, ["query_id", "parent_id"], "left").join(parents.select(F.col("id").alias("parent_id"), F.col("text").alias("_pt")), "parent_id", "left")
    use = F.col("_per").isNotNull() & (F.coalesce("_pt", F.lit("")) != "")
    return h.withColumn("context_text", F.when(use, truncate(F.col("_pt"), F.col("_per"))).otherwise(F.coalesce("text", F.lit("")))).withColumn("context_source", F.when(use, "parent").otherwise("child")).drop("_per", "_pt")


def citation_images(citations: DataFrame, images: DataFrame, most: int = 3) -> DataFrame:
    """citation_id, image_id, position: by explicit image; else, with a heading path, by heading (even if none); else by page."""
    c = citations.select("citation_id", "doc_id", "version_id", "image_id", "heading_path", "page")
    i = images.select(F.col("id").alias("_img"), F.col("doc_id").alias("_d"), F.col("version_id").alias("_v"), F.col("heading_path").alias("_h"), F.col("page").alias("_pg"))
    has = lambda n: F.coalesce(F.col(n), F.lit("")) != ""

    def best(*keys):  # no citation takes more of a place's images than its first ones
        return i.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_img"))).where(F.col("_k") <= most).drop("_k")

    own = c.where(has("image_id")).join(i, c["image_id"] == i["_img"]).select("citation_id", "_img", F.lit(0).alias("_r"))
    by_head, by_page = best("_d", "_h"), best("_d", "_pg", "_v")
    head = c.where(~has("image_id") & has("heading_path")).join(by_head, (c["doc_id"] == by_head["_d"]) & (c["heading_path"] == by_head["_h"]))
    page = c.where(~has("image_id") & ~has("heading_path")).join(by_page, (c["doc_id"] == by_page["_d"]) & (c["page"] == by_page["_pg"]) & (c["version_id"] == by_page["_v"]))
    rest = head.select("citation_id", "_img").unionByName(page.select("citation_id", "_img")).withColumn("_r", F.row_number().over(Window.partitionBy("citation_id").orderBy("_img")) - 1).where(F.col("_r") < most)
    return own.unionByName(rest.select("citation_id", "_img", "_r")).select("citation_id", F.col("_img").alias("image_id"), F.col("_r").cast("int").alias("position"))


def nest(parents: DataFrame, children: DataFrame, key: str, order: str, fields: list[str], name: str) -> DataFrame:
    """Parents with the array of their children in order (empty if none)."""
    listed = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *[f for f in fields if f != order]))).alias(name))
    return parents.join(listed, key, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(listed.schema[name].dataType)))


def keyword_present(keyword: Column, text: Column) -> Column:
    """Contained without regard to case and blanks, or all of its words are."""
    norm = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", "")
    t = norm(text)
    words = F.filter(F.split(F.lower(keyword), r"(?U)\s+"), lambda w: w != "")
    return t.contains(norm(keyword)) | ((F.size(words) > 1) & F.forall(words, lambda w: t.contains(w)))


def first_match(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions with ``rank`` of their first hit whose title holds the expected source and whose page or any keyword fits (null: none).

    Questions: query_id, expected_source, source_page, expected_keywords.  Hits: query_id, rank, title, page, text.
    """
    h = hits.join(questions.select("query_id", "expected_source", "source_page", "expected_keywords"), "query_id")
    fits = h["title"].contains(h["expected_source"]) & ((F.col("page") == F.col("source_page")) | F.exists("expected_keywords", lambda k: keyword_present(k, F.col("text"))))
    ranks = h.where(fits).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return questions.join(ranks, "query_id", "left")


def recall_mrr(ranked: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """scored, recall (rank at most ``k``) and mrr over all questions, or per single grouping column by GROUPING SETS."""
    hit = (F.coalesce(F.col("rank"), F.lit(1 << 30)) <= k).cast("double")
    aggs = [F.count(F.lit(1)).alias("scored"), F.avg(hit).alias("recall"), (F.sum(F.coalesce(1 / F.col("rank"), F.lit(0.0))) / F.count(F.lit(1))).alias("mrr")]
    if not by:
        return ranked.agg(*aggs)
    return ranked.groupingSets([[F.col(c)] for c in by], *(F.col(c) for c in by)).agg(*aggs)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` whose key ``new`` lacks, and all of ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_where(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def swap_versions(chunks: DataFrame, published: DataFrame) -> DataFrame:
    """Chunks of the version that is current per document (doc_id, version_id); those of other versions go."""
    return chunks.join(published.select("doc_id", "version_id"), ["doc_id", "version_id"], "left_semi")


def reindex_worklist(versions: DataFrame, documents: DataFrame, files: DataFrame) -> DataFrame:
    """Current versions with the attempt to make and whether their stored file exists."""
    f = files.select("storage_key", F.lit(True).alias("_e")).distinct()
    w = documents.join(versions, documents["current_version_id"] == versions["id"]).join(f, "storage_key", "left")
    return w.select("doc_id", F.col("id").alias("version_id"), (F.coalesce("attempt", F.lit(0)) + 1).alias("attempt"), F.when(F.col("_e"), "queue").otherwise("skip").alias("action"))


def query_key(query: Column, tenant: Column, top_n: int, top_k: int, scope: Column) -> Column:
    """SHA-1 of the canonical JSON of what a retrieval result depends on."""
    return F.sha1(F.to_json(F.struct(query.alias("query"), F.lit(top_k).alias("top_k"), F.lit(top_n).alias("top_n"), scope.alias("scope"), tenant.alias("tenant"))))


def uncached(files: DataFrame, cache: DataFrame, signature: str) -> DataFrame:
    """Files (path, content) whose content hash under this converter signature is not in the cache (key)."""
    key = F.sha2(F.concat(F.col("content"), F.encode(F.lit(signature), "UTF-8")), 256)
    return files.withColumn("key", key).join(cache.select("key"), "key", "left_anti")
