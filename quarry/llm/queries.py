"""The queries ``opN_<name>``: each operator over its whole table, with the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, divergence, fingerprint, merkle, mixing, pii, quality, repeats, secret_scan, sharding, simhash, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, docs = mixing.mix(_read(spark, sf_dir, "documents"))
    return docs.select("doc_id", "size", "source_size", "target", "taken")


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"))


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fingerprint.edited_prints(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint.as_text(d["prints"]).alias("fingerprint"),
        fingerprint.as_text(d["edited_prints"]).alias("edited_fingerprint"),
        fingerprint.likeness(d["prints"], d["edited_prints"]).alias("near_edited"),
        fingerprint.likeness(d["prints"], d["next_prints"]).alias("near_next"),
    )


def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored, out = quality.score(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))
    s = F.col(out)["score"]
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted"))


def op5_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found, out = pii.find_pii(docs, pii.fit(docs))
    base = F.filter(out, lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["s"], s["e"])), ",")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in pii.BASE]
    every = F.size(out).cast("long")
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col(out)).alias("spans"), every.alias("n_spans"), (every > 0).alias("personal"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, hits = decontaminate.find_passages(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    h = F.col(hits)
    n_hit = F.aggregate(h["spans"], F.lit(0).cast("long"), lambda a, s: a + (s["e"] - s["s"]))
    return docs.select(
        "doc_id",
        h["n_words"].alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(h["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(h["items"], ","), 256).alias("items_sha256"),
        (F.size(h["spans"]) > 0).alias("contaminated"),
    )


def op7_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = repeats.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["e"] - s["s"])
    return d.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_format.read_back(chat_format.format_turns(turns.unionByName(more)))


#: The rules of the contract, as host/path prefixes.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed: the canonical URLs of pages that were reached through a feed (``utm_source=`` in the query)."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    j = F.col("judged")
    judged = url_filter.judge_urls(pages, pages.where(F.col("url").contains("utm_source=")), URL_RULES)
    return judged.select("page_id", j["host"].alias("host"), j["path"].alias("path"), j["rule"].alias("rule"), j["verdict"].alias("verdict"))


def op11_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, out = secret_scan.find_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter(out, lambda s: s["kind"] != "novel")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["s"], s["e"])), ",")
    count = lambda k: F.size(F.filter(out, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, secret_scan.KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col(out)).alias("spans"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    marked = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    leaves = merkle.manifest(docs, {"text": F.when(marked, F.translate("text", "\n", "")).otherwise(F.col("text"))})
    proof = F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256")
    return leaves.select("doc_id", "leaf", "subroot", "root", proof, F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents").select("lang", "source", "text"))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_kd_shards": op2_kd_shards,
    "op3_imatch": op3_imatch,
    "op4_quality_crf": op4_quality_crf,
    "op5_pii_crf": op5_pii_crf,
    "op6_decontaminate": op6_decontaminate,
    "op7_simhash_trie": op7_simhash_trie,
    "op8_suffix_repeats": op8_suffix_repeats,
    "op9_chat_format": op9_chat_format,
    "op10_url_filter": op10_url_filter,
    "op11_secret_novelty": op11_secret_novelty,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_source_divergence": op13_source_divergence,
}

_HOST = r"CASE WHEN position('://' IN url) > 0 THEN translate(regexp_extract(substr(url, position('://' IN url) + 3), '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
_PATH = r"CASE WHEN position('://' IN url) > 0 THEN regexp_extract(substr(url, position('://' IN url) + 3), '^([^/?#]*)([^?#]*)', 2) ELSE '' END"
_FITS = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}'))"
_BY_LENGTH = sorted(URL_RULES, key=lambda r: -len(r[0]))


def _merkle_sql(levels: int = 8) -> str:
    """SQL of ``op12_merkle_manifest`` for sources of at most 3 ** levels rows: one step of folding each for the sources' trees and the root's."""
    leaf = lambda text: "sha256(" + " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = "list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)"
    step = """{r}{a} AS (SELECT t, i // 3 j, any_value(n) n, list(h ORDER BY i) l FROM {n}{a} GROUP BY t, i // 3),
{n}{b} AS (SELECT t, j i, (n + 2) // 3 n, CASE WHEN n = 1 THEN l[1] ELSE sha256(array_to_string(l, '')) END h FROM {r}{a}),
{f}{b} AS (SELECT * EXCLUDE (p, i, h, l, n), i // 3 i, CASE WHEN n = 1 THEN p ELSE p || array_to_string(l[1 : i % 3], '') || array_to_string(l[i % 3 + 2 :], '') END p,
CASE WHEN n = 1 THEN h ELSE sha256(array_to_string(l[1 : i % 3] || [h] || l[i % 3 + 2 :], '')) END h FROM (SELECT x.*, l, n FROM {f}{a} x JOIN {r}{a} y ON x.t = y.t AND x.i // 3 = y.j)),
"""
    up, top = ("".join(step.format(r=r, n=n, f=f, a=k, b=k + 1) for k in range(levels)) for r, n, f in (("sr", "sn", "sf"), ("tr", "tn", "tf")))
    return f"""
WITH d AS (SELECT doc_id, source, {leaf("text")} leaf, {leaf(f"CASE WHEN doc_id IS NOT NULL AND xor({crc}, 4294967295) & 1 = 0 THEN replace(text, chr(10), '') ELSE text END")} now FROM documents),
s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 t, count(*) OVER () trees FROM (SELECT DISTINCT source FROM documents)),
o AS (SELECT doc_id, leaf, now, t, trees, row_number() OVER w - 1 i, count(*) OVER (PARTITION BY t) n FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source WINDOW w AS (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf, now)),
sn0 AS (SELECT t, i, n, leaf h FROM o),
sf0 AS (SELECT doc_id, leaf, t, i, now h, '' p FROM o),
{up}tn0 AS (SELECT 0 t, u.t i, trees n, h FROM sn{levels} u JOIN s USING (t)),
tf0 AS (SELECT doc_id, leaf, u.h subroot, 0 t, x.t i, x.h, p FROM sf{levels} x JOIN sn{levels} u ON x.t = u.t),
{top}z AS (SELECT h root FROM tn{levels})
SELECT doc_id, leaf, subroot, root, sha256(p) proof_sha256, h folded_root, h = root verified FROM tf{levels}, z"""


ORACLE_SQL = {
    "op12_merkle_manifest": _merkle_sql(),
    "op6_decontaminate": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(ws)) n, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') g FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 8))) i FROM b WHERE len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) i FROM w, ns WHERE len(ws) >= n)),
h AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw USING (n, g)),
hw AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) n_items, string_agg(s, ',' ORDER BY s) ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) s FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM w LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op9_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') text FROM conversations
UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, length(text) + len(regexp_extract_all(text, '\\|<<SYS>>|<</SYS>>|</?s>|\[/?INST\]|\[/?ROLE\]|\[/TURN\]')) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 20 + length(role) END n,
row_number() OVER o - 1 AS seq, lag(role, 1, 'start') OVER o AS before, lead(role) OVER o AS after FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
g AS (SELECT *, CASE WHEN before || '>' || role IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AND (after IS NOT NULL OR role = 'assistant') THEN 0 ELSE 1 END bad FROM f)
SELECT conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) turns_sha256,
CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) loss_sha256,
CAST(sum(n) AS BIGINT) formatted_chars, coalesce(sum(bad), 0) = 0 AS valid, CAST(min(CASE WHEN bad = 1 THEN seq END) AS BIGINT) first_bad FROM g GROUP BY conv_id""",
    "op10_url_filter": f"""
WITH p AS (SELECT page_id, url, {_HOST} host, {_PATH} path FROM (SELECT page_id, coalesce(url, '') url FROM pages)),
k AS (SELECT DISTINCT host || path c FROM p WHERE contains(url, 'utm_source=') AND contains(url, '://'))
SELECT page_id, host, path, CASE {" ".join(f"WHEN {_FITS(*r.split('/', 1))} THEN '{r}'" for r, _ in _BY_LENGTH)} END AS rule,
CASE {" ".join(f"WHEN {_FITS(*r.split('/', 1))} THEN '{v}'" for r, v in _BY_LENGTH)} WHEN contains(url, '://') AND host || path IN (SELECT c FROM k) THEN 'block' ELSE 'allow' END AS verdict FROM p""",
    "op13_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () n, coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') ws FROM documents),
w AS (SELECT n, lang, source, unnest(ws) term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT n) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT g.lang, count(k.term) V FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN k USING (lang) GROUP BY g.lang),
c AS (SELECT lang, source, term, count(*) c FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
t AS (SELECT lang, source, sum(c) n FROM c GROUP BY lang, source),
gp AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) c, 1 + (1000000000 * (coalesce(c, 0) + 5)::HUGEINT) // (coalesce(n, 0) + 5 * V) p
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c USING (lang, source, term)),
lp AS (SELECT lang, term, 1 + (1000000000 * (sum(c) + 5)::HUGEINT) // (sum(sum(c)) OVER (PARTITION BY lang) + 5 * any_value(V)) q FROM c JOIN v USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source item, coalesce(s, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source item, sum(abs(x.p - y.p)) s FROM gp x JOIN gp y ON x.lang = y.lang AND x.term = y.term AND x.source != y.source GROUP BY ALL) z ON z.lang = a.lang AND z.source = a.source AND z.item = b.source),
terms AS (SELECT lang, source, term item, p - q AS value FROM gp JOIN lp USING (lang, term) WHERE c > 0 AND p > q),
every AS (SELECT *, 'pair' part, 9223372036854775807 most FROM pairs UNION ALL SELECT *, 'term', 50 FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) rank FROM every) WHERE rank <= most""",
}
