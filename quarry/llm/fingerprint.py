"""I-Match document fingerprints, with DataFrame functions only.

Terms whose document frequency lies in a band form the lexicon; a document's distinct
lexicon terms, sorted, are hashed once for each of several random subsets of the
lexicon.  Terms are told apart by their 64-bit XXH64.  At least a share LOW of all documents
holds each lexicon term, so there are at most (distinct terms of an average document) / LOW
of them, however many documents there are.  The lexicon is a table that documents' terms are
joined with: no plan and no variable of the driver holds its terms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, with_key

#: A term is kept if at least LOW and at most HIGH of all documents (and one more) hold it.
LOW, HIGH = 0.0005, 0.02
#: (bits, subsets): a subset keeps each term with probability 2^-bits; fine ones serve long texts, coarse ones short texts.
SCALES = ((4, 8), (6, 8), (8, 8), (10, 6))
#: A lexicon of at most so many terms is broadcast (some 50 MB); a larger one is joined as Spark sees fit.
BROADCAST_TERMS = 1 << 20
#: What the hash of an empty list of longs is.
EMPTY = 42
#: Rows of one range bucket of the next-document window, on average, and the ranges found from quantiles.
BUCKET_ROWS, RANGES = 1000, 64
#: Buckets at most, so that their first keys are a broadcast of at most 1 MB; larger tables have larger buckets.
MAX_BUCKETS = 1 << 16


def term_keys(text: Column) -> Column:
    """Hashes of the lower-cased terms between ASCII characters that are no letters or digits; repeats included."""
    words = F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


@dataclass
class Lexicon:
    """The band's term hashes, each once: a table of one column ``k``."""

    keys: DataFrame

    def holds(self, key: Column) -> Column:
        """Whether a hash is in the band; for conditions outside higher-order functions."""
        return key.isin(self.keys)


def lexicon(docs: DataFrame, text: str, low: float = LOW, high: float = HIGH) -> Lexicon:
    """The band: document frequencies are counted over all documents, per term; the terms kept are a bounded number (see above)."""
    n = docs.count()
    df = docs.select(F.explode(F.array_distinct(term_keys(docs[text]))).alias("k")).groupBy("k").count()
    kept = cut(df.where((F.col("count") >= low * n) & (F.col("count") <= 1 + high * n)).select("k"))
    return Lexicon(F.broadcast(kept) if kept.count() <= BROADCAST_TERMS else kept)


def hashed(terms: Column) -> list[Column]:
    """The terms' hashes of each scale."""
    of = lambda scale: F.transform(terms, lambda s: F.xxhash64(s, F.lit(scale)))
    return [of(scale) for scale in range(len(SCALES))]


def subset_hashes(hashes: list[Column]) -> Column:
    out = []
    for (bits, subsets), of_scale in zip(SCALES, hashes):
        for j in range(subsets):
            part = F.filter(of_scale, lambda h: F.shiftright(h, bits * j).bitwiseAND(F.lit((1 << bits) - 1).cast("long")) == 0)
            out.append(F.xxhash64(part).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.array(*out)


def digests(terms: Column) -> Column:
    """One 32-bit hash (as a long) for each lexicon subset: of the subset's terms in order."""
    return subset_hashes(hashed(terms))


def printed(d: DataFrame, by: list[str], row: Column, texts: dict[str, Column], lex: Lexicon) -> DataFrame:
    """``by``, the fields of the struct ``row`` and, under each name in ``texts``, the hashes of that text's sorted distinct lexicon terms.

    ``by`` tells the rows of ``d`` apart.  Terms are joined with the lexicon and gathered again by it; the
    struct travels with a row's first term only.  A text that has a term in no subset is hashed by all
    its distinct terms instead, in every place, so only texts of the same terms are like it.
    """
    each = [f"_terms{i}" for i in range(len(texts))]
    d = d.select(*by, row.alias("_row"), *(F.sort_array(F.array_distinct(term_keys(t))).alias(e) for e, t in zip(each, texts.values())))
    alone = F.struct(*(F.xxhash64(e).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias(e) for e in each))
    sizes = [f"_size{i}" for i in range(len(texts))]
    d = d.select(*by, F.struct("_row", alone.alias("_alone")).alias("_row"), *(F.size(e).alias(z) for e, z in zip(each, sizes)), F.concat(*each).alias("_every"))  # once a row
    d = d.select(*by, "_row", *sizes, F.posexplode_outer("_every").alias("_at", "_term"))
    d = d.join(lex.keys, F.col("_term") == F.col("k"), "left")
    first, kept = F.coalesce("_at", F.lit(0)) == 0, F.col("k").isNotNull()
    parts, start = [], F.lit(0)
    for e, z in zip(each, sizes):
        end = start + F.col(z)
        parts.append(F.when(kept & (F.col("_at") >= start) & (F.col("_at") < end), F.col("_term")).alias(e))
        start = end
    d = d.where(first | kept).select(*by, F.when(first, F.col("_row")).alias("_row"), *parts)
    d = d.groupBy(*by).agg(F.first("_row", ignorenulls=True).alias("_row"), *(F.sort_array(F.collect_list(e)).alias(e) for e in each))
    lists = {(i, scale): h for i, e in enumerate(each) for scale, h in enumerate(hashed(F.col(e)))}
    d = d.select(*by, "_row", *(h.alias(f"_h{i}_{scale}") for (i, scale), h in lists.items()))  # each list once
    d = d.select(*by, "_row", *(subset_hashes([F.col(f"_h{i}_{scale}") for scale in range(len(SCALES))]).alias(e) for i, e in enumerate(each)))
    out = [F.when(F.exists(e, lambda h: h != EMPTY), F.col(e)).otherwise(F.array_repeat(F.col("_row._alone")[e], sum(k for _, k in SCALES))).alias(name) for e, name in zip(each, texts)]
    return d.select(*by, "_row._row.*", *out)


def as_text(prints: Column) -> Column:
    return F.array_join(F.transform(prints, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets in which either document has a term; 1 if both have all equal."""
    used = F.filter(F.zip_with(a, b, lambda x, y: F.when((x != EMPTY) | (y != EMPTY), F.when(x == y, 1).otherwise(0))), lambda v: v.isNotNull())
    return F.when(a == b, F.lit(1.0)).otherwise(F.aggregate(used, F.lit(0), lambda s, v: s + v) / F.greatest(F.size(used), F.lit(1)))


def fingerprints(docs: DataFrame, lex: Lexicon, text: str = "text", out: str = "prints", id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """``docs`` with the array of hashes under a lexicon (the column's name is returned too).

    Null texts are empty; a text without lexicon terms is hashed by all its terms, so only
    texts of the same terms are like it; equal texts have equal hashes; texts are read whole;
    repeated rows and ids have equal hashes; an empty table stays empty; clashing names get an underscore.
    """
    out, key = free_name(docs, out), free_name(docs, "_key")
    d = with_key(docs, id_col, key)
    row = F.struct(*(d[f"`{c.replace('`', '``')}`"] for c in docs.columns))
    return printed(d, [key], row, {out: F.coalesce(d[text].cast("string"), F.lit(""))}, lex).drop(key), out


def dealt(d: DataFrame, key: str) -> DataFrame:
    """Rows with their range of the ``key`` (unique longs) as ``_b``, and each range's ghost: the first row of the range below it.

    The ghost (``_ghost``) is a range's last row, and the least range's is the row of the greatest key, so no
    window spans the whole table.
    """
    keys = d.select(key)
    stats = keys.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"), F.percentile_approx(key, [i / RANGES for i in range(1, RANGES)], 1000).alias("q")).first()
    if not stats.n:
        return d.withColumn("_b", F.lit(0).cast("long")).withColumn("_ghost", F.lit(False))
    edges = sorted({stats.lo, *stats.q, stats.hi + 1})
    per = max(1, min(-(-stats.n // (BUCKET_ROWS * (len(edges) - 1))), MAX_BUCKETS // RANGES))
    bucket = F.lit(0).cast("long")
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        place = F.least(F.lit(per - 1), F.floor((F.col(key) - a).cast("double") / float(b - a) * per))
        bucket = F.when(F.col(key) >= a, place + i * per).otherwise(bucket)
    placed = d.withColumn("_b", bucket)
    firsts = keys.withColumn("_b", bucket).groupBy("_b").agg(F.max(key).alias("_first"))
    above = Window.orderBy("_b")
    firsts = firsts.withColumn("_to", F.coalesce(F.lead("_b").over(above), F.min("_b").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    small = F.broadcast(firsts.select("_first", "_to"))
    ghosts = placed.join(small, placed[key] == small["_first"]).drop("_b", "_first").withColumnRenamed("_to", "_b").withColumn("_ghost", F.lit(True))
    return placed.withColumn("_ghost", F.lit(False)).unionByName(ghosts)


def edited_prints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit: the last third of the text replaced by the start of the next document's.

    Columns: doc_id, n_chars, edited_sha256, prints, edited_prints, next_prints.  The next
    document has the next smaller id (ties and nulls in one fixed order, nulls lowest), after the last comes
    the first; a table of one row is its own next.  Rows are dealt by range of the id, in one shuffle of the texts.
    """
    d = with_key(docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")))
    lex = lexicon(d, "text")
    following = Window.partitionBy("_b").orderBy("_ghost", F.col("_key").desc())
    n = F.char_length("text")
    third = F.expr("char_length(text) div 3").cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    d = dealt(d, "_key").withColumn("next_text", F.lead("text").over(following))
    d = d.select("_b", "_ghost", "_key", "doc_id", n.cast("long").alias("n_chars"), "text", F.when(F.col("_ghost"), "").otherwise(edited).alias("_edited"))
    row = F.struct("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"))
    d = printed(d, ["_b", "_ghost", "_key"], row, {"prints": F.col("text"), "edited_prints": F.col("_edited")}, lex)
    d = d.withColumn("next_prints", F.lead("prints").over(following)).where("not _ghost")
    return d.select("doc_id", "n_chars", "edited_sha256", "prints", "edited_prints", "next_prints")
