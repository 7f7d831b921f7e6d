"""Source divergence audit: which terms set the sources of a language apart, by a baseline-correction inverted index.

All arithmetic is exact: whole numbers, with decimals where a product can outgrow a long.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: UTF-8 bytes of a text to those of its terms: ASCII capitals become small, other ASCII than letters parts terms.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Terms of groups that a task holds at most before it passes on its counts.
MOST_HELD = 1 << 20
#: Documents of a language that must hold a kept term, what every count is raised by, units of a share, ranks of a group's terms.
MIN_DOCS, SMOOTH, UNIT, TOP = 30, 5, 1_000_000_000, 50


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * terms)); null where there are no terms."""
    over = (count + SMOOTH).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return 1 + F.call_function("div", over, F.nullif(total + SMOOTH * terms, F.lit(0)).cast("decimal(20,0)"))


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, tf, df): occurrences of each term in a group and documents of it that hold the term.

    One pass over the texts.  Tasks count before the shuffle, and pass on what they hold when it is MOST_HELD terms, so a
    hot group sends about its vocabulary once a task and a task's memory is bounded by that and its longest text.
    """
    columns = (F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text")))

    def run(batches):
        held, size = {}, 0
        for b in batches:
            groups = zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            for group, t in zip(groups, b.column(2).cast(pa.large_binary())):
                words = t.as_py().translate(_WORDS).split()
                tf, df = held.setdefault(group, (Counter(), Counter()))
                size -= len(tf)
                tf.update(words)
                df.update(set(words))
                size += len(tf)
                if size > MOST_HELD:
                    yield from _counts(held)
                    held, size = {}, 0
        yield from _counts(held)

    found = docs.select(*columns).mapInArrow(run, "lang string, source string, term string, tf long, df long")
    return found.groupBy("lang", "source", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def _counts(held: dict):
    for (lang, source), (tf, df) in held.items():
        n = len(tf)
        term = pa.array(tf.keys(), pa.binary()).cast(pa.string())
        counts = [pa.array(c.values(), pa.int64()) for c in (tf, {w: df[w] for w in tf})]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), term, *counts], names=["lang", "source", "term", "tf", "df"])


def index(docs: DataFrame, min_docs: int = MIN_DOCS, lang: str = "lang", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The inverted index of the kept terms, and the groups.

    ``postings`` (lang, source, term, tf, p, q, z): one row per group and kept term it has; ``p`` is the group's share of the
    term, ``q`` the language's, ``z`` the group's share of any term it lacks (its baseline).
    ``groups`` (lang, source, terms, total, z): every group that occurs, also those without terms.
    """
    found = cut(term_counts(docs, lang, source, text))
    by_term = Window.partitionBy("lang", "term")
    kept = cut(found.withColumn("_df", F.sum("df").over(by_term)).withColumn("_all", F.sum("tf").over(by_term)).where(F.col("_df") >= min_docs).drop("df", "_df"))
    whole = kept.groupBy("lang").agg(F.countDistinct("term").alias("terms"), F.sum("tf").alias("whole"))
    total = kept.groupBy("lang", "source").agg(F.sum("tf").alias("total"))
    every = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source")))).distinct()
    groups = every.join(total, ["lang", "source"], "left").join(whole, "lang", "left").fillna(0, ["total", "terms", "whole"])
    groups = cut(groups.withColumn("z", share(F.lit(0), F.col("total"), F.col("terms"))))
    p = kept.join(groups, ["lang", "source"])
    postings = p.select("lang", "source", "term", "tf", share(F.col("tf"), F.col("total"), F.col("terms")).alias("p"), share(F.col("_all"), F.col("whole"), F.col("terms")).alias("q"), "z")
    return cut(postings), groups.drop("whole")


def _one_sided(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the sum, over the terms that ``source`` has, of |p - z'| - |z - z'|, where z' is the item's baseline.

    Where z' <= z this is p - z, where z' >= p it is z - p, and between them p + z - 2 z': the
    shares of a group that are at most z' need only be counted and added up.  A window over a group's distinct
    shares and the baselines of the others does that for all items at once.
    """
    shares = postings.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n"))
    mine = shares.select("lang", "source", F.col("p").alias("at"), F.lit(None).cast("string").alias("item"), "n", (F.col("n") * F.col("p")).alias("np"))
    a, b = groups.select("lang", "source", F.col("z").alias("z0")), groups.select("lang", F.col("source").alias("item"), F.col("z").alias("at"))
    asked = a.join(b, "lang").where(F.col("source") != F.col("item"))
    z = a.select("lang", "source", "z0")
    rows = mine.join(z, ["lang", "source"]).unionByName(asked.withColumns({"n": F.lit(0).cast("long"), "np": F.lit(0).cast("long")}))
    group = Window.partitionBy("lang", "source")
    upto = group.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    s = rows.select("*", *(F.sum(c).over(w).alias(c + t) for c in ("n", "np") for w, t in ((upto, "_low"), (group, "_all"))))
    s = s.where("item is not null")
    low, more = F.col("z0") * F.col("n_low") - F.col("np_low"), F.col("n_all") - F.col("n_low")
    between = F.col("np_all") - F.col("np_low") + (F.col("z0") - 2 * F.col("at")) * more
    return s.select("lang", "source", "item", F.when(F.col("at") <= F.col("z0"), F.col("np_all") - F.col("z0") * F.col("n_all")).otherwise(low + between).alias("value"))


def _two_sided(postings: DataFrame) -> DataFrame:
    """(lang, source, item, value) for source < item: what the terms that both have add to the baseline and the one-sided sums; only corrections that aren't zero are passed on."""
    lists = postings.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "z")).alias("_l"))
    one = lists.where(F.size("_l") > 1).select("lang", "_l", F.explode("_l").alias("a"))
    both = one.select("lang", "a", F.explode(F.filter("_l", lambda b: b["source"] > F.col("a.source"))).alias("b"))
    p, z, q, y = F.col("a.p"), F.col("a.z"), F.col("b.p"), F.col("b.z")
    change = F.abs(p - q) - F.abs(p - y) - F.abs(q - z) + F.abs(z - y)
    return both.select("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), change.alias("value")).where("value != 0").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def pair_divergence(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the sum over all kept terms of the difference of two groups' shares, both ways round.

    Every pair starts at V times the difference of the baselines.  A term that one of them has corrects
    that against the other's baseline; a term that both have corrects it once more.
    """
    a, b = groups.select("lang", "source", "terms", "z"), groups.select("lang", F.col("source").alias("item"), F.col("z").alias("_y"))
    base = a.join(b, "lang").where(F.col("source") != F.col("item"))
    base = base.select("lang", "source", "item", F.coalesce(F.col("terms") * F.abs(F.col("z") - F.col("_y")), F.lit(0)).alias("value"))
    turned = lambda d: d.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    one, two = _one_sided(postings, groups), _two_sided(postings)
    parts = base.unionByName(one).unionByName(turned(one)).unionByName(two).unionByName(turned(two))
    return parts.groupBy("lang", "source", "item").agg(F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source of the language, part ``term`` the ``top`` terms
    that a group has above its language's share.

    Defined cases: null language, source and text count as '' (an '' group is a group like any other); every row
    is a document, repeated rows and ids too; empty, very long and term-free texts are whole; a
    language without kept terms has pairs of value 0 and no terms; a single source has no pairs; an empty table gives no rows; ties rank by item;
    other columns are ignored whatever their names.
    """
    postings, groups = index(docs, min_docs, lang, source, text)
    over = postings.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = over.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    pairs = pair_divergence(postings, groups).withColumn("rank", F.row_number().over(ranked)).withColumn("part", F.lit("pair"))
    return pairs.select("lang", "source", "part", "item", "value", "rank").unionByName(terms)
