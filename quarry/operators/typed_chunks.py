"""Chunks by document type from sectioned blocks: questions, clauses, steps, table row groups, plain sections.

A line's group is a running count of what opens one (a boundary line, a new section, a
table), so the order-dependent part is a window over one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

TYPES = ("faq", "policy", "sop", "table", "generic")


def _lines(sec: DataFrame, doc: str) -> DataFrame:
    """doc, seq, n, line, section, heading_path, page, part: lines of prose; ``part`` changes at headings and tables."""
    w = Window.partitionBy(doc).orderBy("seq")
    d = sec.withColumn("part", F.sum(F.col("type").isin("heading", "table").cast("int")).over(w))
    prose = d.where(F.col("type").isin("paragraph", "list", "code"))
    text = F.when(F.col("type") == "list", F.array_join("items", "\n")).otherwise(F.col("text"))
    e = prose.select(doc, "seq", "part", "section", "heading_path", "page", F.posexplode(F.split(text, "\n")).alias("n", "line"))
    return e.withColumn("line", T.strip(F.col("line"))).where("line != ''")


def _split(text: Column, size: int) -> Column:
    return F.when(F.length(text) <= size, F.array(text)).otherwise(T.split_sentences(text, size))


def _grouped(lines: DataFrame, doc: str, keys: list[str], line: Column, extra: list[Column]) -> DataFrame:
    g = lines.groupBy(doc, *keys).agg(F.sort_array(F.collect_list(F.struct("seq", "n", line.alias("x")))).alias("l"), F.min(F.struct("seq", "n", "section", "heading_path", "page")).alias("f"), *extra)
    return g.withColumn("text", T.strip(F.array_join(F.transform("l", lambda x: x["x"]), "\n"))).where("text != ''")


def _out(g: DataFrame, doc: str, kind: Column, number: Column, texts: Column) -> DataFrame:
    return g.select(doc, F.struct(F.col("f.seq").alias("a"), F.col("f.n").alias("b")).alias("at"), F.col("f.section").alias("section"), F.col("f.heading_path").alias("heading_path"), F.col("f.page").alias("page"), kind.alias("chunk_type"), number.alias("number"), F.posexplode(texts).alias("piece", "text"))


def policy_chunks(sec: DataFrame, size: int = 800, doc: str = "doc_id") -> DataFrame:
    """One chunk per clause with its lines; lines before a clause are an introduction."""
    li = _lines(sec, doc)
    w = Window.partitionBy(doc).orderBy("seq", "n")
    opens = F.col("line").rlike(T.CLAUSE) | F.col("line").rlike(T.NUMBERED)
    first = F.coalesce(F.lag("part").over(w) != F.col("part"), F.lit(True))
    d = li.withColumn("_o", opens).withColumn("g", F.sum((opens | first).cast("int")).over(w))
    g = _grouped(d, doc, ["g"], F.col("line"), [F.min_by(F.when(F.col("_o"), F.col("line")), F.struct("seq", "n")).alias("head")])
    no = F.coalesce(*(F.when(F.col("head").rlike(p), T.strip(F.regexp_extract("head", p, 1))) for p in (T.CLAUSE, T.NUMBERED)), F.lit(""))
    return _out(g, doc, F.when(no != "", "policy_clause").otherwise("policy_intro"), no, _split(F.col("text"), size))


def faq_chunks(sec: DataFrame, size: int = 800, doc: str = "doc_id") -> DataFrame:
    """``Q: … A: …`` per question; a line that ends with a question mark asks one only where none is open; long answers repeat the question."""
    li = _lines(sec, doc)
    w = Window.partitionBy(doc, "part").orderBy("seq", "n")
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    marked = F.col("line").rlike(T.QUESTION)
    loose = F.col("line").rlike("[？?]$") & (F.length("line") <= 160)
    asked = F.coalesce(F.max((marked | loose).cast("int")).over(so_far), F.lit(0))
    d = li.withColumn("_q", marked | (loose & (asked == 0))).withColumn("g", F.sum(F.col("_q").cast("int")).over(w)).where("g > 0")
    said = T.strip(F.regexp_extract("line", T.QUESTION, 1))
    ask = F.when(F.col("line").rlike(T.QUESTION) & (said != ""), said).otherwise(F.col("line"))
    reply = F.when(F.col("line").rlike(T.ANSWER), T.strip(F.regexp_extract("line", T.ANSWER, 1))).otherwise(F.col("line"))
    g = d.groupBy(doc, "part", "g").agg(F.max(F.when(F.col("_q"), ask)).alias("q"), F.sort_array(F.collect_list(F.when(~F.col("_q"), F.struct("seq", "n", reply.alias("x"))))).alias("l"), F.min(F.struct("seq", "n", "section", "heading_path", "page")).alias("f"))
    answer = T.strip(F.array_join(F.transform("l", lambda x: x["x"]), "\n"))
    whole = T.strip(F.concat(F.lit("Q: "), "q", F.lit("\nA: "), answer))
    budget = max(size // 2, 80)
    parts = F.transform(T.split_sentences(answer, budget), lambda p: F.concat(F.lit("Q: "), F.col("q"), F.lit("\nA: "), p))
    return _out(g, doc, F.lit("faq"), F.col("g").cast("string"), F.when(F.length(whole) <= size, F.array(whole)).otherwise(parts))


def sop_chunks(sec: DataFrame, size: int = 800, doc: str = "doc_id") -> DataFrame:
    """One chunk per step; lines that follow no step of their part are prerequisites of the next step."""
    li = _lines(sec, doc)
    w = Window.partitionBy(doc).orderBy("seq", "n")
    cn = F.col("line").rlike(T.STEP_CN)
    named = F.col("line").rlike(T.STEP) & (F.col("line").rlike(r"(?i)^\s*(?:步骤|step)") | F.col("line").rlike(r"^\s*[0-9]+\s*[\.、)）]"))
    step = cn | named
    no = F.when(cn, F.regexp_extract("line", T.STEP_CN, 1)).otherwise(F.regexp_extract("line", T.STEP, 1))
    body = T.strip(F.when(cn, F.regexp_extract("line", T.STEP_CN, 2)).otherwise(F.regexp_extract("line", T.STEP, 2)))
    d = li.withColumn("_s", step).withColumn("_k", F.sum(step.cast("int")).over(w)).withColumn("_at", F.last(F.when(step, F.col("part")), ignorenulls=True).over(w))
    mine = F.col("_s") | (F.col("_k") > 0) & (F.col("_at") == F.col("part"))
    d = d.withColumn("g", F.when(mine, F.col("_k")).otherwise(F.col("_k") + 1)).withColumn("_no", F.when(F.col("_s"), T.strip(no)))
    line = F.when(F.col("_s"), F.when(body != "", F.concat("_no", F.lit(". "), body)).otherwise(F.col("_no"))).otherwise(F.col("line"))
    g = _grouped(d, doc, ["g"], line, [F.max("_no").alias("no")]).where("no is not null")
    return _out(g, doc, F.lit("sop_step"), F.col("no"), _split(F.col("text"), size))


def table_groups(sec: DataFrame, size: int = 800, doc: str = "doc_id") -> DataFrame:
    """Tables as Markdown in groups of rows up to ``size``, the header repeated: doc, table_no, row_start, row_end, text."""
    t = sec.where("type = 'table' and size(header) > 0").withColumn("table_no", F.row_number().over(Window.partitionBy(doc).orderBy("seq")))
    head = F.length(T.markdown_table(F.col("header"), F.array().cast("array<array<string>>")))

    def width(r):
        return F.length(T.markdown_table(F.col("header"), F.array(r))) - head - 1

    def add(s, r):
        n = width(r)
        over = (F.size(s["cur"]) > 0) & (s["n"] + n + 1 > size)
        return F.struct(F.when(over, F.array_append(s["groups"], s["cur"])).otherwise(s["groups"]).alias("groups"), F.when(over, F.array(r)).otherwise(F.array_append(s["cur"], r)).alias("cur"), F.when(over, head + n + 1).otherwise(s["n"] + n + 1).alias("n"))

    rows = "array<array<string>>"
    start = F.struct(F.array().cast(f"array<{rows}>").alias("groups"), F.array().cast(rows).alias("cur"), head.alias("n"))
    groups = F.aggregate("rows", start, add, lambda s: F.array_append(s["groups"], s["cur"]))
    e = t.select(doc, "table_no", "header", "section", "heading_path", "page", F.posexplode(groups).alias("piece", "g"))
    end = F.sum(F.size("g")).over(Window.partitionBy(doc, "table_no").orderBy("piece"))
    return e.select(doc, "table_no", "section", "heading_path", "page", (end - F.size("g") + 1).alias("row_start"), end.alias("row_end"), T.markdown_table(F.col("header"), F.col("g")).alias("text"))


def section_chunks(sec: DataFrame, size: int = 800, overlap: int = 80, doc: str = "doc_id") -> DataFrame:
    """Blocks of a section packed up to ``size`` with the heading as first line; a longer block is cut into windows of lines."""
    head = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text"))
    listed = F.array_join(F.transform("items", lambda x: F.concat(F.lit("- "), x)), "\n")
    x = F.when(F.col("type") == "heading", head).when(F.col("type") == "list", listed).otherwise(F.col("text"))
    d = sec.withColumn("x", x).where("x != ''").groupBy(doc, "section_no").agg(F.sort_array(F.collect_list(F.struct("seq", "x"))).alias("l"), F.min(F.struct("seq", F.lit(0).alias("n"), "section", "heading_path", "page")).alias("f"))

    def add(s, b):
        big = F.length(b["x"]) > size
        over = (s["cur"] != "") & (big | (F.length(s["cur"]) + 1 + F.length(b["x"]) > size))
        parts = F.when(over, F.array_append(s["parts"], s["cur"])).otherwise(s["parts"])
        cur = F.when((s["cur"] == "") | over, b["x"]).otherwise(F.concat(s["cur"], F.lit("\n"), b["x"]))
        return F.struct(F.when(big, F.concat(parts, T.line_windows(b["x"], size, overlap))).otherwise(parts).alias("parts"), F.when(big, F.lit("")).otherwise(cur).alias("cur"))

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("cur"))
    texts = F.aggregate("l", start, add, lambda s: F.when(s["cur"] == "", s["parts"]).otherwise(F.array_append(s["parts"], s["cur"])))
    return _out(d, doc, F.lit("text"), F.lit(""), texts)


def typed_chunks(sec: DataFrame, doc_type: str, size: int = 800, overlap: int = 80, doc: str = "doc_id") -> DataFrame:
    """Chunks of sectioned blocks for one type, numbered per document; documents for which the type finds nothing are chunked by section."""
    make = {"faq": faq_chunks, "policy": policy_chunks, "sop": sop_chunks}
    plain = section_chunks(sec, size, overlap, doc)
    if doc_type in make:
        own = make[doc_type](sec, size, doc)
        plain = own.unionByName(plain.join(own.select(doc).distinct(), doc, "left_anti"))
    return plain.withColumn("chunk_index", F.row_number().over(Window.partitionBy(doc).orderBy("at", "piece")) - 1)
