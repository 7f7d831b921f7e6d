"""Text functions over columns: sentences, windows, headings, table rows, document-type votes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: line patterns of the document types
CLAUSE = r"^\s*(第[一二三四五六七八九十百千零〇0-9]+条)\s*(.*)$"
NUMBERED = r"^\s*(\d+(?:\.\d+)+)[\.\s、]?\s*(.*)$"
STEP = r"(?i)^\s*(?:步骤\s*|Step\s*)?([0-9]+(?:\.[0-9]+)*)\s*[\.、:：)）]?\s*(.*)$"
STEP_CN = r"^\s*第([一二三四五六七八九十百千零〇0-9]+)步\s*[：:\.、]?\s*(.*)$"
STEP_LINE = r"(?i)^\s*(?:步骤\s*|Step\s*|[0-9]+\s*[\.、:：)）])"
QUESTION = r"(?i)^\s*(?:Q\s*\d*|问(?:题)?)\s*[:：.、]?\s*(.*)$"
ANSWER = r"(?i)^\s*(?:A\s*\d*|答(?:案)?)\s*[:：.、]?\s*(.*)$"
MATH_SYMBOLS = "∑∫√±×÷≤≥≠≈∈∀∃∂∇∞αβγθλμπσφωΩΔΣ"
FORMULA_TOKENS = ["\\frac", "\\sqrt", "\\sum", "^{", "_{"]

_TEXTS = "array<string>"


def strip(c: Column) -> Column:
    """Without Unicode blanks at either end (plain ``trim`` keeps the ideographic one)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _none() -> Column:
    return F.array().cast(_TEXTS)


def pack(pieces: Column, cap: int, sep: str = "", extra: int = 0) -> Column:
    """Neighbouring pieces joined greedily: a piece opens a new part if it would pass ``cap`` (``extra`` counts too)."""
    def add(s, p):
        over = (s["cur"] != "") & (F.length(s["cur"]) + len(sep) + F.length(p) + extra > cap)
        joined = F.when(s["cur"] == "", p).otherwise(F.concat(s["cur"], F.lit(sep), p))
        return F.struct(F.when(over, F.array_append(s["parts"], s["cur"])).otherwise(s["parts"]).alias("parts"), F.when(over, p).otherwise(joined).alias("cur"))

    start = F.struct(_none().alias("parts"), F.lit("").alias("cur"))
    return F.aggregate(pieces, start, add, lambda s: F.when(s["cur"] == "", s["parts"]).otherwise(F.array_append(s["parts"], s["cur"])))


def split_sentences(text: Column, limit: int) -> Column:
    """Sentences packed up to ``limit``; longer ones are cut, their full cuts standing before the text still being packed."""
    raw = F.filter(F.transform(F.split(text, r"(?<=[。！？!?;；])"), strip), lambda p: p != "")

    def add(s, p):
        n = F.floor((F.length(p) - 1) / limit).cast("int")
        cuts = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(p, i * limit + 1, F.lit(limit)))).otherwise(_none())
        rest = F.substring(p, n * limit + 1, F.length(p))
        over = (s["cur"] != "") & (F.length(s["cur"]) + F.length(rest) > limit)
        parts = F.concat(s["parts"], cuts)
        return F.struct(F.when(over, F.array_append(parts, s["cur"])).otherwise(parts).alias("parts"), F.when(over, rest).otherwise(F.concat(s["cur"], rest)).alias("cur"))

    start = F.struct(_none().alias("parts"), F.lit("").alias("cur"))
    out = F.aggregate(raw, start, add, lambda s: F.when(s["cur"] == "", s["parts"]).otherwise(F.array_append(s["parts"], s["cur"])))
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.substring(text, 1, limit)))


def split_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of whole sentences up to ``size``; each starts with the trailing sentences of the one before that fit ``overlap``."""
    t = strip(F.coalesce(text, F.lit("")))

    def tail(cur):
        def keep(s, p):
            stop = s["stop"] | (s["n"] + F.length(p) > overlap)
            return F.struct(F.when(stop, s["kept"]).otherwise(F.array_prepend(s["kept"], p)).alias("kept"), F.when(stop, s["n"]).otherwise(s["n"] + F.length(p)).alias("n"), stop.alias("stop"))

        return F.aggregate(F.reverse(cur), F.struct(_none().alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("stop")), keep, lambda s: s["kept"])

    def add(s, p):
        over = (F.size(s["cur"]) > 0) & (F.length(F.array_join(s["cur"], "")) + F.length(p) > size)
        return F.struct(F.when(over, F.array_append(s["parts"], strip(F.array_join(s["cur"], "")))).otherwise(s["parts"]).alias("parts"), F.array_append(F.when(over, tail(s["cur"])).otherwise(s["cur"]), p).alias("cur"))

    start = F.struct(_none().alias("parts"), _none().alias("cur"))
    many = F.aggregate(split_sentences(t, size), start, add, lambda s: F.when(F.size(s["cur"]) > 0, F.array_append(s["parts"], strip(F.array_join(s["cur"], "")))).otherwise(s["parts"]))
    return F.when(t == "", _none()).when(F.length(t) <= size, F.array(t)).otherwise(F.filter(many, lambda w: w != ""))


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters, each ``size - overlap`` after the one before, until one reaches the end."""
    step = size - overlap
    n = F.when(F.length(text) <= size, 0).otherwise(F.ceil((F.length(text) - size) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def line_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of whole lines up to ``size``; each starts with the last lines of the one before up to ``overlap``, one at least."""
    def tail(cur):
        def keep(s, p):
            stop = s["stop"] | ((s["n"] + F.length(p) > overlap) & (F.size(s["kept"]) > 0))
            return F.struct(F.when(stop, s["kept"]).otherwise(F.array_prepend(s["kept"], p)).alias("kept"), F.when(stop, s["n"]).otherwise(s["n"] + F.length(p) + 1).alias("n"), stop.alias("stop"))

        return F.aggregate(F.reverse(cur), F.struct(_none().alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("stop")), keep, lambda s: s["kept"])

    def add(s, p):
        over = (F.size(s["cur"]) > 0) & (F.length(F.array_join(s["cur"], "\n")) + 1 + F.length(p) + 1 > size)
        return F.struct(F.when(over, F.array_append(s["parts"], F.array_join(s["cur"], "\n"))).otherwise(s["parts"]).alias("parts"), F.array_append(F.when(over, tail(s["cur"])).otherwise(s["cur"]), p).alias("cur"))

    start = F.struct(_none().alias("parts"), _none().alias("cur"))
    return F.aggregate(F.split(text, "\n"), start, add, lambda s: F.array_append(s["parts"], F.array_join(s["cur"], "\n")))


def paragraphs(text: Column) -> Column:
    return F.transform(F.split(text, r"(?U)\n\s*\n"), lambda p: strip(F.replace(p, F.lit("\r"), F.lit(""))))


def looks_like_heading(line: Column) -> Column:
    """At most 60 characters, no digits only, no sentence end; with Latin words at most 12 of them."""
    words = F.size(F.filter(F.split(line, r"(?U)\s+"), lambda w: w != ""))
    latin = line.rlike("[a-zA-Z]{4,}")
    return (F.length(line) <= 60) & (line != "") & ~line.rlike(r"^\d+$") & ~line.rlike("[。！？!?；;]$") & (~latin | (words <= 12))


def split_on(text: Column, boundary) -> Column:
    """Pieces of lines; a line for which ``boundary`` holds opens a new piece."""
    def add(s, p):
        cut = (s["n"] > 0) & boundary(p)
        return F.struct(F.when(cut, F.array_append(s["parts"], s["cur"])).otherwise(s["parts"]).alias("parts"), F.when(cut | (s["n"] == 0), p).otherwise(F.concat(s["cur"], F.lit("\n"), p)).alias("cur"), (s["n"] + 1).alias("n"))

    start = F.struct(_none().alias("parts"), F.lit("").alias("cur"), F.lit(0).alias("n"))
    return F.aggregate(F.split(text, "\n"), start, add, lambda s: F.array_append(s["parts"], s["cur"]))


def is_question(line: Column) -> Column:
    return line.rlike(QUESTION) | strip(line).rlike("[？?]$")


BOUNDARIES = {
    "policy": lambda line: line.rlike(CLAUSE) | line.rlike(NUMBERED),
    "sop": lambda line: line.rlike(STEP_CN) | line.rlike(STEP_LINE),
    "faq": is_question,
}


def pieces(text: Column, doc_type: str) -> Column:
    return split_on(text, BOUNDARIES[doc_type]) if doc_type in BOUNDARIES else F.array(text)


def faq_id(question: Column) -> Column:
    return F.substring(F.regexp_replace(strip(question), r"(?U)\s+", " "), 1, 60)


def piece_metadata(piece: Column, doc_type: str) -> Column:
    """Struct chunk_type, clause_no, step_no, faq_id from the piece's first line."""
    first = F.split(strip(piece), "\n")[0]
    pick = lambda *ps: F.coalesce(*(F.when(first.rlike(p), strip(F.regexp_extract(first, p, 1))) for p in ps), F.lit(""))
    clause = pick(CLAUSE, NUMBERED) if doc_type == "policy" else F.lit("")
    step = pick(STEP_CN, STEP) if doc_type == "sop" else F.lit("")
    faq = F.when(is_question(first), faq_id(first)).otherwise("") if doc_type == "faq" else F.lit("")
    kind = {"policy": F.when(clause != "", "policy_clause").otherwise("policy_intro"), "sop": F.lit("sop_step"), "faq": F.lit("faq")}.get(doc_type, F.lit("text"))
    return F.struct(kind.alias("chunk_type"), clause.alias("clause_no"), step.alias("step_no"), faq.alias("faq_id"))


def row_pairs(header: Column, row: Column) -> Column:
    """``name=value；…`` of the non-blank cells; a column without a name is ``列n``."""
    cells = F.transform(row, lambda v, i: F.struct(strip(F.coalesce(v, F.lit(""))).alias("v"), strip(F.coalesce(F.get(header, i), F.lit(""))).alias("h"), i.alias("i")))
    named = F.transform(F.filter(cells, lambda c: c["v"] != ""), lambda c: F.concat(F.when(c["h"] != "", c["h"]).otherwise(F.concat(F.lit("列"), c["i"] + 1)), F.lit("="), c["v"]))
    return F.array_join(named, "；")


def row_text(name: Column, pairs: Column, position: Column) -> Column:
    return F.when(pairs == "", "").otherwise(F.concat(F.lit("【"), name, F.lit("】第 "), position.cast("string"), F.lit(" 行："), pairs))


def strip_row_prefix(text: Column) -> Column:
    return F.regexp_replace(text, r"^第\s*\d+\s*行\s*[:：]\s*", "")


def table_summary(name: Column, header: Column, rows: Column, section: Column, page: Column) -> Column:
    names = F.array_join(F.filter(header, lambda h: h != ""), "、")
    return F.concat_ws("；", F.concat(F.lit("表："), name), F.when(rows > 0, F.concat(F.lit("共 "), rows.cast("string"), F.lit(" 行数据"))), F.concat(F.lit("列："), F.when(names == "", "（无表头）").otherwise(names)), F.when(section != "", F.concat(F.lit("所属章节："), section)), F.when(page > 0, F.concat(F.lit("页码：第 "), page.cast("string"), F.lit(" 页"))))


def safe_id(version: Column, suffix: Column) -> Column:
    return F.concat(version, F.lit("-t-"), F.substring(F.regexp_replace(suffix, r"(?U)[^\w\-\x{4e00}-\x{9fff}]", "_"), 1, 40))


def unique_names(names: Column) -> Column:
    """Repeats get ``_1``, ``_2``, …"""
    def named(x, i):
        seen = F.size(F.filter(F.slice(names, F.lit(1), i), lambda y: y == x))
        return F.when(seen > 0, F.concat(x, F.lit("_"), seen.cast("string"))).otherwise(x)

    return F.transform(names, named)


def markdown_table(header: Column, rows: Column) -> Column:
    """Rows padded or cut to the header's width."""
    clean = lambda c: strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, clean), " | "), F.lit(" |"))
    wide = lambda r: F.transform(header, lambda _, i: F.coalesce(F.get(r, i), F.lit("")))
    body = F.transform(rows, lambda r: line(wide(r)))
    return F.array_join(F.concat(F.array(line(header), F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(header)))), body), "\n")


def formula_hits(text: Column) -> Column:
    symbols = F.length(text) - F.length(F.translate(text, MATH_SYMBOLS, ""))
    tokens = F.lit(0)
    for t in FORMULA_TOKENS:
        tokens = tokens + ((F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / len(t)).cast("int")
    return symbols + tokens


def looks_like_formula(text: Column) -> Column:
    """Three symbols or markers, or one and an equation."""
    t = F.coalesce(text, F.lit(""))
    hits = formula_hits(t)
    return (hits >= 3) | ((hits >= 1) & t.rlike(r"[A-Za-z]\s*=\s*[-+0-9A-Za-z]"))


def format_number(x: Column) -> Column:
    """Six significant digits without trailing zeros; with an exponent below 1e-4 and from 1e6 on."""
    parts = F.split(F.format_string("%.5e", x), "e")
    head, power = parts[0], parts[1].cast("int")
    bare = lambda c: F.when(c.contains("."), F.regexp_replace(c, r"\.?0+$", "")).otherwise(c)
    plain = F.format_string("%.0f", x)
    for digits in range(1, 10):
        plain = F.when(5 - power == digits, F.format_string(f"%.{digits}f", x)).otherwise(plain)
    sign = F.when(power < 0, "-").otherwise("+")
    far = F.concat(bare(head), F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), 2, "0"))
    return F.when(x == 0, "0").when((power < -4) | (power >= 6), far).otherwise(bare(plain))


def geometry(doc_type: Column, chunk_size: Column, enabled: Column) -> Column:
    """Struct parent_child, parent_size, child_size, child_overlap of a document type at a chunk size (800 is the base)."""
    # fixed values: parent size, child size and overlap by type
    base = {"policy": (2000, 600, 60), "sop": (2000, 600, 60), "faq": (3000, 1000, 0), "table": (2400, 800, 0), "generic": (2400, 800, 80)}
    pick = lambda k: F.coalesce(*(F.when(F.lower(F.trim(doc_type)) == t, F.lit(v[k])) for t, v in base.items()), F.lit(base["generic"][k]))
    scale = F.greatest(chunk_size, F.lit(100)) / 800
    both = enabled & (F.lower(F.trim(doc_type)) != "table")
    child = F.greatest((pick(1) * scale).cast("int"), F.lit(80))
    overlap = F.when(both, (pick(2) * scale).cast("int")).otherwise(F.lit(0))
    half = F.greatest(F.floor(child / 2).cast("int"), F.lit(1))
    return F.struct(both.alias("parent_child"), F.greatest((pick(0) * scale).cast("int"), F.lit(200), child).alias("parent_size"), child.alias("child_size"), F.least(F.greatest(overlap, F.lit(0)), half).alias("child_overlap"))


def normalize_doc_type(value: Column) -> Column:
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(v.isin("faq", "policy", "sop", "table", "generic"), v)
