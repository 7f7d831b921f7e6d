"""Markdown to typed blocks, sections, parent and child chunks, tables and images, all with built-in functions.

Lines become rows; what a reader's state machine would remember (open fence, page,
list or table run) is a window over the lines of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

PAGE = r"^<!--\s*PAGE:\s*(\d+)\s*-->"
HEADING = r"^(#{1,6})\s+(.+)$"
LIST = r"^\s*(?:[-*+]|\d+[.)])\s+(.+)$"
IMAGE = r"^!\[([^\]]*)\]\(([^)]*)\)"
SEPARATOR = r"^\|[\s:|-]+\|?$"


def blocks(docs: DataFrame, doc: str = "doc_id", markdown: str = "markdown") -> DataFrame:
    """doc, seq, type (heading, paragraph, list, table, code, image), text, level, page, header, rows, items, image_id."""
    lines = docs.select(doc, F.posexplode(F.split(F.regexp_replace(F.coalesce(F.col(markdown), F.lit("")), "\r\n?", "\n"), "\n")).alias("n", "raw"))
    w = Window.partitionBy(doc).orderBy("n")
    s = T.strip(F.col("raw"))
    d = lines.withColumn("s", s).withColumn("fence", F.col("s").startswith("```"))
    before = F.coalesce(F.sum(F.col("fence").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    code = (before % 2 == 1) | F.col("fence")
    kind = (
        F.when(code, "code").when(F.col("s").rlike(PAGE), "page").when(F.col("s").rlike(HEADING), "heading").when(F.col("s").rlike(r"^\|.*\|"), "table")
        .when(F.col("s").rlike(IMAGE), "image").when(F.col("raw").rlike(LIST), "list").when(F.col("s") == "", "blank").otherwise("paragraph")
    )
    d = d.withColumn("kind", kind).withColumn("_open", F.col("fence") & (before % 2 == 0))
    # a table goes on over every line that starts with a bar
    prev = F.lag("kind").over(w)
    same = (prev == F.col("kind")) & F.col("kind").isin("table", "list", "paragraph", "code") & ~F.col("_open")
    d = d.withColumn("page", F.coalesce(F.last(F.when(F.col("kind") == "page", F.regexp_extract("s", PAGE, 1).cast("int")), ignorenulls=True).over(w), F.lit(0)))
    d = d.withColumn("b", F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(w)).where(~F.col("kind").isin("blank", "page"))
    g = d.groupBy(doc, "b").agg(F.first("kind").alias("type"), F.min("page").alias("page"), F.min("n").alias("_n"), F.sort_array(F.collect_list(F.struct("n", "s", "raw"))).alias("l"))
    strs = lambda f: F.transform("l", f)
    cells = lambda x: F.transform(F.split(F.regexp_replace(x["s"], r"^\||\|$", ""), r"\|"), T.strip)
    grid = F.transform(F.filter("l", lambda x: x["s"].rlike(r"^\|.*\|$") & ~x["s"].rlike(SEPARATOR)), cells)
    first = F.col("l")[0]["s"]
    g = g.withColumn("_g", F.when(F.col("type") == "table", grid)).where("type != 'table' or size(_g) > 0")
    text = (
        F.when(F.col("type") == "heading", T.strip(F.regexp_extract(first, HEADING, 2)))
        .when(F.col("type") == "image", T.strip(F.regexp_extract(first, IMAGE, 1)))
        .when(F.col("type") == "list", F.array_join(strs(lambda x: T.strip(F.regexp_extract(x["raw"], LIST, 1))), "\n"))
        .when(F.col("type") == "code", F.array_join(strs(lambda x: x["raw"]), "\n"))
        .when(F.col("type") == "table", T.markdown_table(F.get("_g", F.lit(0)), F.slice("_g", F.lit(2), F.greatest(F.size("_g") - 1, F.lit(0)))))
        .otherwise(F.array_join(strs(lambda x: x["s"]), "\n"))
    )
    out = g.select(
        doc, F.row_number().over(Window.partitionBy(doc).orderBy("_n")).alias("seq"), "type", text.alias("text"), "page",
        F.when(F.col("type") == "heading", F.length(F.regexp_extract(first, HEADING, 1))).otherwise(0).alias("level"),
        F.when(F.col("type") == "table", F.get("_g", F.lit(0))).alias("header"), F.when(F.col("type") == "table", F.slice("_g", F.lit(2), F.greatest(F.size("_g") - 1, F.lit(0)))).alias("rows"),
        F.when(F.col("type") == "list", strs(lambda x: T.strip(F.regexp_extract(x["raw"], LIST, 1)))).alias("items"),
        F.when(F.col("type") == "image", T.strip(F.regexp_extract(first, IMAGE, 2))).alias("image_id"),
    )
    return out


def to_markdown(bl: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Blocks as Markdown again, with a marker where the page changes."""
    w = Window.partitionBy(doc).orderBy("seq")
    turn = (F.col("page") > 0) & (F.col("page") != F.coalesce(F.lag("page").over(w), F.lit(0)))
    body = (
        F.when(F.col("type") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text")))
        .when(F.col("type") == "list", F.array_join(F.transform("items", lambda x: F.concat(F.lit("- "), x)), "\n"))
        .when(F.col("type") == "image", F.concat(F.lit("!["), "text", F.lit("]("), "image_id", F.lit(")")))
        .otherwise(F.col("text"))
    )
    part = F.when(turn, F.concat(F.lit("<!-- PAGE:"), F.col("page").cast("string"), F.lit(" -->\n\n"), body)).otherwise(body)
    d = bl.withColumn("_p", part)
    return d.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("seq", "_p"))).alias("_l")).select(doc, F.concat(F.array_join(F.transform("_l", lambda x: x["_p"]), "\n\n"), F.lit("\n")).alias("markdown"))


def degrade(bl: DataFrame) -> DataFrame:
    """Every block with text as a paragraph."""
    return bl.where(T.strip(F.col("text")) != "").withColumn("type", F.lit("paragraph")).withColumn("text", T.strip(F.col("text")))


def sections(bl: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Blocks with ``section_no`` (a heading opens one), ``section`` and ``heading_path``.

    A heading of level l is on the path if no heading of a lower level came after it.
    """
    w = Window.partitionBy(doc).orderBy("seq")
    h = F.col("type") == "heading"
    d = bl.withColumn("section_no", F.sum(h.cast("int")).over(w)).withColumn("section", F.coalesce(F.last(F.when(h, F.col("text")), ignorenulls=True).over(w), F.lit("")))
    for level in range(1, 7):
        at = h & (F.col("level") == level)
        d = d.withColumn(f"_p{level}", F.coalesce(F.last(F.when(at, F.col("seq")), ignorenulls=True).over(w), F.lit(0))).withColumn(f"_t{level}", F.last(F.when(at, F.col("text")), ignorenulls=True).over(w))
    parts = []
    for level in range(1, 7):
        upper = F.greatest(F.lit(0), F.lit(0), *(F.col(f"_p{m}") for m in range(1, level)))
        parts.append(F.when(F.col(f"_p{level}") > upper, F.col(f"_t{level}")))
    return d.withColumn("heading_path", F.concat_ws(" > ", *parts)).drop(*(f"_{c}{level}" for c in "pt" for level in range(1, 7)))


def _block_text() -> Column:
    listed = F.array_join(F.transform(F.filter("items", lambda x: x != ""), lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when((F.col("type") == "list") & (F.size("items") > 0), listed).otherwise(T.strip(F.coalesce("text", F.lit(""))))


def parents(sec: DataFrame, parent_size: int = 2400, doc: str = "doc_id") -> DataFrame:
    """doc, chunk_index, id, text, section, heading_path, page: prose of a section packed without splitting blocks, but for oversized ones."""
    prose = sec.where(F.col("type").isin("paragraph", "list", "code")).withColumn("_x", _block_text()).where("_x != ''")
    g = prose.groupBy(doc, "section_no", "section", "heading_path").agg(F.sort_array(F.collect_list(F.struct("seq", "_x", "page"))).alias("l"))

    def add(s, b):
        big = F.length(b["_x"]) > parent_size
        over = (s["cur"] != "") & (big | (F.length(s["cur"]) + 2 + F.length(b["_x"]) + 2 > parent_size))
        flushed = F.when(over, F.array_append(s["parts"], s["cur"])).otherwise(s["parts"])
        joined = F.when((s["cur"] == "") | over, b["_x"]).otherwise(F.concat(s["cur"], F.lit("\n\n"), b["_x"]))
        return F.struct(F.when(big, F.concat(flushed, T.split_windows(b["_x"], parent_size, 0))).otherwise(flushed).alias("parts"), F.when(big, F.lit("")).otherwise(joined).alias("cur"))

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("cur"))
    texts = F.aggregate("l", start, add, lambda s: F.when(s["cur"] == "", s["parts"]).otherwise(F.array_append(s["parts"], s["cur"])))
    page = F.coalesce(F.get(F.filter("l", lambda b: b["page"] > 0), F.lit(0))["page"], F.lit(0))
    e = g.select(doc, "section_no", "section", "heading_path", page.alias("page"), F.posexplode(texts).alias("_i", "text"))
    index = F.row_number().over(Window.partitionBy(doc).orderBy("section_no", "_i")) - 1
    return e.withColumn("chunk_index", index).withColumn("id", F.concat(F.col(doc).cast("string"), F.lit("-p"), F.lpad(F.col("chunk_index").cast("string"), 4, "0"))).select(doc, "chunk_index", "id", "text", "section", F.when(F.col("heading_path") != "", F.col("heading_path")).otherwise(F.col("section")).alias("heading_path"), "page")


def children(par: DataFrame, doc_type: str = "generic", child_size: int = 800, overlap: int = 80, doc: str = "doc_id") -> DataFrame:
    """doc, parent_id, position, text and piece metadata: windows of the parent's pieces, never across parents."""
    size = max(child_size, 80)
    lap = min(max(overlap, 0), max(size // 2, 1))
    p = par.select(doc, F.col("id").alias("parent_id"), F.col("chunk_index").alias("_p"), "section", "heading_path", "page", F.posexplode(F.filter(F.transform(T.pieces(F.col("text"), doc_type), T.strip), lambda x: x != "")).alias("_i", "_x"))
    c = p.withColumn("m", T.piece_metadata(F.col("_x"), doc_type)).select("*", F.posexplode(T.split_windows(F.col("_x"), size, lap)).alias("_j", "text"))
    return c.select(doc, "parent_id", "_p", F.struct("_i", "_j").alias("position"), "text", "section", "heading_path", "page", "m.chunk_type", "m.clause_no", "m.step_no", "m.faq_id")


def tables(sec: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, table_no, table_id, name, header, rows, section, heading_path, page, summary."""
    t = sec.where("type = 'table'").withColumn("table_no", F.row_number().over(Window.partitionBy(doc).orderBy("seq")))
    name = F.concat(F.lit("表格 "), F.col("table_no").cast("string"))
    return t.select(doc, "table_no", T.safe_id(F.col(doc).cast("string"), F.concat(F.lit("block-"), F.col("table_no").cast("string"))).alias("table_id"), name.alias("name"), "header", "rows", "section", "heading_path", "page", T.table_summary(name, F.col("header"), F.size("rows"), F.col("section"), F.col("page")).alias("summary"))


def table_chunks(tab: DataFrame, sample: int = 3, child_size: int = 800, doc: str = "doc_id") -> DataFrame:
    """One summary chunk (with the first rows) and one chunk per row of every table."""
    pairs = F.transform(F.slice("rows", 1, sample), lambda r, i: F.concat(F.lit("第 "), (i + 1).cast("string"), F.lit(" 行："), T.row_pairs(F.col("header"), r)))
    shown = F.array_join(F.filter(pairs, lambda p: ~p.endswith("：")), "；")
    head = tab.select(doc, "table_id", "table_no", F.lit(0).alias("row_index"), F.when(shown == "", F.col("summary")).otherwise(F.concat("summary", F.lit("；示例："), shown)).alias("text"), F.lit("table_summary").alias("chunk_kind"))
    rows = tab.select(doc, "table_id", "table_no", "name", "header", F.posexplode("rows").alias("_i", "_r"))
    body = rows.select(doc, "table_id", "table_no", (F.col("_i") + 1).alias("row_index"), T.row_text(F.col("name"), T.row_pairs(F.col("header"), F.col("_r")), F.col("_i") + 1).alias("_x")).where("_x != ''")
    body = body.select(doc, "table_id", "table_no", "row_index", F.explode(T.split_windows(F.col("_x"), child_size, 0)).alias("text"), F.lit("table_row").alias("chunk_kind"))
    return head.unionByName(body)


def images(sec: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Image blocks with a caption or a valid id: text (caption or placeholder, cut at 1000), image_id."""
    ok = F.when(F.coalesce("image_id", F.lit("")).rlike("^[0-9a-f]{32}$"), F.col("image_id")).otherwise("")
    t = T.strip(F.coalesce("text", F.lit("")))
    blank = F.when(F.col("page") > 0, F.concat(F.lit("图片（第"), F.col("page").cast("string"), F.lit("页）"))).otherwise("图片")
    return sec.where("type = 'image'").withColumn("image_id", ok).withColumn("text", t).where("text != '' or image_id != ''").select(doc, "seq", F.substring(F.when(F.col("text") == "", blank).otherwise(F.col("text")), 1, 1000).alias("text"), "image_id", "page", "section", "heading_path")


def chunk_plan(docs: DataFrame, doc_type: str = "generic", parent_size: int = 2400, child_size: int = 800, overlap: int = 80, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(parents with child_count, chunks numbered over children, table rows and images of each document)."""
    sec = sections(blocks(docs, doc), doc)
    par = parents(sec, parent_size, doc)
    ch = children(par, doc_type, child_size, overlap, doc)
    none = F.lit("")
    parts = ch.select(doc, F.lit(0).alias("_a"), F.col("_p").alias("_b"), F.col("position._i").alias("_c"), F.col("position._j").alias("_d"), "text", "parent_id", F.lit("child").alias("chunk_kind"), "chunk_type")
    tc = table_chunks(tables(sec, doc), 3, child_size, doc)
    parts = parts.unionByName(tc.select(doc, F.lit(1).alias("_a"), F.col("table_no").alias("_b"), F.col("row_index").alias("_c"), F.lit(0).alias("_d"), "text", none.alias("parent_id"), "chunk_kind", F.col("chunk_kind").alias("chunk_type")))
    im = images(sec, doc)
    parts = parts.unionByName(im.select(doc, F.lit(2).alias("_a"), F.col("seq").alias("_b"), F.lit(0).alias("_c"), F.lit(0).alias("_d"), "text", none.alias("parent_id"), F.lit("image").alias("chunk_kind"), F.lit("image").alias("chunk_type")))
    chunks = parts.withColumn("chunk_index", F.row_number().over(Window.partitionBy(doc).orderBy("_a", "_b", "_c", "_d")) - 1).drop("_a", "_b", "_c", "_d")
    counts = chunks.where("parent_id != ''").groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"))
    return par.join(counts, par["id"] == counts["parent_id"], "left").withColumn("child_count", F.coalesce("n", F.lit(0))).drop("n", "parent_id"), chunks


def doc_type_vote(lines: DataFrame, doc: str = "doc_id", table_share: Column | None = None) -> DataFrame:
    """Type per document from its lines (doc, line): question, step and clause hits, then the share of table characters."""
    hit = lambda p: F.sum(F.col("line").rlike(p).cast("int"))
    v = lines.groupBy(doc).agg(hit(T.QUESTION).alias("faq"), F.sum((F.col("line").rlike(T.STEP_CN) | F.col("line").rlike(r"^\s*步骤\s*[0-9]")).cast("int")).alias("sop"), hit(T.CLAUSE).alias("policy"), F.sum(F.when(F.col("line").startswith("|"), F.length("line")).otherwise(0)).alias("bars"), F.sum(F.length("line")).alias("chars"))
    kind = F.when((F.col("faq") >= 2) & (F.col("faq") >= F.col("sop")), "faq").when(F.col("sop") >= 2, "sop").when(F.col("policy") >= 2, "policy").when(F.col("bars") / F.greatest("chars", F.lit(1)) >= 0.4, "table").otherwise("generic")
    return v.select(doc, kind.alias("doc_type"))


def triage(pages: DataFrame, doc: str = "doc_id", least_chars: int = 50) -> DataFrame:
    """doc, kind, scanned, text_pages: pages (doc, page, text_chars, tables, formula) rolled up to scanned, mixed, complex or text."""
    has = F.col("text_chars") >= least_chars
    r = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("n"), F.sum((~has).cast("int")).alias("bare"), F.max(F.col("tables") > 0).alias("t"), F.max("formula").alias("f"), F.array_sort(F.collect_list(F.when(~has, F.col("page")))).alias("scanned"))
    kind = F.when(F.col("bare") == F.col("n"), "pdf_scanned").when(F.col("bare") > 0, "pdf_mixed").when(F.col("t") | F.col("f"), "pdf_complex").otherwise("pdf_text")
    return r.select(doc, kind.alias("kind"), "scanned", (F.col("n") - F.col("bare")).alias("text_pages"))


def converter_chain(kind: Column, remote: Column) -> Column:
    """Ordered converters to try for a kind of document."""
    local = {"pdf_text": ["pymupdf"], "pdf_complex": ["docling", "pymupdf"], "pdf_mixed": ["hybrid_ocr", "pymupdf"], "pdf_scanned": ["ocr"], "docx": ["docx"], "xlsx": ["xlsx"], "image": ["ocr"]}
    out = F.array(F.lit("markitdown"))
    for k, names in local.items():
        chain = F.array(*map(F.lit, names))
        if k in ("pdf_complex", "pdf_mixed", "pdf_scanned", "image"):
            chain = F.when(remote, F.array_prepend(chain, F.lit("mineru"))).otherwise(chain)
        out = F.when(kind == k, chain).otherwise(out)
    return out


def page_groups(scanned: DataFrame, doc: str = "doc_id", few: int = 8) -> DataFrame:
    """Runs of adjacent scanned pages (doc, page) to read at once; with at most ``few`` of them, one by one."""
    w = Window.partitionBy(doc).orderBy("page")
    opens = F.coalesce((F.col("page") - F.lag("page").over(w) > 1).cast("int"), F.lit(1))
    d = scanned.withColumn("_o", opens).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(doc)))
    d = d.withColumn("g", F.sum(F.when(F.col("_n") <= few, 1).otherwise(F.col("_o"))).over(w))
    return d.groupBy(doc, "g").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))


def merge_pages(pages: DataFrame, ocr: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Page texts with those that OCR read instead (its text for a run of pages stands on the first)."""
    o = ocr.select(doc, "page", F.col("text").alias("_o"))
    return pages.join(o, [doc, "page"], "full_outer").select(doc, "page", F.coalesce(F.when(F.col("_o") != "", F.col("_o")), "text", F.lit("")).alias("text"))


def useful_images(assets: DataFrame, least_bytes: int = 4096, least_edge: int = 64) -> DataFrame:
    """Images that are no decoration: large enough in bytes and, where known, in both edges."""
    edge = F.least("width", "height")
    return assets.where((F.octet_length("data") >= least_bytes) & (edge.isNull() | (edge >= least_edge)))


def filled_sections(paragraphs: DataFrame, doc: str = "doc_id", first: str = "前言") -> DataFrame:
    """Paragraphs (doc, seq, text) with the last heading-like one as section."""
    w = Window.partitionBy(doc).orderBy("seq")
    return paragraphs.withColumn("section", F.coalesce(F.last(F.when(T.looks_like_heading(F.col("text")), F.substring("text", 1, 200)), ignorenulls=True).over(w), F.lit(first)))


def row_groups(rows: DataFrame, per: int, doc: str = "doc_id") -> DataFrame:
    """Sheet rows (doc, row_index from 1, text) grouped by ``per``: row_start, row_end, joined text."""
    g = F.floor((F.col("row_index") - 1) / per)
    return rows.groupBy(doc, g.alias("group")).agg(F.min("row_index").alias("row_start"), F.max("row_index").alias("row_end"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_index", "text"))), lambda x: x["text"]), "\n").alias("text"))


def children_per_parent(par: DataFrame, chunks: DataFrame) -> DataFrame:
    n = chunks.groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("child_count"))
    return par.join(n, "id", "left").withColumn("child_count", F.coalesce("child_count", F.lit(0)))
