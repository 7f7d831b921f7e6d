import datetime as dt

from pyspark.sql import functions as F

from quarry.functions.providers import hashed_encoder, overlap_scorer
from quarry.operators import ledger as L
from quarry.operators import services as V
from quarry.plans import files
from quarry.sources import office as O

EMPTY = {"travel_comp_days": 0.0, "ot_comp_days": 0.0, "total_comp_days": 0.0, "used_comp_days": 0.0, "remaining_comp_days": 0.0, "remark": "", "ot_days": []}


def binary(spark, **content):
    return spark.createDataFrame(list(content.items()), "path string, content binary")


def test_broken_and_empty_files_give_no_rows(spark):
    f = binary(spark, a=b"", b=b"PK\x03\x04no", c=None, d=files.pack({"word/document.xml": "<w"}), e=files.pack({"other": ""}))
    assert O.docx_blocks(f).count() == 0
    assert O.archive_images(f.where("path != 'd'")).count() == 0
    assert {r.path: r.markdown for r in O.html_markdown(binary(spark, a=b"", b=None, c=b"<p>x", d=b"\xff<h1>y</h1></script>z")).collect()} == {"a": "", "b": "", "c": "x", "d": "�\n# y\nz"}
    assert [r.markdown for r in O.csv_markdown(binary(spark, a=b"\n,\n")).collect()] == [""]


def test_long_document(spark):
    body = "".join(f"<w:p><w:r><w:t>p{i}</w:t></w:r></w:p>" for i in range(20_000))
    f = binary(spark, a=files.pack({"word/document.xml": f"<w:document {files._NS}><w:body>{body}</w:body></w:document>"}))
    assert O.docx_blocks(f).agg(F.count("*"), F.max("seq"), F.min("type")).first()[:] == (20_000, 20_000, "paragraph")


def test_ledger_days_of_odd_sheets(spark):
    head = ["序号", "中心", "姓名", "", "2024-02-01", "9"]
    rows = [
        ("a", "s", 1, 0, head), ("a", "s", 1, 1, ["1", "c", "x", "上班", "x", None]),  # no out row
        ("b", "s", 1, 0, ["序号", "no dates"]),
        ("c", "s", 1, 0, head), ("c", "s", 1, 1, ["1", "c", "y", "上班", "a"]), ("c", "s", 1, 2, ["", "", "", "下", "b"]), ("c", "s", 1, 3, ["1", "c", "y", "上班", "later"]), ("c", "s", 1, 4, ["", "", "", "z"]),
    ]
    got = O.ledger_days(spark.createDataFrame(rows, "path string, sheet string, sheet_no int, row long, cells array<string>"))
    assert {(r.path, r.person, r.day): (r["in"], r.out) for r in got.collect()} == {("a", "x", 1): ("×", ""), ("a", "x", 9): ("", ""), ("c", "y", 1): ("later", ""), ("c", "y", 9): ("", "")}


def test_search_service_against_a_loop(spark):
    texts = ["red fox", "red fox runs", "blue whale", "", None, "red", "green fox", "red fox"]
    c = spark.createDataFrame([(i, t, f"t{i}") for i, t in enumerate(texts)], "id long, text string, title string")
    q = spark.createDataFrame([(1, "red fox"), (2, "whale")], "query_id long, text string")
    emb = V.embed_chunks(c, hashed_encoder)
    assert emb.count() == len(texts) and emb.where("text is null and vector is null").count() == 1
    got = V.search(emb, q, hashed_encoder, overlap_scorer, 6, 2, F.col("id") != 0, 0.5)
    by = {}
    for r in got.orderBy("query_id", "final_rank").collect():
        by.setdefault(r.query_id, []).append((r.id, r.rerank_score))
    assert [i for i, _ in by[1]] == [7, 1] and by[2][0] == (2, 1.0)
    none = V.search(emb.where("false"), q, hashed_encoder, overlap_scorer)
    assert none.count() == 0


def test_answer_plan_edges(spark):
    q = spark.createDataFrame([(1, "  谢谢？", None, None), (2, None, None, None), (3, "why", None, None), (4, "more", False, "x")], "query_id long, question string, need_retrieval boolean, previous_answer string")
    h = spark.createDataFrame([(3, 1, 9, None, None, "", None), (3, 1, 8, "T", 2, "S", "text")], "query_id long, final_rank int, id long, title string, page int, section string, text string")
    got = {r.query_id: r for r in V.answer_plan(q, h, "<%s>").collect()}
    assert [got[i].route for i in (1, 2, 3, 4)] == ["direct", "refused", "generate", "direct"]
    assert got[1].answer == V.GREETING_REPLIES["谢谢"] and got[2].answer == V.REFUSAL
    assert got[3].prompt == "<[1]《T》第2页（S）：text\n[2]《》第0页：>" and [c.id for c in got[3].citations] == [8, 9]
    assert got[4].prompt == "上一轮回答：x\n\nmore"


ASKED = [
    ("张三丰剩余", None, "person", "张三丰"), ("张三和李四加班", "w", "several", "w"), ("他的加班哪天", "李四", "person", "李四"), ("他加班", None, "unnamed", None),
    ("", "李四", None, None), (None, "李四", None, None), ("几" * 201, "李四", None, None), ("有没有王五？", "w", "absent", "w"), ("谁", "w", "unknown", "w"), ("如何合并", "w", "merge", "w"),
]


def test_ledger_answers(spark):
    rows = spark.createDataFrame([{"person_name": n, **EMPTY} for n in ("张三", "李四", "张三丰", " ")], "person_name string, travel_comp_days double, ot_comp_days double, total_comp_days double, used_comp_days double, remaining_comp_days double, remark string, ot_days " + L.OT_DAY)
    q = spark.createDataFrame([(i, text, last) for i, (text, last, _, _) in enumerate(ASKED)], "query_id long, text string, last_person string")
    got = {r.query_id: (r.kind, r.person, r.answer is None) for r in V.ledger_answers(q, rows, "parsed").collect()}
    assert got == {i: (kind, person, kind is None) for i, (_, _, kind, person) in enumerate(ASKED)}
    bare = {r.query_id: r.kind for r in V.ledger_answers(q, rows.where("false"), "parsed").collect()}
    assert bare == {i: kind if kind in (None, "merge") else "empty" for i, (_, _, kind, _) in enumerate(ASKED)}


def test_jobs_without_rows(spark):
    jobs = spark.createDataFrame([(1, "parsed"), (2, None), (3, "voided")], "job_id long, status string")
    none = spark.createDataFrame([], "job_id long, role string")
    j, rows = V.confirm(jobs, none, none, none)
    assert {r.job_id: (r.outcome, r.roles) for r in j.collect()} == {1: ("confirmed", None), 2: ("confirmed", None), 3: ("refused_voided", None)} and rows.count() == 0
    up = spark.createDataFrame([(1, 1, "leave"), (1, 2, "leave"), (1, 3, None), (9, 1, "leave"), (3, 1, "leave")], "job_id long, seq int, role string")
    assert sorted((r.job_id, r.seq, r.outcome) for r in V.add_sources(jobs, none, up).collect()) == [(1, 1, "stored"), (1, 2, "duplicate"), (1, 3, "unknown_role"), (3, 1, "closed"), (9, 1, "closed")]


def test_cache_takes_the_latest_entry_within_its_time(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    cache = spark.createDataFrame([("a", at(1), 1), ("a", at(9), 2), ("b", at(0), 3)], "key string, at timestamp, hits int")
    run, known = V.split_cached(spark.createDataFrame([("a",), ("b",), (None,)], "key string"), cache, F.lit("2024-01-01 00:00:10").cast("timestamp"), 10)
    assert sorted(str(r.key) for r in run.collect()) == ["None", "b"] and [tuple(r) for r in known.collect()] == [("a", 2)]
