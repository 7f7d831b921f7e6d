"""Joins whose sides repeat: neither a row per project in a broadcast nor all images of a place for each citation."""

import random

from quarry import plans
from quarry.operators import retrieval, staffing


def _broadcast_as_read(df) -> list[str]:
    """What is broadcast without having been dealt out first, so that its size is only guessed: expanded or scanned tables."""
    lines = [(len(x) - len(x.lstrip(" +-:|*(0123456789)")), x.lstrip(" +-:|*(0123456789)")) for x in str(df._jdf.queryExecution().executedPlan().toString()).split("\n") if x.strip()]
    found = []
    for at, (depth, text) in enumerate(lines):
        if not text.startswith("BroadcastExchange"):
            continue
        dealt = None
        for d, t in lines[at + 1 :]:
            if d <= depth:
                break
            dealt = None if dealt is not None and d <= dealt else dealt
            if dealt is None and t.startswith("Exchange"):
                dealt = d
            elif dealt is None and t.startswith(("Generate", "FileScan", "Scan")):
                found.append(t)
    return found


def test_no_table_of_projects_is_broadcast(spark, tmp_path):
    spark.createDataFrame([(i, f"almond {i % 5}") for i in range(1, 41)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    q = plans.queries()["project_prefix_match"](spark, str(tmp_path))
    assert not _broadcast_as_read(q)
    assert {tuple(r)[1:] for r in q.collect()} == {("ambiguous", None, 40), ("ambiguous", None, 8)}


def test_projects_and_docs_of_several_codes(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(0, 4)))
    codes = [(rng.randrange(25), word()) for _ in range(40)]
    projects = [(rng.randrange(12), word()) for _ in range(16)]
    got = staffing.match_projects(spark.createDataFrame(codes, "doc long, code string"), spark.createDataFrame(projects, "id long, code string"))
    want = set()
    for doc in {d for d, _ in codes}:
        hits = {i for d, c in codes if d == doc and c for i, p in projects if p and (p.startswith(c) or c.startswith(p))}
        want.add((doc, "matched" if len(hits) == 1 else "ambiguous" if hits else "unmatched", min(hits) if len(hits) == 1 else None, len(hits)))
    assert {tuple(r) for r in got.collect()} == want


def test_citations_meet_only_the_first_images_of_a_place(spark):
    cites = [(f"c{i % 90}", "d", "v", "", "h" if i % 2 else "", i % 3) for i in range(120)] + [("own", "d", "v", "i7", "h", 0), ("none", "e", "v", "", "x", 0)]
    images = [(f"i{i}", "d", "v", "h" if i % 3 else "g", i % 4) for i in range(60)]
    out = retrieval.citation_images(spark.createDataFrame(cites, "citation_id string, doc_id string, version_id string, image_id string, heading_path string, page int"), spark.createDataFrame(images, "id string, doc_id string, version_id string, heading_path string, page int"))
    plan = str(out._jdf.queryExecution().executedPlan().toString())
    assert plan.count("WindowGroupLimit [_d") >= 2  # ranked before they are joined
    want = []
    for c in {c[0] for c in cites}:
        met = []
        for _, doc, v, own, head, page in (x for x in cites if x[0] == c):
            met += [i for i, d, iv, h, p in images if d == doc and (i == own if own else h == head if head else (p, iv) == (page, v))]
        want += [(c, i, k) for k, i in enumerate(sorted(met)[:3])]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
