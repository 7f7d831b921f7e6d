from quarry import plans


def test_projects_are_all_parts(spark, tmp_path):
    parts = [(i, f"almond {'abc'[i % 3]}{i % 7}" if i % 4 else f"rose{i}") for i in range(1, 61)]
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    want = set()
    for doc, code in [(2 * i, n[:6]) for i, n in parts] + [(2 * i + 1, n) for i, n in parts]:
        hits = [i for i, n in parts if n.startswith(code) or code.startswith(n)]
        want.add((doc, "matched" if len(hits) == 1 else "ambiguous", hits[0] if len(hits) == 1 else None, len(hits)))
    assert {tuple(r) for r in plans.queries()["project_prefix_match"](spark, str(tmp_path)).collect()} == want
