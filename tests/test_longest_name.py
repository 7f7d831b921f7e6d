from quarry.operators import ledger


def test_longest_name_among_many_lengths(spark):
    names = [("ab" * 60)[:n] for n in range(1, 101)] + ["界" * 3, "", None]
    texts = [(1, "xx" + "ab" * 45 + "c"), (2, "b界界界界"), (3, "zz"), (4, "(a\nb"), (5, None)]
    got = ledger.longest_named(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame([(n,) for n in names], "name string"))
    want = set()
    for i, t in texts:
        held = [n for n in names if n is not None and t is not None and n in t]
        want |= {(i, n) for n in held if len(n) == max(map(len, held))}
    assert {(r.text_id, r.name) for r in got.collect()} == want
