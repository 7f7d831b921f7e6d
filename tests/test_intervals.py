import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.operators import intervals

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
slow = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@slow
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 25)), max_size=25))
def test_stints_match_a_walk_over_sorted_days(spark, rows):
    df = spark.createDataFrame([(k, D(n)) for k, n in rows], "k string, day date")
    got = {(r.k, r["index"], r.entry_date, r.exit_date, r.days) for r in intervals.stints(df, ["k"], "day").collect()}
    want = set()
    for k in {k for k, _ in rows}:
        runs = []
        for n in sorted({n for kk, n in rows if kk == k}):
            if runs and runs[-1][1] == n - 1:
                runs[-1][1] = n
            else:
                runs.append([n, n])
        want |= {(k, i, D(a), D(b), b - a + 1) for i, (a, b) in enumerate(runs, 1)}
    assert got == want


@slow
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 12)), max_size=12), st.integers(0, 3))
def test_merged_intervals_match_a_sweep(spark, rows, gap):
    df = spark.createDataFrame([("x", D(a), D(a + n)) for a, n in rows], "k string, s date, e date")
    got = sorted((r.s, r.e) for r in intervals.merge_intervals(df, ["k"], "s", "e", gap).collect())
    want = []
    for a, n in sorted(rows):
        if want and a <= want[-1][1] + gap + 1:
            want[-1][1] = max(want[-1][1], a + n)
        else:
            want.append([a, a + n])
    assert got == [(D(a), D(b)) for a, b in want]


def test_reversed_bounds_give_no_days_and_credit_is_per_block(spark):
    r = spark.range(1).select(F.size(intervals.days_between(F.lit(D(3)), F.lit(D(1)))).alias("n"), *(intervals.block_credit(F.lit(d)).alias(f"c{d}") for d in (29, 30, 60))).first()
    assert (r.n, r.c29, r.c30, r.c60) == (0, 0.0, 2.0, 4.0)
