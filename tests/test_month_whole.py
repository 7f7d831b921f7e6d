import datetime as dt

from quarry import plans
from quarry.operators.attendance import LEAVE


def test_month_has_every_customer_and_day(spark, tmp_path):
    day = lambda i: dt.datetime(2024, 1, 1 + i % 31, 9)
    save = lambda name, rows, kind: spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    save("customer", [(i, i % 25) for i in range(1, 201)], "c_custkey long, c_nationkey int")
    save("orders", [(i, i, "O") for i in range(1, 201)], "o_orderkey long, o_custkey long, o_orderstatus string")
    save("events", [(i, day(i), 1 + i % 200) for i in range(800)], "event_id long, ts timestamp, user_id long")
    q = plans.queries()
    grid = q["month_grid"](spark, str(tmp_path)).collect()
    assert {r.person for r in grid} >= {f"w{i}" for i in range(1, 201) if i % 40}
    assert sum(r.person == "w199" for r in grid) == 2 * 23
    # order 199 is leave from Jan 9 (199 * 3 % 31) to the day after: both are in the grid
    assert {(r.day, r.symbol) for r in grid if r.person == "w199" and r.day in ("2024-01-09", "2024-01-10")} == {(d, leave_or_trip(199, d)) for d in ("2024-01-09", "2024-01-10")}
    rows = q["month_symbol_rows"](spark, str(tmp_path))
    assert rows.columns == ["person", "side", *(f"d{i:02}" for i in range(1, 32))]
    kept = {(r.person, r.side, r.day): r.symbol for r in grid}
    for r in rows.where("person in ('w3', 'w160', 'w199')").collect():
        assert all(r[f"d{i:02}"] == kept.get((r.person, r.side, f"2024-01-{i:02}")) for i in range(1, 32))


def leave_or_trip(k, d):
    start = k * 5 % 31
    on_trip = start <= int(d[-2:]) - 1 <= start + k % 4
    return "×" if on_trip else LEAVE
