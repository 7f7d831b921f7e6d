"""Queries over monthly attendance: January 2024 of the events table as punches, orders as trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attendance as A
from .inputs import table

S = F.col
PLACES = A.Places(labels={"north": ["NORTHCO"], "south": ["SOUTHCO"]}, transit=["station"], overseas=["泰国"], default_site="north")
FIRST, LAST = "2024-01-01", "2024-01-31"


def _roster(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.concat(F.lit("w"), S("c_custkey"), F.when(S("c_custkey") % 40 == 0, F.lit("（离职）")).otherwise("")).alias("name"), F.expr("concat('c', c_nationkey % 3)").alias("center"), F.expr("case c_custkey % 3 when 0 then 'south' when 1 then '' else 'north' end").alias("base_site"))


def _punch(spark, d):
    e = table(spark, d, "events")
    addr = F.expr("case event_id % 9 when 0 then 'NORTHCO' when 1 then 'SOUTHCO' when 2 then 'x 泰国 y' when 3 then 'station' when 4 then '' when 5 then 'in THAILAND' else concat('site', event_id % 4) end")
    return e.select(S("event_id").alias("seq"), F.expr("concat('w', user_id)").alias("person_name"), F.to_date("ts").alias("work_date"), F.expr("case when event_id % 2 = 0 then 'in' else 'out' end").alias("side"), F.expr("case event_id % 13 when 0 then '缺卡' when 1 then '迟到' else '正常' end").alias("status"), addr.alias("address"), F.expr("case when event_id % 17 = 0 then '出差' else '' end").alias("leave_apply"))


def _applicant():
    return F.expr("concat('w', o_custkey)").alias("applicant")


def _travel(spark, d):
    o = table(spark, d, "orders")
    start = F.expr("date_add(date '2024-01-01', cast(o_orderkey * 5 % 31 as int))")
    return o.select(S("o_orderkey").alias("seq"), _applicant(), F.lit("出差").alias("category"), F.expr("case when o_orderkey % 4 = 0 then '泰国' else 'town' end").alias("location"), start.alias("start"), F.date_add(start, F.expr("cast(o_custkey % 4 as int)")).alias("end"), F.expr("case when o_orderstatus = 'P' then '驳回' else '已通过' end").alias("status"))


def _leave(spark, d):
    o = table(spark, d, "orders")
    start = F.expr("date_add(date '2024-01-01', cast(o_orderkey * 3 % 31 as int))")
    return o.select(_applicant(), F.lit("年假").alias("leave_kind"), start.alias("start"), F.date_add(start, F.expr("cast(o_custkey % 2 as int)")).alias("end"), F.expr("case when o_orderkey % 100 = 1 then '下午' end").alias("start_half"), F.lit(None).cast("string").alias("end_half"), F.lit("已通过").alias("status"))


def _located(spark, d):
    return A.located(_punch(spark, d), _roster(spark, d), PLACES)


def punch_locations(spark, d):
    return _located(spark, d).select("seq", "person", "kind", "abroad")


def mixed_day_addresses(spark, d):
    c = A.clear_mixed_days(_located(spark, d), PLACES)
    return c.select("seq", "address", "kind")


def overseas_travel_runs(spark, d):
    r = A.overseas_runs(_travel(spark, d), _located(spark, d))
    return r.select("person", S("start").cast("string").alias("start"), S("end").cast("string").alias("end"))


def first_field_days(spark, d):
    f = A.first_field_day(_travel(spark, d), _located(spark, d))
    return f.select("seq", S("field_day").cast("string").alias("field_day"))


def shifted_overseas_starts(spark, d):
    t = A.shift_overseas_starts(_travel(spark, d), _located(spark, d), PLACES)
    return t.select("seq", S("start").cast("string").alias("start"))


def field_continuations(spark, d):
    c = A.field_continuations(_travel(spark, d), _located(spark, d))
    return c.select("person", S("start").cast("string").alias("start"), S("end").cast("string").alias("end"))


def leave_half_days(spark, d):
    x = A.leave_sides(_leave(spark, d))
    return x.select("person", S("day").cast("string").alias("day"), "side", "leave_kind")


def _grid(spark, d):
    return A.month_grid(_roster(spark, d), A.calendar(FIRST, 31, spark), _travel(spark, d), _leave(spark, d), _punch(spark, d), FIRST, LAST, PLACES)


def month_grid(spark, d):
    return _grid(spark, d).select("person", S("day").cast("string").alias("day"), "side", "symbol", "conflict")


def month_tallies(spark, d):
    return A.month_tallies(_grid(spark, d))


def month_symbol_rows(spark, d):
    return A.symbol_grid(_grid(spark, d)).select("person", "side", *(S(str(i)).alias(f"d{i:02}") for i in range(1, 32)))


def leave_travel_conflicts(spark, d):
    return A.conflicts(_grid(spark, d)).select("person", S("day").cast("string").alias("day"))


def off_day_punches(spark, d):
    p = A.off_day_punches(_punch(spark, d), A.calendar(FIRST, 31, spark))
    return p.select("person", S("day").cast("string").alias("day"), "plan")


def makeup_cap(spark, d):
    p = _punch(spark, d)
    real = p.where("status = '正常'").select(S("person_name").alias("person"), S("work_date").alias("day"), "side")
    gaps = p.where("status = '缺卡'").select(S("person_name").alias("person"), S("work_date").alias("day"), "side").distinct()
    return A.makeup_accepted(gaps, real, 2).select("person", S("day").cast("string").alias("day"), "side")


def work_calendar(spark, d):
    """The work days of the month, if anything happened in it."""
    months = table(spark, d, "events").select(F.trunc("ts", "MM").alias("month")).distinct()
    return A.calendar(FIRST, 31, spark).join(months, F.trunc("day", "MM") == S("month"), "left_semi").select(S("day").cast("string").alias("day"))


def person_names(spark, d):
    n = F.concat(F.lit(" "), S("n_name"), F.element_at(F.array(*(F.lit(x) for x in ("（已离职）", " · x", "[离职 2023]", ""))), (S("n_nationkey") % 4 + 1).cast("int")))
    return table(spark, d, "nation").select("n_nationkey", A.normalize_name(n).alias("name"), A.marked_departed(n).alias("departed"))


QUERIES = {f.__name__: f for f in (punch_locations, mixed_day_addresses, overseas_travel_runs, first_field_days, shifted_overseas_starts, field_continuations, leave_half_days, month_grid, month_tallies, month_symbol_rows, leave_travel_conflicts, off_day_punches, makeup_cap, work_calendar, person_names)}

_PUNCH = "p AS (SELECT event_id seq, 'w' || user_id person, user_id, CAST(ts AS DATE) wd, CASE WHEN event_id % 2 = 0 THEN 'in' ELSE 'out' END side, CASE event_id % 13 WHEN 0 THEN '缺卡' WHEN 1 THEN '迟到' ELSE '正常' END status, CASE event_id % 9 WHEN 0 THEN 'NORTHCO' WHEN 1 THEN 'SOUTHCO' WHEN 2 THEN 'x 泰国 y' WHEN 3 THEN 'station' WHEN 4 THEN '' WHEN 5 THEN 'in THAILAND' ELSE 'site' || (event_id % 4) END address FROM events)"
_LOC = "r AS (SELECT CASE c_custkey % 40 WHEN 0 THEN 'w' || c_custkey ELSE 'w' || c_custkey END person, CASE c_custkey % 3 WHEN 0 THEN 'south' ELSE 'north' END base FROM customer), loc AS (SELECT p.*, CASE WHEN address = '' OR status = '缺卡' THEN 'unknown' WHEN address = CASE coalesce(base, 'north') WHEN 'south' THEN 'SOUTHCO' ELSE 'NORTHCO' END THEN 'base_company' WHEN address IN ('NORTHCO', 'SOUTHCO') THEN 'other_company' WHEN address = 'station' THEN 'home_transit' ELSE 'field' END kind, CASE WHEN contains(address, '泰国') THEN '泰国' WHEN contains(lower(address), 'thailand') THEN 'thailand' END abroad FROM p LEFT JOIN r USING (person))"
_TRAVEL = "t AS (SELECT o_orderkey seq, 'w' || o_custkey person, o_orderkey % 4 = 0 ab, DATE '2024-01-01' + CAST(o_orderkey * 5 % 31 AS INT) s, DATE '2024-01-01' + CAST(o_orderkey * 5 % 31 + o_custkey % 4 AS INT) e, o_orderstatus != 'P' ok FROM orders)"
_ALL = f"WITH {_PUNCH}, {_LOC}, {_TRAVEL}"
_FF = "f AS (SELECT t.seq, min(wd) fd FROM t JOIN loc ON loc.person = t.person AND wd BETWEEN s AND e AND kind IN ('field', 'other_company') GROUP BY t.seq)"
_ISL = "SELECT *, sum(o) OVER (PARTITION BY person ORDER BY wd) g FROM (SELECT *, CASE WHEN wd - lag(wd) OVER (PARTITION BY person ORDER BY wd) = 1 THEN 0 ELSE 1 END o FROM "

#: The month's grid, step by step: bare labels cleared, trips shifted, made from punches abroad and gone on with in the field, days clipped, symbols.
_GRID = f"""{_ALL},
l AS (SELECT seq, person, wd, side, status, CASE WHEN aw AND address IN ('NORTHCO', 'SOUTHCO') AND abroad IS NULL THEN 'unknown' ELSE kind END kind, abroad FROM (SELECT *, bool_or(kind IN ('field', 'other_company') OR abroad IS NOT NULL) OVER (PARTITION BY person, wd) aw FROM loc)),
f2 AS (SELECT t.seq, min(wd) fd FROM t JOIN l ON l.person = t.person AND wd BETWEEN s AND e AND kind IN ('field', 'other_company') WHERE ok AND ab GROUP BY t.seq),
t2 AS (SELECT person, ab, greatest(s, coalesce(fd, s)) s, e, 'own' src FROM t LEFT JOIN f2 ON f2.seq = t.seq WHERE ok),
x AS (SELECT DISTINCT person, wd FROM l WHERE abroad IS NOT NULL AND kind != 'base_company' AND NOT EXISTS (SELECT 1 FROM t2 WHERE t2.person = l.person AND wd BETWEEN s AND e)),
xi AS ({_ISL} x)),
t3 AS (SELECT * FROM t2 UNION ALL SELECT person, true, min(wd), max(wd), 'made' FROM xi GROUP BY person, g),
y AS (SELECT * FROM (SELECT person, wd FROM l WHERE abroad IS NULL AND kind IN ('field', 'base_company') GROUP BY person, wd HAVING NOT bool_or(kind = 'base_company')) q WHERE NOT EXISTS (SELECT 1 FROM t3 WHERE t3.person = q.person AND wd BETWEEN s AND e)),
yi AS ({_ISL} y)),
more AS (SELECT DISTINCT yi.person, false ab, yi.wd s, z.b e, 'more' src FROM yi JOIN (SELECT person, g, max(wd) b FROM yi GROUP BY ALL) z ON z.person = yi.person AND z.g = yi.g JOIN t2 ON t2.person = yi.person AND yi.wd = t2.e + 1),
trips AS (SELECT *, row_number() OVER () id FROM (SELECT * FROM t3 UNION ALL SELECT * FROM more)),
pd AS (SELECT person, wd, bool_or(kind = 'base_company') base, bool_or(kind IN ('field', 'other_company') OR abroad IS NOT NULL) aw FROM l GROUP BY ALL),
mo AS (SELECT DATE '2024-01-01' + i::INT dd FROM range(31) r(i)),
td AS (SELECT trips.*, dd, coalesce(base, false) base, coalesce(aw, false) aw FROM trips JOIN mo ON dd BETWEEN s AND e LEFT JOIN pd ON pd.person = trips.person AND pd.wd = dd),
tc AS (SELECT *, dd = s AND base AND NOT aw home FROM td),
tk AS (SELECT *, min(CASE WHEN base AND NOT home THEN CASE WHEN aw THEN dd + 1 ELSE dd END END) OVER (PARTITION BY id) clip FROM tc),
away AS (SELECT person, dd, bool_or(ab) ab FROM tk WHERE (clip IS NULL OR dd < clip) AND NOT home GROUP BY ALL),
lv AS (SELECT DISTINCT person, dd, side FROM (SELECT person, st, pm, st + unnest(range(k + 1))::INT AS dd FROM (SELECT 'w' || o_custkey person, DATE '2024-01-01' + CAST(o_orderkey * 3 % 31 AS INT) st, CAST(o_custkey % 2 AS INT) k, o_orderkey % 100 = 1 pm FROM orders)), (SELECT unnest(['in', 'out']) side) WHERE NOT (dd = st AND pm AND side = 'in')),
seen AS (SELECT person, wd, side, bool_or(status = '迟到') late, bool_or(kind = 'base_company') hq, bool_or(seq % 17 = 0) says, bool_or(abroad IS NOT NULL) far FROM l WHERE status != '缺卡' GROUP BY ALL),
who AS (SELECT 'w' || c_custkey person, c_custkey % 40 = 0 gone FROM customer),
gr AS (SELECT who.person, dd, side FROM who LEFT JOIN (SELECT person, max(wd) til FROM l GROUP BY person) u ON u.person = who.person, mo, (SELECT unnest(['in', 'out']) side) WHERE isodow(dd) <= 5 AND (NOT gone OR dd <= coalesce(til, DATE '1970-01-01'))),
j AS (SELECT gr.*, away.person IS NOT NULL trav, coalesce(away.ab, false) ab, lv.person IS NOT NULL lve, seen.person IS NOT NULL pun, coalesce(late, false) late, coalesce(hq, false) hq, coalesce(says, false) says, coalesce(far, false) far FROM gr LEFT JOIN away ON away.person = gr.person AND away.dd = gr.dd LEFT JOIN lv ON lv.person = gr.person AND lv.dd = gr.dd AND lv.side = gr.side LEFT JOIN seen ON seen.person = gr.person AND seen.wd = gr.dd AND seen.side = gr.side),
grid AS (SELECT *, trav AND lve conflict, CASE WHEN (trav OR says AND NOT hq) AND pun AND NOT hq THEN CASE WHEN ab OR far THEN '＄' ELSE '￥' END WHEN lve AND NOT (trav AND lve) AND NOT (says AND NOT hq) THEN '假' WHEN pun THEN '√' ELSE '×' END symbol FROM j)"""

ORACLE_SQL = {
    "month_grid": f"{_GRID} SELECT person, CAST(dd AS VARCHAR) AS \"day\", side, symbol, conflict FROM grid",
    "month_tallies": f"""{_GRID} SELECT person, count(DISTINCT dd) required, (SELECT count(*) FROM (SELECT dd FROM grid h WHERE h.person = grid.person GROUP BY dd HAVING count(*) FILTER (WHERE symbol = '×') = 2)) absent, sum(CASE WHEN symbol = '√' THEN 0.5 ELSE 0.0 END)::DOUBLE present, sum(CASE WHEN symbol = '￥' THEN 0.5 ELSE 0.0 END)::DOUBLE domestic, sum(CASE WHEN symbol = '＄' THEN 0.5 ELSE 0.0 END)::DOUBLE overseas, sum(CASE WHEN symbol = '假' THEN 0.5 ELSE 0.0 END)::DOUBLE "leave", CAST(count(*) FILTER (WHERE late) AS BIGINT) late, CAST(count(*) FILTER (WHERE symbol = '×') AS BIGINT) missing FROM grid GROUP BY person""",
    "month_symbol_rows": f"{_GRID} SELECT person, side, " + ", ".join(f"max(CASE WHEN day(dd) = {i} THEN symbol END) d{i:02}" for i in range(1, 32)) + " FROM grid GROUP BY person, side",
    "leave_travel_conflicts": f"{_GRID} SELECT DISTINCT person, CAST(dd AS VARCHAR) AS \"day\" FROM grid WHERE conflict",
    "punch_locations": f"{_ALL} SELECT seq, person, kind, abroad FROM loc",
    "mixed_day_addresses": f"{_ALL}, m AS (SELECT *, bool_or(kind IN ('field', 'other_company') OR abroad IS NOT NULL) OVER (PARTITION BY person, wd) aw FROM loc) SELECT seq, CASE WHEN aw AND address IN ('NORTHCO', 'SOUTHCO') THEN '' ELSE address END address, CASE WHEN aw AND address IN ('NORTHCO', 'SOUTHCO') THEN 'unknown' ELSE kind END kind FROM m",
    "overseas_travel_runs": f"{_ALL}, x AS (SELECT DISTINCT person, wd FROM loc WHERE abroad IS NOT NULL AND kind != 'base_company' AND NOT EXISTS (SELECT 1 FROM t WHERE ok AND t.person = loc.person AND wd BETWEEN s AND e)), i AS ({_ISL} x)) SELECT person, CAST(min(wd) AS VARCHAR) AS start, CAST(max(wd) AS VARCHAR) AS \"end\" FROM i GROUP BY person, g",
    "first_field_days": f"{_ALL}, {_FF} SELECT seq, CAST(fd AS VARCHAR) field_day FROM f",
    "shifted_overseas_starts": f"{_ALL}, {_FF} SELECT t.seq, CAST(CASE WHEN ok AND ab THEN greatest(s, coalesce(fd, s)) ELSE s END AS VARCHAR) AS start FROM t LEFT JOIN f ON f.seq = t.seq",
    "field_continuations": f"{_ALL}, x AS (SELECT person, wd FROM loc WHERE abroad IS NULL AND kind IN ('field', 'base_company') GROUP BY person, wd HAVING NOT bool_or(kind = 'base_company')), y AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM t WHERE ok AND t.person = x.person AND wd BETWEEN s AND e)), i AS ({_ISL} y)), z AS (SELECT person, g, max(wd) b FROM i GROUP BY ALL) SELECT DISTINCT i.person, CAST(wd AS VARCHAR) AS start, CAST(b AS VARCHAR) AS \"end\" FROM i JOIN z ON z.person = i.person AND z.g = i.g JOIN t ON t.person = i.person AND ok AND wd = e + 1",
    "leave_half_days": "WITH v AS (SELECT 'w' || o_custkey person, DATE '2024-01-01' + CAST(o_orderkey * 3 % 31 AS INT) s, CAST(o_custkey % 2 AS INT) k, o_orderkey % 100 = 1 pm FROM orders), d AS (SELECT person, s, pm, s + unnest(range(k + 1))::INT AS dd FROM v) SELECT DISTINCT person, CAST(dd AS VARCHAR) AS \"day\", side, '年假' leave_kind FROM d, (SELECT unnest(['in', 'out']) side) WHERE NOT (dd = s AND pm AND side = 'in')",
    "off_day_punches": f"WITH {_PUNCH} SELECT DISTINCT person, CAST(wd AS VARCHAR) AS \"day\", 'blocking' plan FROM p WHERE isodow(wd) > 5 OR wd > DATE '2024-01-31'",
    "makeup_cap": f"WITH {_PUNCH}, g AS (SELECT DISTINCT person, wd, side FROM p WHERE status = '缺卡'), a AS (SELECT * FROM g WHERE EXISTS (SELECT 1 FROM p WHERE p.person = g.person AND p.wd = g.wd AND p.side != g.side AND status = '正常')) SELECT person, CAST(wd AS VARCHAR) AS \"day\", side FROM a QUALIFY row_number() OVER (PARTITION BY person, date_trunc('month', wd) ORDER BY wd, side) <= 2",
    "work_calendar": "SELECT CAST(d AS VARCHAR) AS \"day\" FROM (SELECT DATE '2024-01-01' + i::INT d FROM range(31) t(i)) WHERE isodow(d) <= 5",
    "person_names": "SELECT n_nationkey, replace(n_name, ' ', '') || ['', '•x', '', ''][n_nationkey % 4 + 1] AS name, n_nationkey % 4 IN (0, 2) departed FROM nation",
}
