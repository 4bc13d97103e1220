"""Queries over sprint events, scenarios and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dist as D
from ..functions.rng import normal_sql, uniform_sql
from ..operators import forecast as M
from ..operators import sprints as P
from ..sources import tables as T

N_SIMS, SEED, LENGTH = 200, 1, 10

EVENTS = """
ev AS (SELECT event_id AS seq, CASE WHEN event_id % 100 <= 1 THEN 'configured' WHEN event_id % 100 <= 39 THEN 'added' WHEN event_id % 100 <= 49 THEN 'removed' WHEN event_id % 100 <= 74 THEN 'status'
    WHEN event_id % 100 <= 84 THEN 'scope' ELSE 'availability' END AS type, user_id % 10 AS sprint_id, event_id % 53 AS item_id, ts::DATE AS day, round(value - 20, 2) AS delta,
    (['todo', 'in_progress', 'done'])[event_id % 3 + 1] AS new_status, round(value / 10 - 1, 3) AS scope_factor, value FROM events),
conf AS (SELECT sprint_id, max(seq) AS conf_seq, arg_max(day, seq) AS start_day FROM ev WHERE type = 'configured' GROUP BY sprint_id),
dropped AS (SELECT sprint_id, item_id, max(seq) AS d FROM ev JOIN conf USING (sprint_id) WHERE type = 'removed' AND seq > conf_seq GROUP BY ALL),
held AS (SELECT ev.sprint_id, ev.item_id, min(seq) AS start_seq FROM ev JOIN conf USING (sprint_id) LEFT JOIN dropped x ON x.sprint_id = ev.sprint_id AND x.item_id = ev.item_id
  WHERE type = 'added' AND seq > greatest(conf_seq, coalesce(d, -1)) GROUP BY ALL),
item AS (SELECT h.sprint_id, h.item_id, coalesce(arg_max(new_status, seq) FILTER (type = 'status'), 'todo') AS status, greatest(0.0::DOUBLE, coalesce(arg_max(scope_factor, seq) FILTER (type = 'scope'), 1.0::DOUBLE)) AS factor
  FROM held h LEFT JOIN ev ON ev.item_id = h.item_id AND ev.seq > h.start_seq AND ev.type IN ('status', 'scope') GROUP BY h.sprint_id, h.item_id),
walk AS (SELECT conf.sprint_id, e.day, seq, sum(delta) OVER (PARTITION BY conf.sprint_id, e.day ORDER BY seq) AS s FROM ev e JOIN conf ON seq > conf_seq WHERE type = 'availability'),
cap AS (SELECT sprint_id, day, round(arg_max(s, seq) + greatest(8.0::DOUBLE, -min(s)), 4) AS available FROM walk GROUP BY sprint_id, day)"""

CAL = f"""
dayz AS (SELECT sprint_id, i + 1 AS day_index, (start_day + i::INTEGER)::DATE AS day FROM conf, (SELECT unnest(generate_series(0, {LENGTH - 1})) AS i)),
cal AS (SELECT d.sprint_id, day_index::INTEGER AS day_index, d.day, isodow(d.day) <= 5 AS is_working,
  greatest(0.0::DOUBLE, coalesce(available, CASE WHEN isodow(d.day) <= 5 THEN 8.0::DOUBLE ELSE 0.0::DOUBLE END)) AS cap FROM dayz d LEFT JOIN cap c ON c.sprint_id = d.sprint_id AND c.day = d.day)"""


def _ev(spark, sf):
    return T.domain_events(spark, sf)


def q34(spark, sf):
    return P.membership(_ev(spark, sf))


def q35(spark, sf):
    return P.item_state(_ev(spark, sf))


def q36(spark, sf):
    return P.capacity(_ev(spark, sf))


def _payloads(spark, sf):
    """Effort payloads as JSON text; one in eleven is of an unknown type and one in thirteen isn't JSON."""
    v = F.col("value")
    body = F.to_json(F.struct(F.when(F.col("event_id") % 11 == 0, "other").otherwise("quantiles").alias("type"), F.create_map(F.lit("0.5"), F.round(v / 100, 4), F.lit("0.8"), F.round(v / 100 * 1.5, 4), F.lit("0.9"), F.round(v / 50, 4)).alias("quantiles")))
    return T.table(spark, sf, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") % 53).alias("item_id"), F.when(F.col("event_id") % 13 == 0, "{broken").otherwise(body).alias("body"))


def _decoded(spark, sf):
    return _payloads(spark, sf).withColumn("payload", D.decoded(F.col("body")))


def q30(spark, sf):
    d = _decoded(spark, sf)
    ok = F.col("payload.type").isin("quantiles", "gmm")
    q = F.col("payload.quantiles")
    return d.select("seq", F.coalesce(ok, F.lit(False)).alias("valid"), F.when(ok, q["0.5"]).alias("p50"), F.when(ok, q["0.9"]).alias("p90"))


Q30 = """
SELECT event_id AS seq, event_id % 13 <> 0 AND event_id % 11 <> 0 AS valid, CASE WHEN event_id % 13 <> 0 AND event_id % 11 <> 0 THEN round(value / 100, 4) END AS p50,
  CASE WHEN event_id % 13 <> 0 AND event_id % 11 <> 0 THEN round(value / 50, 4) END AS p90 FROM events"""


def q37(spark, sf):
    return P.latest_effort(_decoded(spark, sf)).select("item_id", "seq", F.col("payload.quantiles")["0.5"].alias("p50"))


Q37 = """
SELECT event_id % 53 AS item_id, max(event_id) AS seq, arg_max(round(value / 100, 4), event_id) AS p50 FROM events WHERE event_id % 13 <> 0 AND event_id % 11 <> 0 GROUP BY event_id % 53"""


def _calendar(ev):
    return P.calendar(P.configured(ev), P.capacity(ev), LENGTH)


def q38(spark, sf):
    return _calendar(_ev(spark, sf))


def _scenarios(spark, sf):
    """Items and calendar of baseline, scope growth by 10 % and time off on each sprint's declared even days."""
    ev = _ev(spark, sf)
    items, conf, caps = P.item_state(ev), P.configured(ev), P.capacity(ev)
    off = P.time_off(caps, -4.0, F.dayofmonth("day") % 2 == 0)
    base, grown = P.calendar(conf, caps, LENGTH), P.scope_growth(items, 1.1)
    named = lambda df, s: df.withColumn("scenario", F.lit(s))
    all_items = named(items, "baseline").unionByName(named(grown, "scope_growth")).unionByName(named(items, "time_off"))
    cals = named(base, "baseline").unionByName(named(base, "scope_growth")).unionByName(named(P.calendar(conf, off, LENGTH), "time_off"))
    return all_items, cals


def q39(spark, sf):
    items, cals = _scenarios(spark, sf)
    a = items.groupBy("scenario", "sprint_id").agg(F.count_if(F.col("status") != "done").alias("open_items"), F.round(F.sum(F.when(F.col("status") != "done", F.col("factor"))), 4).alias("open_scope"))
    b = cals.groupBy("scenario", "sprint_id").agg(F.round(F.sum(F.when(F.col("is_working"), F.col("cap"))), 3).alias("working_hours"))
    return b.join(a, ["scenario", "sprint_id"], "left").select("scenario", "sprint_id", F.coalesce("open_items", F.lit(0)).cast("bigint").alias("open_items"), F.coalesce("open_scope", F.lit(0.0)).alias("open_scope"), "working_hours")


SCEN = """
sitem AS (SELECT 'baseline' AS scenario, * FROM item UNION ALL SELECT 'time_off', * FROM item
  UNION ALL SELECT 'scope_growth', sprint_id, item_id, status, CASE WHEN status <> 'done' THEN factor * 1.1::DOUBLE ELSE factor END FROM item),
offc AS (SELECT d.sprint_id, day_index::INTEGER AS day_index, d.day, isodow(d.day) <= 5 AS is_working,
  greatest(0.0::DOUBLE, coalesce(CASE WHEN day(c.day) % 2 = 0 THEN greatest(0.0::DOUBLE, available - 4) ELSE available END, CASE WHEN isodow(d.day) <= 5 THEN 8.0::DOUBLE ELSE 0.0::DOUBLE END)) AS cap
  FROM dayz d LEFT JOIN cap c ON c.sprint_id = d.sprint_id AND c.day = d.day),
scal AS (SELECT 'baseline' AS scenario, * FROM cal UNION ALL SELECT 'scope_growth', * FROM cal UNION ALL SELECT 'time_off', * FROM offc)"""

Q39 = f"""
WITH {EVENTS}, {CAL}, {SCEN},
a AS (SELECT scenario, sprint_id, count(*) FILTER (status <> 'done') AS n, round(sum(factor) FILTER (status <> 'done'), 4) AS f FROM sitem GROUP BY ALL),
b AS (SELECT scenario, sprint_id, round(sum(cap) FILTER (is_working), 3) AS working_hours FROM scal GROUP BY ALL)
SELECT b.scenario, b.sprint_id, coalesce(n, 0)::BIGINT AS open_items, coalesce(f, 0.0::DOUBLE) AS open_scope, working_hours FROM b LEFT JOIN a ON a.scenario = b.scenario AND a.sprint_id = b.sprint_id"""

SAMPLES = (8.0, 10.0, 12.0, 5.0, 6.5)


def q40(spark, sf):
    """Items draw their effort from a lognormal by item; throughput is a bootstrap."""
    items, cals = _scenarios(spark, sf)
    effort = M.lognormal(F.lit(0.0), F.lit(1.0), SEED, "effort", F.col("item_id"), F.col("sim"))
    sims = M.simulate(items, cals, SAMPLES, N_SIMS, SEED, F.round(effort, 6), ["scenario", "sprint_id"])
    return M.summarise(sims, ["scenario", "sprint_id"], LENGTH)


def _q40_sql() -> str:
    effort = f"round(exp({normal_sql(f"'{SEED}|effort|' || item_id || '|' || sim")}), 6)"
    draw = f"list_extract([{', '.join(f'{x}::DOUBLE' for x in SAMPLES)}], floor({uniform_sql(f"'{SEED}|throughput|' || day_index || '|' || sim")} * {len(SAMPLES)})::INTEGER + 1)"
    days = ", ".join(f"round(avg(CASE WHEN done_day <= {d} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS p_day_{d}" for d in range(1, LENGTH + 1))
    return f"""
WITH {EVENTS}, {CAL}, {SCEN}, sims AS (SELECT unnest(generate_series(0, {N_SIMS - 1})) AS sim),
t AS (SELECT scenario, sprint_id, sim, sum(round({effort} * greatest(0.0::DOUBLE, factor) * 10000)::BIGINT)::BIGINT AS total FROM sitem, sims WHERE status <> 'done' GROUP BY ALL),
dd AS (SELECT scenario, sprint_id, sim, day_index, round(least({draw}, cap) * 10000)::BIGINT AS daily FROM scal, sims WHERE is_working AND cap > 0),
c AS (SELECT scenario, sprint_id, sim, day_index, (sum(daily) OVER (PARTITION BY scenario, sprint_id, sim ORDER BY day_index))::BIGINT AS cum FROM dd),
r AS (SELECT t.scenario, t.sprint_id, t.sim, total, min(day_index) FILTER (cum >= total) AS done_day, greatest(0, total - coalesce(max(cum), 0)) AS remaining
  FROM t LEFT JOIN c ON c.scenario = t.scenario AND c.sprint_id = t.sprint_id AND c.sim = t.sim GROUP BY t.scenario, t.sprint_id, t.sim, total)
SELECT scenario, sprint_id, round(avg(CASE WHEN done_day IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS p_end, {days},
  round(quantile_cont(remaining / 10000.0::DOUBLE, 0.5), 6) AS remaining_p50, round(quantile_cont(remaining / 10000.0::DOUBLE, 0.9), 6) AS remaining_p90,
  floor(quantile_cont(done_day::DOUBLE, 0.5))::INTEGER AS day_p50, floor(quantile_cont(done_day::DOUBLE, 0.9))::INTEGER AS day_p90 FROM r GROUP BY scenario, sprint_id"""


QUERIES = {
    "q30_payload_json": (q30, Q30),
    "q34_sprint_membership": (q34, f"WITH {EVENTS} SELECT * FROM held"),
    "q35_item_state": (q35, f"WITH {EVENTS} SELECT * FROM item"),
    "q36_capacity_walk": (q36, f"WITH {EVENTS} SELECT * FROM cap"),
    "q37_effort_store": (q37, Q37),
    "q38_sprint_calendar": (q38, f"WITH {EVENTS}, {CAL} SELECT * FROM cal"),
    "q39_scenarios": (q39, Q39),
    "q40_sprint_forecast": (q40, _q40_sql()),
}
