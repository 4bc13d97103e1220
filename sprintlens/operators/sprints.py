"""Event-sourced sprint state as joins and aggregates over numbered events.

Events have seq, type, sprint_id, item_id, day, delta, new_status, scope_factor. State is
what a fold in the order of seq would leave: configuring a sprint clears it, items are
added once until removed, status and scope reach every sprint that holds the item at that
moment, availability reaches every sprint configured before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEFAULT_CAPACITY = 8.0


def configured(events: DataFrame) -> DataFrame:
    """sprint_id, conf_seq, start_day, and length_days and working_days if the events have them, of each sprint's last configuration."""
    extra = [F.max_by(c, "seq").alias(c) for c in ("length_days", "working_days") if c in events.columns]
    return events.filter("type = 'configured'").groupBy("sprint_id").agg(F.max("seq").alias("conf_seq"), F.max_by("day", "seq").alias("start_day"), *extra)


#: Numbers of the events that stand for a state before the first event.
_PRIOR_CONF, _PRIOR_ADD, _FIRST = -2, -1, -3


def membership(events: DataFrame, prior: DataFrame | None = None, prior_conf: DataFrame | None = None) -> DataFrame:
    """sprint_id, item_id and start_seq of the items that sprints hold in the end.

    prior (sprint_id, item_id) and prior_conf (sprint_id) are the state before the events,
    whose numbers are not negative; items held since then start at -1. The last removal and
    the first addition after it are aggregates that combine before the shuffle, so an item
    with very many moves gathers in no task."""
    conf = configured(events).select("sprint_id", "conf_seq")
    moves = events.filter("type IN ('added', 'removed')").select("sprint_id", "item_id", "type", "seq")
    if prior_conf is not None:
        conf = conf.unionByName(prior_conf.select("sprint_id", F.lit(_PRIOR_CONF).cast("bigint").alias("conf_seq"))).groupBy("sprint_id").agg(F.max("conf_seq").alias("conf_seq"))
    if prior is not None:
        moves = moves.unionByName(prior.select("sprint_id", "item_id", F.lit("added").alias("type"), F.lit(_PRIOR_ADD).cast("bigint").alias("seq")))
    dropped = moves.filter("type = 'removed'").groupBy("sprint_id", "item_id").agg(F.max("seq").alias("drop_seq"))
    limits = moves.select("sprint_id", "item_id").distinct().join(conf, "sprint_id").join(dropped, ["sprint_id", "item_id"], "left")
    limits = limits.select("sprint_id", "item_id", F.greatest("conf_seq", F.coalesce("drop_seq", F.lit(_FIRST))).alias("limit_seq"))
    added = moves.filter("type = 'added'").join(limits, ["sprint_id", "item_id"]).filter("seq > limit_seq")
    return added.groupBy("sprint_id", "item_id").agg(F.min("seq").alias("start_seq"))


def item_state(events: DataFrame, prior: DataFrame | None = None, prior_conf: DataFrame | None = None) -> DataFrame:
    """sprint_id, item_id, status and factor of held items; prior has these columns too.

    An item's last status and last scope are the same for every sprint that holds it: they
    count where they come after the sprint's start with the item. So changes become one row
    an item before they meet the sprints."""
    held = membership(events, prior, prior_conf)
    if prior is None:
        held = held.withColumns({"old_status": F.lit("todo"), "old_factor": F.lit(1.0)})
    else:
        old = prior.select("sprint_id", "item_id", F.lit(_PRIOR_ADD).cast("bigint").alias("start_seq"), F.col("status").alias("old_status"), F.col("factor").alias("old_factor"))
        held = held.join(old, ["sprint_id", "item_id", "start_seq"], "left")
    last = lambda c, kind: [F.max(F.when(F.col("type") == kind, F.struct("seq", c))).alias(kind)]
    changes = events.filter("type IN ('status', 'scope')").groupBy("item_id").agg(*last("new_status", "status"), *last("scope_factor", "scope"))
    j = held.join(changes, "item_id", "left")
    status = F.when(F.col("status.seq") > F.col("start_seq"), F.col("status.new_status"))
    factor = F.when(F.col("scope.seq") > F.col("start_seq"), F.col("scope.scope_factor"))
    status, factor = F.coalesce(status, "old_status", F.lit("todo")), F.coalesce(factor, "old_factor", F.lit(1.0))
    return j.select("sprint_id", "item_id", status.alias("status"), F.greatest(F.lit(0.0), factor).alias("factor"))


#: Event numbers of a block; no more events of a day than that are in one window.
BLOCK = 1 << 16


def _scan(steps: DataFrame, by: list[str], order: str) -> DataFrame:
    """by, order, and ``walk``: sum and lowest prefix of all steps (sum, low) of a group from each on.

    Steps combine as (s, l) + (t, m) = (s + t, min(l, s + m)); over running totals that is a
    sum and a minimum."""
    up = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("before", F.sum("sum").over(up) - F.col("sum"))
    total, low = F.sum("sum").over(down), F.min(F.col("before") + F.col("low")).over(down) - F.col("before")
    return steps.select(*by, order, F.struct(total.alias("sum"), low.alias("low")).alias("walk"))


def _then(first: Column, second: Column) -> Column:
    """The walk of two walks in turn; either may be null."""
    both = F.struct((first["sum"] + second["sum"]).alias("sum"), F.least(first["low"], first["sum"] + second["low"]).alias("low"))
    return F.when(first.isNull(), second).when(second.isNull(), first).otherwise(both)


def capacity(events: DataFrame, prior: DataFrame | None = None, prior_conf: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """sprint_id, day and available hours after all deltas, clamped at 0 at each step.

    The walk x = max(0, x + delta) from x0 has the closed form S + max(x0, -L), with S the sum
    and L the lowest running sum of the deltas since the sprint was configured. Both come
    from a scan on two levels: from each delta to the end of its block of ``block`` event
    numbers, and from each block of a day to the day's end. A sprint looks up the first delta
    after its configuration inside its block and the first block after it. So a day that
    holds all events spreads over as many groups as it has blocks, and the work is deltas plus
    results, never deltas times sprints. prior (sprint_id, day, available) is where days of
    sprints in prior_conf start from, else 8."""
    conf = configured(events).select("sprint_id", "conf_seq", F.lit(False).alias("kept"))
    if prior_conf is not None:
        old = prior_conf.select("sprint_id").join(conf, "sprint_id", "left_anti")
        conf = conf.unionByName(old.select("sprint_id", F.lit(_PRIOR_CONF).cast("bigint").alias("conf_seq"), F.lit(True).alias("kept")))
    of_block = lambda c: F.floor(F.col(c) / block).alias("block")
    steps = events.filter("type = 'availability'").select("day", of_block("seq"), "seq", F.col("delta").alias("sum"), F.col("delta").alias("low"))
    inside = _scan(steps, ["day", "block"], "seq")
    # a block's own walk is that of its first step
    blocks = inside.groupBy("day", "block").agg(F.min_by("walk", "seq").alias("w")).select("day", "block", "w.sum", "w.low")
    later = _scan(blocks, ["day"], "block")

    # the days of all deltas: one array, at most as long as the calendar
    days = events.filter("type = 'availability'").agg(F.collect_set("day").alias("days")).scalar()
    asked = conf.select("sprint_id", "kept", F.explode(days).alias("day"), F.col("conf_seq").alias("seq"), of_block("conf_seq"))
    ahead = _next(inside, asked.filter("seq >= 0").select("day", "block", "seq").distinct(), ["day", "block"], "seq").withColumnRenamed("walk", "near")
    behind = _next(later, asked.select("day", "block").distinct(), ["day"], "block").withColumnRenamed("walk", "far")
    met = asked.join(ahead, ["day", "block", "seq"], "left").join(behind, ["day", "block"], "left")
    met = met.withColumn("walk", _then(F.col("near"), F.col("far"))).filter("walk IS NOT NULL")
    start = F.lit(DEFAULT_CAPACITY)
    if prior is not None:
        met = met.join(prior.select("sprint_id", "day", "available"), ["sprint_id", "day"], "left")
        start = F.when(F.col("kept"), F.coalesce("available", start)).otherwise(start)
    new = met.select("sprint_id", "day", F.round(F.col("walk.sum") + F.greatest(start, -F.col("walk.low")), 4).alias("available"))
    if prior is None:
        return new
    still = prior.join(conf.filter("kept").select("sprint_id"), "sprint_id", "left_semi").join(new, ["sprint_id", "day"], "left_anti")
    return new.unionByName(still.select("sprint_id", "day", "available"))


def _next(walks: DataFrame, asked: DataFrame, by: list[str], order: str) -> DataFrame:
    """asked (by, order; distinct) with the walk of the first step of its group behind it; null if there is none."""
    none = F.lit(None).cast(walks.schema["walk"].dataType).alias("walk")
    both = walks.withColumn("asks", F.lit(False)).unionByName(asked.select(*by, order, none, F.lit(True).alias("asks")))
    # at an equal place the step itself isn't behind: asked rows come first going down
    down = Window.partitionBy(*by).orderBy(F.desc(order), F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("walk", F.when(F.col("asks"), F.last("walk", ignorenulls=True).over(down))).filter("asks").select(*by, order, "walk")


def latest_effort(events: DataFrame) -> DataFrame:
    """item_id and payload of each item's last valid estimate (events with seq, item_id, payload)."""
    ok = events.filter("payload.type IN ('quantiles', 'gmm')")
    return ok.groupBy("item_id").agg(F.max_by("payload", "seq").alias("payload"), F.max("seq").alias("seq"))


def calendar(conf: DataFrame, caps: DataFrame, length: int = 10, working: tuple[int, ...] = (0, 1, 2, 3, 4)) -> DataFrame:
    """sprint_id, day_index (from 1), day, is_working and cap: declared, else 8 on working days.

    conf's length_days and working_days count where it has them and they aren't null."""
    own_length = F.coalesce("length_days", F.lit(length)) if "length_days" in conf.columns else F.lit(length)
    own_working = F.coalesce("working_days", F.array(*map(F.lit, working))) if "working_days" in conf.columns else F.array(*map(F.lit, working))
    steps = F.when(own_length > 0, F.sequence(F.lit(0), own_length - 1))
    days = conf.select("sprint_id", own_working.alias("working"), F.posexplode(F.transform(steps, lambda i: F.date_add("start_day", i))).alias("i", "day"))
    days = days.select("sprint_id", (F.col("i") + 1).alias("day_index"), "day", F.array_contains("working", F.weekday("day")).alias("is_working"))
    j = days.join(caps, ["sprint_id", "day"], "left")
    cap = F.greatest(F.lit(0.0), F.coalesce("available", F.when(F.col("is_working"), F.lit(DEFAULT_CAPACITY)).otherwise(0.0)))
    return j.select("sprint_id", "day_index", "day", "is_working", cap.alias("cap"))


def time_off(caps: DataFrame, delta: float, hit: Column) -> DataFrame:
    """Declared capacities with delta added on the days that hit holds for, at least 0; undeclared days keep their default."""
    return caps.withColumn("available", F.when(hit, F.greatest(F.lit(0.0), F.col("available") + delta)).otherwise(F.col("available")))


def on_days(days: list) -> Column:
    """The condition of time_off for a list of dates."""
    return F.col("day").isin(*[F.lit(d).cast("date") for d in days])


def scope_growth(items: DataFrame, factor: float) -> DataFrame:
    return items.withColumn("factor", F.when(F.col("status") != "done", F.col("factor") * factor).otherwise(F.col("factor")))
