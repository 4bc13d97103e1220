"""Monte-Carlo sprint forecasts as a join of simulations with items and days.

A draw is keyed by seed, stream, entity and simulation, so results don't depend on the
plan, and scenarios share draws. A simulation is done on the first working day by which
the running sum of its daily throughput reaches its total effort.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dist as D
from ..functions.rng import normal, uniform
from . import sprints as P

DEFAULT_THROUGHPUT = tuple(float(x) for x in range(1, 11))


def bootstrap(samples: tuple[float, ...], *key) -> Column:
    """A draw from the samples, of which there are a few; simulate takes tables of any length."""
    return F.element_at(F.array(*[F.lit(float(x)) for x in samples]), (F.floor(uniform(*key) * len(samples)) + 1).cast("int"))


@dataclass(frozen=True)
class LogNormal:
    """A throughput prior: scale is the median, sigma the deviation of the logarithm."""

    scale: float
    sigma: float


def fitted_throughput(samples: DataFrame) -> LogNormal:
    """The lognormal of most likelihood for samples x, of which there is at least one; values count as 1e-9 at least."""
    x = F.log(F.greatest(F.lit(1e-9), F.col("x")))
    row = samples.agg(F.exp(F.avg(x)).alias("scale"), F.stddev_pop(x).alias("sigma")).first()
    return LogNormal(row["scale"], row["sigma"])


Prior = tuple[float, ...] | DataFrame | LogNormal


def _drawn(days: DataFrame, samples: Prior, *key) -> DataFrame:
    """days with a draw in ``daily``: from a lognormal, or a bootstrap from samples, which may be a table with a column x.

    A table is numbered in the order of x, and draws meet their numbers in a join."""
    if isinstance(samples, LogNormal):
        return days.withColumn("daily", lognormal(F.log(F.lit(samples.scale)), F.lit(samples.sigma), *key))
    if not isinstance(samples, DataFrame):
        return days.withColumn("daily", bootstrap(samples, *key))
    n = samples.count()
    if not n:
        return days.withColumn("daily", bootstrap(DEFAULT_THROUGHPUT, *key))
    numbered = samples.select((F.row_number().over(Window.orderBy("x")) - 1).cast("bigint").alias("k"), F.col("x").alias("daily"))
    return days.withColumn("k", F.floor(uniform(*key) * n)).join(numbered, "k").drop("k")


def lognormal(mu: Column, sigma: Column, *key) -> Column:
    return F.exp(mu + sigma * normal(*key))


def simulate(items: DataFrame, calendar: DataFrame, samples: Prior, n_sims: int, seed: int, effort: Column, by: list[str]) -> DataFrame:
    """by, sim, total, done_day (null: not done) and remaining of each simulation.

    items: by, item_id, status, factor and what effort uses, ``sim`` included. calendar: by,
    day_index, is_working, cap. Draws don't depend on by beyond the entities' own keys."""
    sims = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_sims - 1).cast("bigint")))
    open_items = items.filter("status <> 'done'").withColumn("sim", sims)
    total = open_items.groupBy(*by, "sim").agg(F.sum(F.round(effort * F.greatest(F.lit(0.0), F.col("factor")) * 10000).cast("bigint")).alias("total"))
    days = calendar.filter("is_working AND cap > 0").withColumn("sim", sims)
    days = _drawn(days, samples, seed, "throughput", F.col("day_index"), F.col("sim"))
    days = days.withColumn("daily", F.round(F.least("daily", "cap") * 10000).cast("bigint"))
    w = Window.partitionBy(*by, "sim").orderBy("day_index").rowsBetween(Window.unboundedPreceding, 0)
    cum = days.select(*by, "sim", "day_index", "daily", F.sum("daily").over(w).alias("cum"))
    j = total.join(cum, [*by, "sim"], "left")
    done = F.min(F.when(F.col("cum") >= F.col("total"), F.col("day_index")))
    left = F.greatest(F.lit(0), F.col("total") - F.coalesce(F.max("cum"), F.lit(0)))
    return j.groupBy(*by, "sim", "total").agg(done.alias("done_day"), left.alias("remaining"))


def summarise(sims: DataFrame, by: list[str], length: int) -> DataFrame:
    """Completion probabilities by the end and by day, remaining effort and completion day quantiles."""
    by_day = [F.round(F.avg(F.when(F.col("done_day") <= d, 1.0).otherwise(0.0)), 6).alias(f"p_day_{d}") for d in range(1, length + 1)]
    q = F.percentile(F.col("remaining") / 10000, F.array(F.lit(0.5), F.lit(0.9)))
    day = F.percentile("done_day", F.array(F.lit(0.5), F.lit(0.9)))
    df = sims.groupBy(*by).agg(F.round(F.avg(F.when(F.col("done_day").isNotNull(), 1.0).otherwise(0.0)), 6).alias("p_end"), *by_day, q.alias("q"), day.alias("dq"))
    return df.select(
        *by, "p_end", *[f"p_day_{d}" for d in range(1, length + 1)],
        F.round(F.col("q")[0], 6).alias("remaining_p50"), F.round(F.col("q")[1], 6).alias("remaining_p90"), F.floor(F.col("dq")[0]).cast("int").alias("day_p50"), F.floor(F.col("dq")[1]).cast("int").alias("day_p90"),
    )


#: What a scenario does to items and to capacities, by its name.
Scenario = tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]
BASELINE: dict[str, Scenario] = {"baseline": (lambda items: items, lambda caps: caps)}


def sprint_forecasts(items: DataFrame, conf: DataFrame, caps: DataFrame, samples: Prior, n_sims: int, seed: int, scenarios: dict[str, Scenario] | None = None, length: int = 10) -> DataFrame:
    """The forecast of each sprint in each scenario; scenarios that are given take the baseline's place.

    Items carry ``effort``, a payload of quantiles or of a mixture; others are drawn from a
    lognormal(0, 1). Sprints have their own length and working days. p_by_day has a value a
    day of the sprint. A sprint without open items is complete on day 1."""
    scenarios = scenarios or BASELINE
    own = F.coalesce("length_days", F.lit(length)) if "length_days" in conf.columns else F.lit(length)
    longest = conf.agg(F.max(own)).first()[0] or length

    def union(parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, [p.withColumn("scenario", F.lit(n)) for n, p in zip(scenarios, parts, strict=True)])

    all_items = union([f(items) for f, _ in scenarios.values()])
    days = union([P.calendar(conf, g(caps), length) for _, g in scenarios.values()])
    effort, key = F.col("effort"), (seed, "effort", F.col("item_id"), F.col("sim"))
    draw = F.when(F.coalesce(D.payload_valid(effort), F.lit(False)), D.payload_sample(effort, *key)).otherwise(lognormal(F.lit(0.0), F.lit(1.0), *key))
    by = ["scenario", "sprint_id"]
    found = summarise(simulate(all_items, days, samples, n_sims, seed, F.greatest(F.lit(0.0), draw), by), by, longest)
    all_days = F.array(*[F.coalesce(f"p_day_{k}", F.lit(1.0)) for k in range(1, longest + 1)])
    sprints = union([conf.select("sprint_id", own.alias("own"))] * len(scenarios))
    done = F.col("p_end").isNull()
    return sprints.join(found, by, "left").select(
        *by, F.coalesce("p_end", F.lit(1.0)).alias("p_end"), F.slice(all_days, 1, F.greatest(F.lit(0), F.col("own"))).alias("p_by_day"), F.coalesce("remaining_p50", F.lit(0.0)).alias("remaining_p50"), F.coalesce("remaining_p90", F.lit(0.0)).alias("remaining_p90"),
        F.when(done, 1).otherwise(F.col("day_p50")).alias("day_p50"), F.when(done, 1).otherwise(F.col("day_p90")).alias("day_p90"),
    )
