"""JSON sources: pull requests, sprint inputs, throughput history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import lognormal_quantiles, parse_iso
from ..operators.forecast import DEFAULT_THROUGHPUT
from . import schemas


def pull_requests(spark: SparkSession, path: str) -> DataFrame:
    """PRs of a JSON array; counts default to 0, lists to empty, rows without id or opening time go."""
    df = spark.read.schema(schemas.PULL_REQUESTS).option("multiLine", True).json(path)
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("review_rounds", "review_comments", "ci_runs", "ci_failures")}
    times = {c: parse_iso(F.col(c)) for c in ("opened_at", "merged_at")}
    df = df.withColumns({**zero, **times, "commits": F.coalesce("commits", F.array().cast("array<string>"))})
    return df.filter("pr_id IS NOT NULL AND opened_at IS NOT NULL")


def pr_by_commit(prs: DataFrame) -> DataFrame:
    """sha and its PR; of several PRs with the commit the last by opening time and id wins."""
    rows = prs.select(F.explode("commits").alias("sha"), F.struct("opened_at", "pr_id", "merged_at", "review_rounds", "review_comments", "ci_failures").alias("p"))
    return rows.groupBy("sha").agg(F.max_by("p", F.struct("p.opened_at", "p.pr_id")).alias("p")).select("sha", "p.*")


def points_effort(points: Column, hours: float, cv: float) -> Column:
    """The effort payload of story points: quantiles of a lognormal; without points one counts."""
    q = lognormal_quantiles(F.greatest(F.lit(1e-6), F.coalesce(points.cast("double"), F.lit(1.0))) * hours, cv)
    pairs = [x for k, v in zip(("0.5", "0.8", "0.9"), q, strict=True) for x in (F.lit(k), v)]
    none, numbers = F.lit(None).cast("double"), F.lit(None).cast("array<double>")
    return F.struct(F.lit("quantiles").alias("type"), F.create_map(*pairs).alias("quantiles"), numbers.alias("weights"), numbers.alias("means"), numbers.alias("stds"), none.alias("low"), none.alias("high"))


def sprint_inputs(spark: SparkSession, path: str, hours: float = 4.0, cv: float = 0.6) -> dict[str, DataFrame]:
    """conf, caps and items of a sprint file: deltas start from 8 hours a day and stay at 0 or above.

    An item's effort is its payload (quantiles or a mixture), else that of its story points."""
    df = spark.read.schema(schemas.SPRINT_INPUTS).option("multiLine", True).json(path)
    conf = df.select("sprint.sprint_id", F.col("sprint.start_date").alias("start_day"), "sprint.length_days", "sprint.working_days")
    deltas = df.select("sprint.sprint_id", F.posexplode("capacity").alias("seq", "c")).select("sprint_id", "seq", "c.day", F.col("c.delta_available_sch").alias("delta"))
    w = Window.partitionBy("sprint_id", "day").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    walked = deltas.withColumn("s", F.sum("delta").over(w))
    caps = walked.groupBy("sprint_id", "day").agg((F.max_by("s", "seq") + F.greatest(F.lit(8.0), -F.min("s"))).alias("available"))
    points = F.when(F.col("w.story_points").isNotNull(), points_effort(F.col("w.story_points"), hours, cv))
    items = df.select("sprint.sprint_id", F.explode("work_items").alias("w")).select(
        "sprint_id", F.col("w.work_item_id").alias("item_id"), F.coalesce("w.status", F.lit("todo")).alias("status"), F.greatest(F.lit(0.0), F.coalesce("w.scope_factor", F.lit(1.0))).alias("factor"), F.coalesce("w.effort", points).alias("effort")
    )
    return {"conf": conf, "caps": caps, "items": items}


def throughput_samples(spark: SparkSession, history: str | None = None, samples: str | None = None) -> DataFrame:
    """Daily throughput samples x: all of a sprint history, else of a list of samples, else 1 to 10.

    Under three valid sprints the history is the default."""
    default = spark.createDataFrame([(x,) for x in DEFAULT_THROUGHPUT], "x double")
    if history:
        df = spark.read.schema(schemas.SPRINT_HISTORY).option("multiLine", True).json(history).filter("done_effort_hours > 0 AND workdays > 0")
        df = df.select((F.col("done_effort_hours") / F.col("workdays")).alias("x"))
        return df if df.count() >= 3 else default
    if samples:
        df = spark.read.schema(schemas.THROUGHPUT).option("multiLine", True).json(samples)
        df = df.select(F.explode("throughput_samples_sch_per_day").alias("x"))
        return default if df.isEmpty() else df
    return default
