"""Change history: upserts, caps, pairs, activity, pull-request joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import clipped, minute


def last_write_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last in the order. An aggregate, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, "__row.*")


def first_write_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, "__row.*")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base with changes written over rows of equal keys."""
    marked = base.withColumn("__at", F.lit(0)).unionByName(changes.withColumn("__at", F.lit(1)))
    rest = [c for c in base.columns if c not in keys]
    return last_write_wins(marked, keys, ["__at", *rest]).select(*base.columns)


def insert_ignore(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base and the rows of changes whose keys it lacks, first of each key."""
    rest = [c for c in base.columns if c not in keys]
    new = first_write_wins(changes.join(base, keys, "left_anti").select(*base.columns), keys, rest)
    return base.unionByName(new.select(*base.columns))


def newest(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The last n rows of each group; the rank limit is pushed into the sort."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= n).drop("__k")


def commit_pairs(commits: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each commit with its author's previous one, gap in minutes and the clipped label in hours; carry: its own columns to keep."""
    w = Window.partitionBy("author_id").orderBy("authored_at", "commit_id")
    at = minute(F.col("authored_at"))
    df = commits.select("author_id", "commit_id", F.lag("commit_id").over(w).alias("parent_id"), F.lag(at).over(w).alias("parent_minute"), at.alias("child_minute"), *carry)
    gap = F.col("child_minute") - F.col("parent_minute")
    return df.filter("parent_id IS NOT NULL").select("author_id", "parent_id", "commit_id", "parent_minute", "child_minute", gap.alias("gap_minutes"), F.round(clipped(gap / 60), 6).alias("label_hours"), *carry)


def activity(commits: DataFrame, min_minutes: int = 50) -> DataFrame:
    """Per author: commits, distinct minutes, first and last minute, pairs, and whether a curve can be fitted."""
    at = minute(F.col("authored_at"))
    return commits.groupBy("author_id").agg(
        F.count(F.lit(1)).alias("n_commits"),
        F.count_distinct(at).alias("n_minutes"),
        F.min(at).alias("first_minute"),
        F.max(at).alias("last_minute"),
        F.greatest(F.lit(0), F.count(F.lit(1)) - 1).cast("bigint").alias("n_pairs"),
        (F.count_distinct(at) >= min_minutes).alias("active"),
    )


def pr_metrics_by_sha(prs: DataFrame, pr_commits: DataFrame, reviews: DataFrame) -> DataFrame:
    """For each commit the merged PR that merged last, with its review count."""
    merged = prs.filter("merged_at IS NOT NULL").join(reviews, "number", "left").withColumn("reviews", F.coalesce("reviews", F.lit(0)))
    joined = merged.join(pr_commits, "number").select("sha", "number", "merged_at", "created_at", "reviews")
    best = F.max_by(F.struct("number", "merged_at", "created_at", "reviews"), F.struct("merged_at", (-F.col("number")).alias("n")))
    return joined.groupBy("sha").agg(best.alias("p")).select("sha", "p.*")


def assembled_prs(prs: DataFrame, pr_commits: DataFrame, reviews: DataFrame, keys: list[str] = ("number",)) -> DataFrame:
    """prs (keys, created_at, ..) that have a creation time, with review_rounds and commits.

    Both sides are aggregated to a row a PR before they are joined."""
    keys = list(keys)
    counts = reviews.groupBy(*keys).agg(F.count(F.lit(1)).alias("review_rounds"))
    lists = pr_commits.select(*keys, "sha").distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("sha")).alias("commits"))
    df = prs.filter("created_at IS NOT NULL").join(counts, keys, "left").join(lists, keys, "left")
    return df.withColumns({"review_rounds": F.coalesce("review_rounds", F.lit(0)), "commits": F.coalesce("commits", F.array().cast(lists.schema["commits"].dataType))})
