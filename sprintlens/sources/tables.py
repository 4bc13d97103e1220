"""Domain tables derived from the benchmark tables.

commits <- events, file paths <- part, pull requests <- orders, PR commits, reviews and
checks <- lineitem, domain events of sprints <- events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".py", ".java", ".js", ".ts", ".md")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work on single rows: dealt by the rows' places if its files give fewer tasks than there are cores.

    A place follows from the files alone, so a repeated task reads the same rows, and no
    value that many rows share, nulls included, gathers them in one task."""
    df = table(spark, sf_dir, name)
    n = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= n:
        return df
    return df.withColumn("__place", F.monotonically_increasing_id()).repartition(n, "__place").drop("__place")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit_id, author_id, authored_at, kind, value of every event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("commit_id"), F.col("user_id").alias("author_id"), F.col("ts").alias("authored_at"), F.col("event_type").alias("kind"), "value"
    )


#: Files of a change.
FILES = 8


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, change (FILES parts in a row), brand, type and a file path whose suffix follows from the size."""
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), F.col("p_size") % 5 + 1)
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.floor(F.col("p_partkey") / FILES).alias("change"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.concat("p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), suffix).alias("path")
    )


def merge_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("number")).agg(F.max("l_shipdate").alias("merged_at"))


def pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """number, author_id, created_at, merged_at (null while status is O or without lines)."""
    prs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("number"), F.col("o_custkey").alias("author_id"), F.col("o_orderdate").alias("created_at"), "o_orderstatus")
    merged = F.when(F.col("o_orderstatus") != "O", F.col("merged_at"))
    return prs.join(merge_times(spark, sf_dir), "number", "left").select("number", "author_id", "created_at", merged.alias("merged_at"))


def pr_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("number"), F.col("l_partkey").alias("sha")).distinct()


def pr_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """number, review_rounds, review_comments and ci_failures of PRs that have any lines."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("number"))
        .agg(
            F.count_if(F.col("l_returnflag") == "R").alias("review_rounds"),
            F.sum("l_linenumber").cast("bigint").alias("review_comments"),
            F.count_if(F.col("l_linestatus") == "F").alias("ci_failures"),
        )
    )


def sprint_day(ts: Column) -> Column:
    return ts.cast("date")


def domain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_domain_events(table(spark, sf_dir, "events"))


def as_domain_events(events: DataFrame) -> DataFrame:
    """seq, type, sprint_id, item_id, day, delta, new_status, scope_factor, payload of every event."""
    k = F.col("event_id") % 100
    kind = (
        F.when(k <= 1, "configured").when(k <= 39, "added").when(k <= 49, "removed").when(k <= 74, "status").when(k <= 84, "scope").otherwise("availability")
    )
    status = F.element_at(F.array(F.lit("todo"), F.lit("in_progress"), F.lit("done")), (F.col("event_id") % 3 + 1).cast("int"))
    return events.select(
        F.col("event_id").alias("seq"),
        kind.alias("type"),
        (F.col("user_id") % 10).alias("sprint_id"),
        (F.col("event_id") % 53).alias("item_id"),
        sprint_day(F.col("ts")).alias("day"),
        F.round(F.col("value") - 20, 2).alias("delta"),
        status.alias("new_status"),
        F.round(F.col("value") / 10 - 1, 3).alias("scope_factor"),
        "value",
    )
