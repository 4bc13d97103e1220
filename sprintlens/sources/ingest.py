"""Pull requests, milestones and estimates from REST services into keyed tables, and out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import parse_iso
from ..operators import history as H
from . import rest
from .paged import followed
from .sinks import KeyedTable
from .storage import shared_dir

PULLS = (
    "repo string, number int, pr_id bigint, state string, title string, author_login string, created_at string, updated_at string, closed_at string, merged_at string,"
    " additions int, deletions int, changed_files int, comments int, review_comments int, commits_count int"
)
COMMITS = "repo string, pr_number int, sha string"
REVIEWS = "repo string, pr_number int, review_id bigint, author_login string, state string, submitted_at string"
MILESTONES = "repo string, milestone_id int, title string, start_date date, end_date date, raw_json string"
ISSUES = "repo string, issue_number int, estimate_value double, pipeline_name string, is_epic boolean, raw_json string"

_DETAIL = (
    "number int, id bigint, state string, title string, user struct<login:string>, created_at string, updated_at string, closed_at string, merged_at string,"
    " additions int, deletions int, changed_files int, comments int, review_comments int, commits int"
)
_ESTIMATE = "estimate struct<value:double>, pipeline struct<name:string>, is_epic boolean"


class Store:
    """The ingested tables under a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.pulls = KeyedTable(spark, f"{path}/pull_requests", PULLS, ["repo", "number"])
        self.commits = KeyedTable(spark, f"{path}/pr_commits", COMMITS, ["repo", "pr_number", "sha"])
        self.reviews = KeyedTable(spark, f"{path}/pr_reviews", REVIEWS, ["repo", "pr_number", "review_id"])
        self.milestones = KeyedTable(spark, f"{path}/milestones", MILESTONES, ["repo", "milestone_id"])
        self.issues = KeyedTable(spark, f"{path}/issues", ISSUES, ["repo", "issue_number"])


def _asked(df: DataFrame, key: Column, url: Column, params: Column | None = None) -> DataFrame:
    """Requests dealt over all cores: few rows, but each waits for an answer."""
    none = F.create_map().cast("map<string,string>")
    rows = df.select(key.alias("key"), url.alias("url"), (none if params is None else params).alias("params"))
    return rows.repartition(df.sparkSession.sparkContext.defaultParallelism, "url")


def _split(key: str = "key") -> list[Column]:
    """repo and number of a key repo#number."""
    return [F.substring_index(key, "#", 1).alias("repo"), F.substring_index(key, "#", -1).cast("int").alias("pr_number")]


def ingest_pulls(store: Store, repos: list[str], transport: rest.Transport, since: str = "", reviews: bool = True, base: str = "") -> int:
    """Brings the PRs updated since up to date, with their commits and reviews; returns how many there were."""
    return _bring(store, rest.pull_list(store.spark, repos, transport, since, base), transport, reviews, base)


def follow_pulls(store: Store, repos: list[str], transport: rest.Transport, root: str, since: str = "", reviews: bool = True, base: str = "", **trigger) -> None:
    """The same as a stream with its checkpoint under root: each trigger brings what was updated since the last one.

    A trigger that is repeated brings the same PRs again, which changes nothing."""
    lists = [(r, f"{base}/repos/{r}/pulls", {"state": "all", "sort": "updated", "direction": "desc"}) for r in repos]

    def bring(rows: DataFrame, _: int) -> None:
        _bring(store, rows.select(F.col("key").alias("repo"), F.get_json_object("body", "$.number").cast("int").alias("number")), transport, reviews, base)

    stream = followed(store.spark, lists, transport, since)
    stream.writeStream.foreachBatch(bring).option("checkpointLocation", f"{root}/offsets").trigger(**(trigger or {"availableNow": True})).start().awaitTermination()


def _bring(store: Store, listed: DataFrame, transport: rest.Transport, reviews: bool, base: str) -> int:
    """Reads the listed PRs (repo, number) and what belongs to them into the store.

    Answers are written once before they are used, so that no request is made twice."""
    spark = store.spark
    at = shared_dir(spark, "pulls")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{at}/{name}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    listed = kept(listed.select("repo", "number").distinct(), "listed")
    key = F.concat_ws("#", "repo", "number")
    url = F.concat(F.lit(f"{base}/repos/"), "repo", F.lit("/pulls/"), F.col("number").cast("string"))
    got = kept(rest.documents(_asked(listed, key, url), transport), "details")
    p = got.select(F.substring_index("key", "#", 1).alias("repo"), F.from_json("body", _DETAIL).alias("p")).select("repo", "p.*")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("additions", "deletions", "changed_files", "comments", "review_comments")]
    store.pulls.upsert(
        p.select("repo", "number", F.coalesce("id", F.lit(0)).alias("pr_id"), "state", "title", F.col("user.login").alias("author_login"), "created_at", "updated_at", "closed_at", "merged_at", *zero, F.coalesce("commits", F.lit(0)).alias("commits_count"))
    )
    got = kept(rest.resources(_asked(listed, key, F.concat(url, F.lit("/commits"))), transport), "commits")
    shas = got.select(*_split(), F.trim(F.get_json_object("body", "$.sha")).alias("sha"))
    store.commits.insert_ignore(shas.filter("sha <> ''"))
    if reviews:
        got = kept(rest.resources(_asked(listed, key, F.concat(url, F.lit("/reviews"))), transport), "reviews")
        r = got.select(*_split(), F.from_json("body", "id bigint, user struct<login:string>, state string, submitted_at string").alias("r"))
        store.reviews.upsert(r.select("repo", "pr_number", F.col("r.id").alias("review_id"), F.col("r.user.login").alias("author_login"), "r.state", "r.submitted_at").filter("review_id <> 0"))
    return listed.count()


def stored_prs(store: Store) -> DataFrame:
    """The PRs of the store as ``files.pull_requests`` has those of a file; CI runs are not ingested."""
    prs = store.pulls.read().withColumn("created_at", F.nullif("created_at", F.lit("")))
    commits, reviews = (t.read().withColumnRenamed("pr_number", "number") for t in (store.commits, store.reviews))
    df = H.assembled_prs(prs, commits, reviews, ["repo", "number"])
    own = F.coalesce(F.nullif(F.col("pr_id"), F.lit(0)).cast("string"), F.concat_ws("#", "repo", "number"))
    return df.select(
        own.alias("pr_id"), "repo", F.coalesce("author_login", F.lit("")).alias("author_id"), parse_iso(F.col("created_at")).alias("opened_at"), parse_iso(F.col("merged_at")).alias("merged_at"), "commits",
        F.col("review_rounds").cast("int").alias("review_rounds"), F.coalesce("review_comments", F.lit(0)).alias("review_comments"), F.lit(0).alias("ci_runs"), F.lit(0).alias("ci_failures"),
        F.create_map(F.lit("pr_number"), F.col("number").cast("string")).alias("metadata"),
    )


def ingest_backlog(store: Store, repos: list[str], hosting: rest.Transport, tracker: rest.Transport, prefix: str = "", days: int = 10, base: str = "", tracker_base: str = "") -> DataFrame:
    """Stores each repository's current milestone and its issues' estimates; returns the sprints' issues.

    Columns: sprint_id, repo, start_date, end_date, length_days, issue_number (null for a
    sprint without issues). Issues that are PRs don't count. An issue that the tracker
    doesn't answer for has no estimate."""
    spark = store.spark
    at = shared_dir(spark, "backlog")
    ids = spark.createDataFrame([(r, rest.repo_id(hosting, r, base)) for r in repos], "repo string, repo_id bigint")
    m = rest.current_milestones(spark, repos, hosting, prefix, days, base)
    m.write.parquet(f"{at}/milestones")
    m = spark.read.schema(m.schema).parquet(f"{at}/milestones")
    store.milestones.upsert(m)
    asked = _asked(m, F.col("sprint_id"), F.concat(F.lit(f"{base}/repos/"), "repo", F.lit("/issues")), F.create_map(F.lit("milestone"), F.col("milestone_id").cast("string"), F.lit("state"), F.lit("all")))
    got = rest.resources(asked, hosting)
    issues = got.filter(F.get_json_object("body", "$.pull_request").isNull()).select(F.col("key").alias("sprint_id"), F.get_json_object("body", "$.number").cast("int").alias("issue_number")).distinct()
    issues.write.parquet(f"{at}/issues")
    issues = spark.read.schema(issues.schema).parquet(f"{at}/issues")
    own = issues.join(m.select("sprint_id", "repo"), "sprint_id").join(ids, "repo")
    url = F.concat(F.lit(f"{tracker_base}/p1/repositories/"), F.col("repo_id").cast("string"), F.lit("/issues/"), F.col("issue_number").cast("string"))
    got = rest.documents(_asked(own, F.concat_ws("#", "repo", "issue_number"), url), tracker, lenient=True)
    e = got.select(*_split(), F.from_json("body", _ESTIMATE).alias("e"), "body")
    store.issues.upsert(e.select("repo", F.col("pr_number").alias("issue_number"), F.col("e.estimate.value").alias("estimate_value"), F.col("e.pipeline.name").alias("pipeline_name"), F.coalesce("e.is_epic", F.lit(False)).alias("is_epic"), F.col("body").alias("raw_json")))
    return m.select("sprint_id", "repo", "start_date", "end_date", "length_days").join(issues, "sprint_id", "left")
