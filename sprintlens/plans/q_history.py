"""Queries over change history and pull requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import history as H
from ..sources import tables as T

MINUTE = "epoch_us(ts) // 60000000"


def q01(spark: SparkSession, sf: str) -> DataFrame:
    return H.commit_pairs(T.commits(spark, sf))


Q01 = f"""
WITH c AS (SELECT event_id, user_id, ts, {MINUTE} AS m FROM events),
p AS (SELECT user_id AS author_id, event_id AS commit_id, m AS child_minute,
  lag(event_id) OVER w AS parent_id, lag(m) OVER w AS parent_minute FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT author_id, parent_id, commit_id, parent_minute, child_minute, child_minute - parent_minute AS gap_minutes,
  round(least(greatest((child_minute - parent_minute) / 60.0::DOUBLE, 0.0), 1.0), 6) AS label_hours FROM p WHERE parent_id IS NOT NULL"""


def q02(spark, sf):
    return H.activity(T.commits(spark, sf))


Q02 = f"""
SELECT user_id AS author_id, count(*) AS n_commits, count(DISTINCT {MINUTE}) AS n_minutes, min({MINUTE}) AS first_minute, max({MINUTE}) AS last_minute,
  greatest(0, count(*) - 1)::BIGINT AS n_pairs, count(DISTINCT {MINUTE}) >= 50 AS active FROM events GROUP BY user_id"""

INCLUDE, EXCLUDE = ["re:^(asia|europe)/", " NATION_1"], ["re:7$", "nation_18/"]


def q03(spark, sf):
    s, n, r = (T.table(spark, sf, x) for x in ("supplier", "nation", "region"))
    df = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    df = df.select("s_suppkey", F.concat_ws("/", "r_name", "n_name", "s_name").alias("repo"))
    return df.filter(S.matches(F.col("repo"), [p.strip() for p in INCLUDE], EXCLUDE))


Q03 = """
SELECT s_suppkey, r_name || '/' || n_name || '/' || s_name AS repo
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE (regexp_matches(lower(r_name || '/' || n_name || '/' || s_name), '^(asia|europe)/') OR contains(lower(r_name || '/' || n_name || '/' || s_name), 'nation_1'))
  AND NOT (regexp_matches(lower(r_name || '/' || n_name || '/' || s_name), '7$') OR contains(lower(r_name || '/' || n_name || '/' || s_name), 'nation_18/'))"""


def q04(spark, sf):
    """The language of each change by its files."""
    g = T.paths(spark, sf).groupBy("change").agg(F.array_sort(F.collect_set("path")).alias("files"))
    return g.select("change", F.size("files").cast("bigint").alias("n_files"), S.language(F.col("files")).alias("language"), S.first_file_language(F.col("files")).alias("first_language"))


PATH = "p_brand || '/' || replace(p_name, ' ', '_') || (['.py', '.java', '.js', '.ts', '.md'])[p_size % 5 + 1]"
Q04 = f"""
WITH g AS (SELECT p_partkey // {T.FILES} AS change, list_sort(list(DISTINCT {PATH})) AS files FROM part GROUP BY ALL)
SELECT change, len(files)::BIGINT AS n_files,
  CASE WHEN len(list_filter(files, lambda f: ends_with(lower(f), '.py'))) > 0 THEN 'python' WHEN len(list_filter(files, lambda f: ends_with(lower(f), '.java'))) > 0 THEN 'java'
    WHEN len(list_filter(files, lambda f: ends_with(lower(f), '.js') OR ends_with(lower(f), '.ts'))) > 0 THEN 'javascript' ELSE 'unknown' END AS language,
  CASE WHEN ends_with(files[1], '.py') THEN 'python' WHEN ends_with(files[1], '.java') THEN 'java' WHEN ends_with(files[1], '.js') THEN 'javascript' ELSE 'unknown' END AS first_language
FROM g"""


def q05(spark, sf):
    """The events of even number as a table, those of odd number written over it."""
    e = T.commits(spark, sf).select("kind", "author_id", "commit_id", "value")
    base, changes = (H.last_write_wins(e.filter(F.col("commit_id") % 2 == k), ["kind", "author_id"], ["commit_id"]) for k in (0, 1))
    return H.upsert(base, changes, ["kind", "author_id"])


Q05 = """
WITH b AS (SELECT event_type AS kind, user_id AS author_id, max(event_id) AS commit_id, arg_max(value, event_id) AS value, event_id % 2 AS side
  FROM events GROUP BY event_type, user_id, event_id % 2)
SELECT kind, author_id, arg_max(commit_id, side) AS commit_id, arg_max(value, side) AS value FROM b GROUP BY kind, author_id"""


def q06(spark, sf):
    li = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("number"), F.col("l_partkey").alias("sha"), "l_linenumber", "l_suppkey")
    base = H.first_write_wins(li.filter("l_linenumber <= 3"), ["number", "sha"], ["l_linenumber", "l_suppkey"])
    return H.insert_ignore(base, li.filter("l_linenumber > 3"), ["number", "sha"])


Q06 = """
WITH b AS (SELECT l_orderkey AS number, l_partkey AS sha, min(struct_pack(l := l_linenumber, s := l_suppkey)) AS m, l_linenumber > 3 AS late FROM lineitem GROUP BY l_orderkey, l_partkey, l_linenumber > 3)
SELECT number, sha, m.l AS l_linenumber, m.s AS l_suppkey FROM b WHERE NOT late OR NOT EXISTS (SELECT 1 FROM b c WHERE c.number = b.number AND c.sha = b.sha AND NOT c.late)"""


def q07(spark, sf):
    return H.newest(T.commits(spark, sf), "author_id", [F.desc("authored_at"), F.desc("commit_id")], 20).select("author_id", "commit_id", "authored_at")


Q07 = """
SELECT user_id AS author_id, event_id AS commit_id, ts AS authored_at FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20"""


def _reviews(spark, sf):
    return T.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("number")).agg(F.count(F.lit(1)).alias("reviews"))


def q08(spark, sf):
    prs = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("number"))
    return prs.join(_reviews(spark, sf), "number", "left").select("number", F.coalesce("reviews", F.lit(0)).cast("bigint").alias("reviews"))


Q08 = """
SELECT o_orderkey AS number, coalesce(n, 0)::BIGINT AS reviews FROM orders
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""

PRS = """
SELECT o_orderkey AS number, o_custkey AS author_id, o_orderdate AS created_at, CASE WHEN o_orderstatus <> 'O' THEN m END AS merged_at
FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS m FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""


def q09(spark, sf):
    return H.pr_metrics_by_sha(T.pull_requests(spark, sf), T.pr_commits(spark, sf), _reviews(spark, sf))


Q09 = f"""
WITH p AS ({PRS}), r AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey),
j AS (SELECT sha, p.number, merged_at, created_at, coalesce(n, 0)::BIGINT AS reviews FROM p JOIN (SELECT DISTINCT l_orderkey, l_partkey AS sha FROM lineitem) c ON c.l_orderkey = p.number
  LEFT JOIN r ON r.l_orderkey = p.number WHERE merged_at IS NOT NULL)
SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY sha ORDER BY merged_at DESC, number) = 1"""


def q10(spark, sf):
    lists = T.pr_commits(spark, sf).groupBy("number").agg(F.array_sort(F.collect_list("sha")).alias("shas"))
    prs = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("number"))
    return prs.join(lists, "number", "left").select("number", F.coalesce(F.size("shas"), F.lit(0)).cast("bigint").alias("n_commits"), F.coalesce(F.array_join(F.col("shas").cast("array<string>"), ","), F.lit("")).alias("shas"))


Q10 = """
SELECT o_orderkey AS number, coalesce(n, 0)::BIGINT AS n_commits, coalesce(s, '') AS shas FROM orders
LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS n, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS s FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""


def q11(spark, sf):
    prs = T.pull_requests(spark, sf).filter("created_at IS NOT NULL AND merged_at IS NOT NULL")
    return prs.select("number", F.round(S.hours_between(F.col("created_at"), F.col("merged_at")), 4).alias("cycle_hours"))


Q11 = f"""
SELECT number, round(greatest(0.0::DOUBLE, (epoch_us(merged_at) - epoch_us(created_at)) / 3600000000.0::DOUBLE), 4) AS cycle_hours FROM ({PRS}) WHERE merged_at IS NOT NULL"""


def q12(spark, sf):
    """A pair's commit stands for the sha commit_id modulo the number of parts; of a sha's PRs the last number wins."""
    n = T.table(spark, sf, "part").agg(F.count(F.lit(1)).alias("n")).scalar()
    pairs = H.commit_pairs(T.commits(spark, sf)).withColumn("sha", F.col("commit_id") % n)
    act = T.pull_requests(spark, sf).join(T.pr_activity(spark, sf), "number", "left")
    linked = T.pr_commits(spark, sf).join(act, "number")
    cols = ["number", "created_at", "merged_at", "review_rounds", "review_comments", "ci_failures"]
    last = linked.groupBy("sha").agg(F.max_by(F.struct(*cols), F.col("number")).alias("p")).select("sha", "p.*")
    j = pairs.join(last, "sha", "left")
    cycle = S.hours_between(F.col("created_at"), F.col("merged_at"))
    y = F.when(F.col("merged_at").isNull(), F.col("label_hours")).otherwise(S.delivery_label(F.col("label_hours"), cycle, F.col("review_rounds"), F.col("review_comments"), F.col("ci_failures")))
    return j.select("commit_id", F.when(F.col("merged_at").isNotNull(), F.col("number")).alias("number"), F.round("label_hours", 4).alias("y_coding"), F.round(y, 4).alias("y_delivery"))


Q12 = f"""
WITH pairs AS ({Q01}), prs AS ({PRS}),
a AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS rr, sum(l_linenumber)::BIGINT AS rc, count(*) FILTER (l_linestatus = 'F') AS cf FROM lineitem GROUP BY l_orderkey),
k AS (SELECT DISTINCT l_orderkey AS number, l_partkey AS sha FROM lineitem),
l AS (SELECT sha, prs.*, rr, rc, cf FROM k JOIN prs USING (number) LEFT JOIN a ON a.l_orderkey = number QUALIFY row_number() OVER (PARTITION BY sha ORDER BY number DESC) = 1)
SELECT commit_id, CASE WHEN merged_at IS NOT NULL THEN number END AS number, round(label_hours, 4) AS y_coding,
  round(CASE WHEN merged_at IS NULL THEN label_hours ELSE least(1.0::DOUBLE, label_hours + 0.2::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (epoch_us(merged_at) - epoch_us(created_at)) / 3600000000.0::DOUBLE) / 48)
    + 0.05::DOUBLE * rr + 0.01::DOUBLE * rc + 0.02::DOUBLE * cf) END, 4) AS y_delivery
FROM pairs LEFT JOIN l ON sha = commit_id % (SELECT count(*) FROM part)"""


def q41(spark, sf):
    """Throughput prior of each customer's orders: done amount a day; under three valid rows the default 1..10."""
    o = T.table(spark, sf, "orders")
    g = o.groupBy(F.col("o_custkey").alias("team"), F.year("o_orderdate").alias("sprint")).agg(
        F.sum(F.when(F.col("o_orderstatus") == "F", F.floor("o_totalprice")).otherwise(0)).cast("bigint").alias("done"), F.count_distinct(F.col("o_orderdate")).alias("days")
    )
    rate = F.when((F.col("done") > 0) & (F.col("days") > 0), F.round(F.col("done") / F.col("days"), 4))
    per = g.groupBy("team").agg(F.count(rate).alias("valid"), F.round(F.avg(rate), 3).alias("avg_rate"), F.max(rate).alias("max_rate"))
    few = F.col("valid") < 3
    return per.select("team", F.when(few, F.lit(10)).otherwise(F.col("valid")).cast("bigint").alias("n_samples"), F.when(few, F.lit(5.5)).otherwise(F.col("avg_rate")).alias("mean_rate"), F.when(few, F.lit(10.0)).otherwise(F.col("max_rate")).alias("max_rate"))


Q41 = """
WITH g AS (SELECT o_custkey AS team, year(o_orderdate) AS sprint, sum(CASE WHEN o_orderstatus = 'F' THEN floor(o_totalprice)::BIGINT ELSE 0 END)::BIGINT AS done, count(DISTINCT o_orderdate) AS days FROM orders GROUP BY ALL),
r AS (SELECT team, CASE WHEN done > 0 AND days > 0 THEN round(done::DOUBLE / days, 4) END AS rate FROM g),
p AS (SELECT team, count(rate) AS valid, round(avg(rate), 3) AS a, max(rate) AS m FROM r GROUP BY team)
SELECT team, CASE WHEN valid < 3 THEN 10 ELSE valid END::BIGINT AS n_samples, CASE WHEN valid < 3 THEN 5.5::DOUBLE ELSE a END AS mean_rate, CASE WHEN valid < 3 THEN 10.0::DOUBLE ELSE m END AS max_rate FROM p"""


def q42(spark, sf):
    """Per customer the open order due first, with the number of its lines as backlog and part sizes as estimates."""
    o = T.table(spark, sf, "orders").filter(F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("2")).filter("o_orderstatus = 'O'")
    top = H.first_write_wins(o.select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("milestone"), F.col("o_orderdate").alias("due")), ["repo"], ["due", "milestone"])
    items = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("milestone"), F.col("l_partkey").alias("p_partkey")).distinct()
    est = T.table(spark, sf, "part").filter("p_size > 5").select("p_partkey", "p_size")
    j = top.join(items, "milestone", "left").join(est, "p_partkey", "left")
    return j.groupBy("repo", "milestone", "due").agg(
        F.count("p_partkey").alias("n_items"), F.sum(F.when(F.col("p_partkey").isNotNull(), F.coalesce("p_size", F.lit(1)))).cast("bigint").alias("points")
    ).select("repo", "milestone", F.col("due").cast("date").alias("due_on"), F.date_sub(F.col("due").cast("date"), 10).alias("starts_on"), "n_items", F.coalesce("points", F.lit(0)).alias("points"))


Q42 = """
WITH t AS (SELECT o_custkey AS repo, o_orderkey AS milestone, o_orderdate AS due FROM orders WHERE (starts_with(o_orderpriority, '1') OR starts_with(o_orderpriority, '2')) AND o_orderstatus = 'O'
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1),
i AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT repo, milestone, due::DATE AS due_on, (due::DATE - 10)::DATE AS starts_on, count(l_partkey) AS n_items,
  coalesce(sum(CASE WHEN l_partkey IS NOT NULL THEN CASE WHEN p_size > 5 THEN p_size ELSE 1 END END), 0)::BIGINT AS points
FROM t LEFT JOIN i ON l_orderkey = milestone LEFT JOIN part ON p_partkey = l_partkey GROUP BY repo, milestone, due"""


def q44(spark, sf):
    return T.table(spark, sf, "documents").select("lang").distinct()


Q44 = "SELECT DISTINCT lang FROM documents"


def q51(spark, sf):
    """Chronological scan: position of each commit in its kind by time.

    A kind can hold any share of the commits, so places are two-level: counts by day, then rows of a day."""
    from pyspark.sql.window import Window

    rows = T.commits(spark, sf).select("kind", "commit_id", "authored_at", F.to_date("authored_at").alias("day"))
    days = rows.groupBy("kind", "day").agg(F.count(F.lit(1)).alias("n"))
    ahead = days.select("kind", "day", F.coalesce(F.sum("n").over(Window.partitionBy("kind").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("kind", "day").orderBy("authored_at", "commit_id"))
    placed = rows.withColumn("inside", inside).join(ahead, ["kind", "day"]).withColumn("place", (F.col("ahead") + F.col("inside")).cast("bigint"))
    return placed.select("kind", "commit_id", "place", F.floor((F.col("place") - 1) / 8).cast("bigint").alias("chunk"))


Q51 = """
SELECT event_type AS kind, event_id AS commit_id, row_number() OVER w AS place, (row_number() OVER w - 1) // 8 AS chunk FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)"""

def q52(spark, sf):
    li = T.table(spark, sf, "lineitem")
    df = H.assembled_prs(T.pull_requests(spark, sf), T.pr_commits(spark, sf), li.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("number")))
    return df.select("number", "author_id", "created_at", "merged_at", "review_rounds", F.size("commits").cast("bigint").alias("n_commits"), F.coalesce(F.array_max("commits"), F.lit(-1)).alias("last_sha"))


Q52 = f"""
SELECT p.*, coalesce(r, 0)::BIGINT AS review_rounds, coalesce(c, 0)::BIGINT AS n_commits, coalesce(m, -1)::BIGINT AS last_sha FROM ({PRS}) p
LEFT JOIN (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS r, count(DISTINCT l_partkey) AS c, max(l_partkey) AS m FROM lineitem GROUP BY l_orderkey) ON l_orderkey = number"""

GLOBS = ["*Brand#1[0-9]/*", "*.md"]


def q53(spark, sf):
    """Paths that no exclude glob matches and whose language passes the filter."""
    p = T.paths(spark, sf).withColumn("language", S.language(F.array("path")))
    return p.filter(~S.glob_condition(F.col("path"), GLOBS) & S.matches(F.col("language"), ["python", "re:^java$"], [])).select("p_partkey", "path", "language", S.safe_name(F.col("path")).alias("file"), F.sha1("path").alias("hash"))


Q53 = f"""
WITH p AS (SELECT p_partkey, {PATH} AS path FROM part), l AS (SELECT *, CASE WHEN ends_with(path, '.py') THEN 'python' WHEN ends_with(path, '.java') THEN 'java' WHEN ends_with(path, '.js') OR ends_with(path, '.ts') THEN 'javascript' ELSE 'unknown' END AS language FROM p)
SELECT p_partkey, path, language, translate(path, '/#: ', '____') AS file, sha1(path) AS hash FROM l WHERE NOT (path GLOB '*Brand#1[0-9]/*' OR path GLOB '*.md') AND language IN ('python', 'java')"""

def q59(spark, sf):
    """Two lists of paths of each change, merged in order."""
    late = F.col("p_partkey") % 7 >= 4
    g = T.paths(spark, sf).groupBy("change").agg(F.array_sort(F.collect_set(F.when(~late, F.col("path")))).alias("a"), F.array_sort(F.collect_set(F.when(late, F.col("path")))).alias("b"))
    m = S.merged_paths(F.col("a"), F.col("b"))
    return g.select("change", F.size(m).cast("bigint").alias("n_paths"), F.md5(F.array_join(m, ",")).alias("paths_md5"))


Q59 = f"""
WITH g AS (SELECT p_partkey // {T.FILES} AS change, coalesce(list_sort(list(DISTINCT {PATH}) FILTER (p_partkey % 7 < 4)), []) AS a, coalesce(list_sort(list(DISTINCT {PATH}) FILTER (p_partkey % 7 >= 4)), []) AS b FROM part GROUP BY 1),
m AS (SELECT change, list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))) AS m FROM g)
SELECT change, len(m)::BIGINT AS n_paths, md5(array_to_string(m, ',')) AS paths_md5 FROM m"""

QUERIES = {
    "q59_merged_paths": (q59, Q59),
    "q52_pr_assembly": (q52, Q52), "q53_path_filters": (q53, Q53),
    "q01_commit_pairs": (q01, Q01), "q02_author_activity": (q02, Q02), "q03_author_filter": (q03, Q03), "q04_language_inference": (q04, Q04),
    "q05_last_write_wins": (q05, Q05), "q06_insert_ignore": (q06, Q06), "q07_commit_cap": (q07, Q07), "q08_review_counts": (q08, Q08),
    "q09_pr_metrics_by_sha": (q09, Q09), "q10_pr_commit_lists": (q10, Q10), "q11_cycle_time": (q11, Q11), "q12_delivery_labels": (q12, Q12),
    "q41_throughput_prior": (q41, Q41), "q42_backlog_top1": (q42, Q42), "q44_distinct_languages": (q44, Q44), "q51_commit_order": (q51, Q51),
}
