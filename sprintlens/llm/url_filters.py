"""URL filters: a temporal list join, in DataFrame functions only.

List entries are dated: an entry names a host suffix, perhaps a path prefix, an action
(block or allow) and the day from which it holds, until the next entry of the same
pattern. A capture is judged by the entries that were active when it was fetched: the
longest host suffix wins, then the longest path prefix, then the latest entry, then the
smaller action name. A capture that no active entry matches is allowed.

A pattern's intervals are its timeline, one row a pattern. Hosts are few next to captures,
so suffixes are matched once a distinct host: a host gets the suffixes that the list has of
it, with the lengths of their path prefixes, never their entries. The captures of such
hosts then look up the few patterns that can match them, path cut at those lengths, in the
timelines, and the as-of step picks what is active at the fetch time. The three joins (on
suffix, host and pattern) split off heavy keys, so neither ``com``, nor a host with a third
of all captures, nor one with very many entries gathers in a task.

Null, empty and malformed URLs have no host and are allowed. Very long hosts and paths cost
no more than the longest listed ones. Captures without a time match no interval. Repeated captures are judged each; repeated entries count once. Entries
without a pattern or date are ignored. Extra columns are carried; the result's own are
``host``, ``entry``, ``action`` and ``blocked``, which take the place of equally named ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, join_groups, table

#: (host suffix, path prefix, action, from day). The fixed part of the query's list.
ENTRIES = (
    ("spam-farm.example.org", "", "block", "2024-02-01"),
    ("cheap-pills.example.com", "", "block", "2024-01-15"),
    ("cheap-pills.example.com", "", "allow", "2024-09-01"),
    ("cheap-pills.example.com", "", "block", "2024-10-10"),
    ("example.net", "/es/", "block", "2024-03-01"),
    ("example.net", "/es/", "allow", "2024-11-01"),
    ("tionsh.example.net", "", "block", "2024-06-15"),
    ("blog.tionsh.example.com", "", "block", "2024-05-01"),
    ("tionsh.example.com", "", "block", "2024-02-10"),
    ("tionsh.example.com", "", "allow", "2024-04-10"),
    ("tionble.example.org", "", "block", "2024-07-01"),
    ("tionble.example.com", "/de", "block", "2024-01-01"),
    ("m.ththth.example.net", "", "block", "2024-08-01"),
    ("example.org", "/fr/", "block", "2024-12-01"),
)
FIRST_DAY, DAYS = "2024-01-01", 366


def host_of(url: Column) -> Column:
    """The lower-cased host of a URL without user, port and final dot; empty if there is none."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), "\\.?(:[0-9]*)?$", ""))


def path_of(url: Column) -> Column:
    """The path of a URL, at least a slash."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def suffixes(host: Column, most: int) -> Column:
    """The host's last labels, up to ``most``, and every part of them after a dot."""
    labels = F.split(host, "\\.")
    first = F.greatest(F.lit(1), F.size(labels) - (most - 1))
    return F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """suffix, prefix, action, since and until (null: still valid) of dated entries."""
    df = entries.select(F.lower("suffix").alias("suffix"), F.coalesce("prefix", F.lit("")).alias("prefix"), "action", "since").distinct()
    df = df.filter("suffix IS NOT NULL AND suffix <> '' AND since IS NOT NULL")
    by = Window.partitionBy("suffix", "prefix").orderBy("since", F.desc("action"))
    return df.withColumn("until", F.lead("since").over(by)).filter("until IS NULL OR until > since")


def timelines(entries: DataFrame) -> DataFrame:
    """pattern (suffix and prefix) and its intervals (since, until, action), which don't overlap."""
    span = F.struct("since", "until", "action")
    return intervals(entries).groupBy(F.struct("suffix", "prefix").alias("pattern")).agg(F.collect_list(span).alias("spans"))


def listed_hosts(hosts: DataFrame, lines: DataFrame, at: Scratch) -> DataFrame:
    """host, n and candidates (suffix, lengths of its prefixes) of those hosts (host, n) that have a listed suffix."""
    lengths = lines.groupBy(F.col("pattern.suffix").alias("suffix")).agg(F.collect_set(F.length("pattern.prefix")).alias("lengths"))
    most = lines.agg(F.max(F.size(F.split("pattern.suffix", "\\.")))).first()[0] or 1
    parts = at.write(hosts.select("host", F.explode(suffixes(F.col("host"), most)).alias("suffix")), "parts")
    groups = at.write(parts.groupBy("suffix").agg(F.count(F.lit(1)).alias("held")).join(lengths, "suffix"), "suffixes")
    met = join_groups(parts, groups, "suffix", "held", parts.count())
    return hosts.join(met.groupBy("host").agg(F.collect_list(F.struct("suffix", "lengths")).alias("candidates")), "host")


def url_filter(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """The captures with host, entry, action and blocked."""
    at = Scratch(captures.sparkSession, "urls")
    own = ("host", "entry", "action", "blocked")
    names = [c for c in captures.columns if c not in own]
    body = F.struct(*names, F.lit(0).alias("__none")).alias("body")
    rows = at.write(captures.select(body, host_of(F.col(url)).alias("host"), F.monotonically_increasing_id().alias("id")), "rows")
    lines = at.write(timelines(entries), "timelines")
    hosts = at.write(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "hosts")
    listed = at.write(listed_hosts(hosts, lines, at), "listed")
    seen = rows.select("id", "host", path_of(F.col("body")[url]).alias("path"), F.col("body")[fetched].alias("when"))
    seen = join_groups(seen, listed, "host", "n", rows.count())

    def patterns(c: Column) -> Column:
        fit = F.filter(c["lengths"], lambda n: n <= F.length("path"))
        return F.transform(fit, lambda n: F.struct(c["suffix"].alias("suffix"), F.substr("path", F.lit(1), n).alias("prefix")))

    keys = at.write(seen.select("id", "when", F.explode(F.flatten(F.transform("candidates", patterns))).alias("pattern")), "keys")
    groups = at.write(keys.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).join(lines, "pattern"), "patterns")
    active = F.filter("spans", lambda x: (x["since"] <= F.col("when")) & (x["until"].isNull() | (x["until"] > F.col("when"))))
    hits = join_groups(keys, groups, "pattern", "n", keys.count()).select("id", "pattern", F.get(active, F.lit(0))["action"].alias("action")).filter("action IS NOT NULL")
    rank = F.struct(-F.length("pattern.suffix"), -F.length("pattern.prefix"))
    best = hits.groupBy("id").agg(F.min_by(F.struct("pattern", "action"), rank).alias("best"))
    return rows.join(best, "id", "left").select(
        *[F.col("body")[c].alias(c) for c in names],
        "host",
        F.concat("best.pattern.suffix", "best.pattern.prefix").alias("entry"),
        F.coalesce("best.action", F.lit("allow")).alias("action"),
        F.coalesce(F.col("best.action") == "block", F.lit(False)).alias("blocked"),
    )


def entry_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{s}', '{p}', '{a}', DATE '{d}')" for s, p, a, d in ENTRIES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(suffix, prefix, action, since)")


def _drawn(text: Column) -> Column:
    """A number that follows from a text."""
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(6)), 16, 10).cast("bigint")


def derived_entries(pages: DataFrame) -> DataFrame:
    """Dated entries that grow with the pages: by a hash, a quarter of their addresses as patterns, a third of these reversed on another day, and a third of their hosts, half of these reversed."""
    seen = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).filter("host <> ''").distinct()
    day = lambda n: F.date_add(F.to_date(F.lit(FIRST_DAY)), (n % DAYS).cast("int")).alias("since")
    h = F.col("h")
    paths = seen.withColumn("h", _drawn(F.concat("host", "path"))).filter(h % 4 == 0)
    act = F.when(h % 8 == 0, "block").otherwise("allow").alias("action")
    back = F.when(h % 8 == 0, "allow").otherwise("block").alias("action")
    hosts = seen.select("host").distinct().withColumn("h", _drawn(F.col("host"))).filter(h % 3 == 0)
    own = [
        paths.select("host", "path", act, day(h)),
        paths.filter(h % 12 == 0).select("host", "path", back, day(F.floor(h / 64))),
        hosts.select("host", F.lit("").alias("path"), F.lit("block").alias("action"), day(h)),
        hosts.filter(h % 6 == 0).select("host", F.lit("").alias("path"), F.lit("allow").alias("action"), day(F.floor(h / 64))),
    ]
    return reduce(DataFrame.unionByName, own).select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), "action", "since")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages have no fetch time and no list: the day is a function of page_id, the list one of the pages' addresses and a few fixed entries."""
    day = F.date_add(F.to_date(F.lit(FIRST_DAY)), F.pmod(F.col("page_id") * 7919, F.lit(DAYS)).cast("int"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched_on"))
    return url_filter(pages, derived_entries(pages).unionByName(entry_table(spark))).drop("url")


def sql(pages: str = "pages") -> str:
    rows = ", ".join(f"('{s}', '{p}', '{a}', DATE '{d}')" for s, p, a, d in ENTRIES)
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*://"
    day = lambda n: f"DATE '{FIRST_DAY}' + CAST({n} % {DAYS} AS INTEGER)"
    return f"""
WITH c AS (
  SELECT page_id, DATE '{FIRST_DAY}' + CAST(((page_id * 7919) % {DAYS} + {DAYS}) % {DAYS} AS INTEGER) AS fetched_on,
    lower(regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '{scheme}([^/?#]*)', 1), '^.*@', ''), '\\.?(:[0-9]*)?$', '')) AS host,
    CASE WHEN regexp_extract(coalesce(url, ''), '{scheme}[^/?#]*([^?#]*)', 1) = '' THEN '/'
      ELSE regexp_extract(coalesce(url, ''), '{scheme}[^/?#]*([^?#]*)', 1) END AS path
  FROM {pages}),
p AS (SELECT *, ('0x' || substr(md5(host || path), 1, 6))::BIGINT AS h FROM (SELECT DISTINCT host, path FROM c WHERE host <> '')),
o AS (SELECT *, ('0x' || substr(md5(host), 1, 6))::BIGINT AS h FROM (SELECT DISTINCT host FROM c WHERE host <> '')),
e AS (
  SELECT suffix, prefix, action, CAST(since AS DATE) AS since FROM (VALUES {rows}) t(suffix, prefix, action, since)
  UNION SELECT host, path, CASE WHEN h % 8 = 0 THEN 'block' ELSE 'allow' END, {day('h')} FROM p WHERE h % 4 = 0
  UNION SELECT host, path, CASE WHEN h % 8 = 0 THEN 'allow' ELSE 'block' END, {day('(h // 64)')} FROM p WHERE h % 12 = 0
  UNION SELECT host, '', 'block', {day('h')} FROM o WHERE h % 3 = 0
  UNION SELECT host, '', 'allow', {day('(h // 64)')} FROM o WHERE h % 6 = 0),
v AS (SELECT *, lead(since) OVER (PARTITION BY suffix, prefix ORDER BY since, action DESC) AS until FROM e),
m AS (
  SELECT page_id, v.*, row_number() OVER (PARTITION BY page_id ORDER BY length(suffix) DESC, length(prefix) DESC, suffix, prefix, action, since) AS k
  FROM c JOIN v ON (c.host = v.suffix OR ends_with(c.host, '.' || v.suffix)) AND starts_with(c.path, v.prefix)
    AND v.since <= c.fetched_on AND (v.until IS NULL OR v.until > c.fetched_on)
  WHERE v.until IS NULL OR v.until > v.since)
SELECT c.page_id, c.fetched_on, c.host, m.suffix || m.prefix AS entry, coalesce(m.action, 'allow') AS action, coalesce(m.action = 'block', false) AS blocked
FROM c LEFT JOIN m ON c.page_id = m.page_id AND m.k = 1"""
