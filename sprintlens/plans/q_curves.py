"""Queries over coding curves and draws from them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.rng import normal_sql, uniform_sql
from ..functions.scalars import minute
from ..operators import curves as C
from ..operators import features as X
from ..operators import history as H
from ..operators.fits import AuthorFits
from ..sources import synthetic as SYN
from ..sources import tables as T
from ..sources.storage import shared_dir

HOUR = 60
MU, ALPHA, BETA = 0.05, 0.02, 0.01
START, END, EMIT, EPS = 0.05, 0.2, 0.3, 1e-6

GRID = f"""
mm AS (SELECT DISTINCT user_id AS author_id, epoch_us(ts) // 60000000 AS m FROM events),
bb AS (SELECT author_id, min(m) AS base, max(m) AS last, count(*) AS n FROM mm GROUP BY author_id HAVING count(*) >= 50),
ss AS (SELECT *, ceil((last - base + 1) / {HOUR}.0::DOUBLE)::INTEGER + 1 AS steps FROM bb),
dd AS (SELECT author_id, unnest(generate_series(0, steps - 1)) AS i FROM ss),
cc AS (SELECT mm.author_id, (m - base) // {HOUR} AS i, count(*) AS k FROM mm JOIN ss USING (author_id) GROUP BY ALL),
gg AS (SELECT dd.author_id, dd.i, coalesce(k, 0)::INTEGER AS y FROM dd LEFT JOIN cc ON cc.author_id = dd.author_id AND cc.i = dd.i)"""


def _grid(spark, sf):
    return C.spread(C.grids(T.commits(spark, sf), HOUR), "author_id")


def q16(spark, sf):
    c = F.col("counts")
    return _grid(spark, sf).select(
        "author_id", "base_minute", "steps", F.aggregate(c, F.lit(0), lambda a, x: a + x).cast("bigint").alias("total"), F.size(F.filter(c, lambda x: x > 0)).cast("bigint").alias("busy"), F.md5(F.array_join(c.cast("array<string>"), ",")).alias("counts_md5")
    )


Q16 = f"""
WITH {GRID} SELECT author_id, base AS base_minute, steps, sum(y)::BIGINT AS total, count(*) FILTER (y > 0) AS busy, md5(string_agg(y, ',' ORDER BY i)) AS counts_md5
FROM gg JOIN ss USING (author_id) GROUP BY author_id, base, steps"""


def q17(spark, sf):
    g = C.filtered(C.grids(T.commits(spark, sf), HOUR), HOUR)
    total = F.aggregate("coding_prob", F.lit(0.0), lambda a, q: a + q)
    return g.select("author_id", "steps", F.round("last", 6).alias("last_log_intensity"), F.round("baseline", 6).alias("baseline"), F.round(total / F.col("steps"), 6).alias("mean_prob"))


Q17 = f"""
WITH RECURSIVE {GRID},
k AS (
  SELECT author_id, -1::BIGINT AS i, 0.0::DOUBLE AS m, 1.0::DOUBLE AS p FROM ss
  UNION ALL
  SELECT k.author_id, gg.i, k.m + (k.p + 0.05) * l.v / greatest(1e-12, l.v * (k.p + 0.05) * l.v + greatest(1e-6, l.v)) * (gg.y - l.v),
    (1.0 - (k.p + 0.05) * l.v / greatest(1e-12, l.v * (k.p + 0.05) * l.v + greatest(1e-6, l.v)) * l.v) * (k.p + 0.05)
  FROM k JOIN gg ON gg.author_id = k.author_id AND gg.i = k.i + 1, LATERAL (SELECT exp(k.m) * {HOUR}.0::DOUBLE AS v) l),
b AS (SELECT author_id, arg_max(m, i) AS last, greatest(1e-6::DOUBLE, quantile_cont(exp(m), 0.2)) AS base FROM k WHERE i >= 0 GROUP BY author_id)
SELECT k.author_id, steps, round(b.last, 6) AS last_log_intensity, round(b.base, 6) AS baseline,
  round(sum(1.0 - exp(-greatest(0.0, exp(m) - b.base) / b.base)) / steps, 6) AS mean_prob
FROM k JOIN b USING (author_id) JOIN ss USING (author_id) WHERE i >= 0 GROUP BY k.author_id, steps, b.last, b.base"""


def q18(spark, sf):
    g = C.excited(C.grids(T.commits(spark, sf), HOUR), MU, ALPHA, BETA, HOUR)
    return g.select("author_id", F.round(F.aggregate("coding_prob", F.lit(0.0), lambda a, x: a + x) / F.col("steps"), 6).alias("mean_prob"), F.round(F.array_max("coding_prob"), 6).alias("max_prob"))


Q18 = f"""
WITH RECURSIVE {GRID},
k AS (SELECT author_id, -1::BIGINT AS i, 0.0::DOUBLE AS g FROM ss UNION ALL
  SELECT k.author_id, gg.i, k.g * exp({-BETA * HOUR}::DOUBLE) + gg.y FROM k JOIN gg ON gg.author_id = k.author_id AND gg.i = k.i + 1)
SELECT author_id, round(sum(1 - exp(-{ALPHA}::DOUBLE * g / {MU}::DOUBLE)) / max(steps), 6) AS mean_prob, round(max(1 - exp(-{ALPHA}::DOUBLE * g / {MU}::DOUBLE)), 6) AS max_prob
FROM k JOIN ss USING (author_id) WHERE i >= 0 GROUP BY author_id"""


def _slices(spark, sf, parts=True):
    """Pairs of authors with a curve; the curve of step i is (i mod 12) / 12 on 5-minute steps."""
    commits = T.commits(spark, sf)
    at = minute(F.col("authored_at"))
    ends = commits.groupBy("author_id").agg(F.min(at).alias("base_minute"), F.max(at).alias("last"), F.count_distinct(at).alias("n_minutes")).filter(F.col("n_minutes") >= 50)
    steps = F.ceil(F.greatest(F.lit(1), F.col("last") - F.col("base_minute")) / 5).cast("int")
    prob = F.transform(F.sequence(F.lit(0), F.col("steps")), lambda i: (i % 12) / F.lit(12.0))
    return C.pair_slices(H.commit_pairs(commits), ends.select("author_id", "base_minute", steps.alias("steps")), 5, prob, parts)


def q19(spark, sf):
    return _slices(spark, sf, parts=False).select("commit_id", "first", "n", F.round("mean", 4).alias("mean_minutes"), F.round("var", 4).alias("var_minutes"))


SLICES = f"""
{{pairs}},
ee AS (SELECT user_id AS author_id, min(epoch_us(ts) // 60000000) AS base, max(epoch_us(ts) // 60000000) AS last FROM events GROUP BY user_id HAVING count(DISTINCT epoch_us(ts) // 60000000) >= 50),
sl AS (SELECT p.*, greatest(0, least((parent_minute - base) // 5, ceil(greatest(1, last - base) / 5.0::DOUBLE)::BIGINT))::INTEGER AS first,
  greatest(0, least((child_minute - base) // 5, ceil(greatest(1, last - base) / 5.0::DOUBLE)::BIGINT))::INTEGER AS until FROM pp p JOIN ee USING (author_id)),
st AS (SELECT commit_id, first, until - first AS n, gap_minutes, unnest(generate_series(first, until - 1)) AS i FROM sl)"""


def _pairs_cte() -> str:
    from .q_history import Q01

    return f"pp AS ({Q01})"


Q19 = f"""
WITH {SLICES.format(pairs=_pairs_cte())}
SELECT sl.commit_id, sl.first, until - sl.first AS n, round(coalesce(sum((i % 12) / 12.0::DOUBLE), 0.0) * 5, 4) AS mean_minutes,
  round(coalesce(sum((i % 12) / 12.0::DOUBLE * (1 - (i % 12) / 12.0::DOUBLE)), 0.0) * 25, 4) AS var_minutes
FROM sl LEFT JOIN st USING (commit_id) GROUP BY sl.commit_id, sl.first, until"""

DRAWS = 3


def q20(spark, sf):
    minutes = C.sample_minutes(5, F.col("gap_minutes").cast("double"), DRAWS, 1, "label", F.col("commit_id"))
    j = _slices(spark, sf).select("commit_id", F.posexplode(minutes).alias("sample", "x"))
    return j.select("commit_id", "sample", F.round("x", 4).alias("minutes"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("x") / 60)), 6).alias("y_hours"))


Q20 = f"""
WITH {SLICES.format(pairs=_pairs_cte())}, k AS (SELECT unnest(generate_series(0, {DRAWS - 1}))::INTEGER AS sample),
a AS (SELECT commit_id, n, gap_minutes, sample,
    sum(CASE WHEN n <= 256 AND {uniform_sql("'1|label|' || commit_id || '|' || sample || '|' || (i - first)")} < (i % 12) / 12.0::DOUBLE THEN 1 ELSE 0 END) * 5.0::DOUBLE AS coins,
    sum((i % 12) / 12.0::DOUBLE) * 5 AS mean, sum((i % 12) / 12.0::DOUBLE * (1 - (i % 12) / 12.0::DOUBLE)) * 25 AS var
  FROM st, k GROUP BY commit_id, n, gap_minutes, sample),
x AS (SELECT sl.commit_id, k.sample, CASE WHEN a.n IS NULL THEN 0.0::DOUBLE WHEN a.n <= 256 THEN coins
    ELSE greatest(0.0::DOUBLE, least(a.gap_minutes::DOUBLE, mean + sqrt(var) * {normal_sql("'1|label|' || sl.commit_id || '|' || k.sample")})) END AS x
  FROM sl CROSS JOIN k LEFT JOIN a ON a.commit_id = sl.commit_id AND a.sample = k.sample)
SELECT commit_id, sample, round(x, 4) AS minutes, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, x / 60)), 6) AS y_hours FROM x"""


def q21(spark, sf):
    sec = minute(F.col("authored_at")) * 60
    day, week = F.lit(2 * math.pi) * (sec % 86400) / 86400, F.lit(2 * math.pi) * (sec % 604800) / 604800
    return T.commits(spark, sf).select("commit_id", *[(F.round(f(x), 6) + 0.0).alias(n) for n, f, x in (("sin_day", F.sin, day), ("cos_day", F.cos, day), ("sin_week", F.sin, week), ("cos_week", F.cos, week))])


_S = "(epoch_us(ts) // 60000000 * 60)"
Q21 = f"""
SELECT event_id AS commit_id, round(sin({2 * math.pi!r}::DOUBLE * ({_S} % 86400) / 86400), 6) + 0.0::DOUBLE AS sin_day, round(cos({2 * math.pi!r}::DOUBLE * ({_S} % 86400) / 86400), 6) + 0.0::DOUBLE AS cos_day,
  round(sin({2 * math.pi!r}::DOUBLE * ({_S} % 604800) / 604800), 6) + 0.0::DOUBLE AS sin_week, round(cos({2 * math.pi!r}::DOUBLE * ({_S} % 604800) / 604800), 6) + 0.0::DOUBLE AS cos_week FROM events"""


def q22(spark, sf):
    """Log likelihood of the two-state chain with fixed chances, by a scaled forward fold."""

    def move(acc, y):
        b0 = F.when(y > 0, EMIT).otherwise(1 - EMIT)
        b1 = F.when(y > 0, EPS).otherwise(1 - EPS)
        a0 = F.when(acc["n"] == 0, 0.5).otherwise(acc["f0"] * (1 - END) + acc["f1"] * START) * b0
        a1 = F.when(acc["n"] == 0, 0.5).otherwise(acc["f0"] * END + acc["f1"] * (1 - START)) * b1
        c = a0 + a1
        return F.struct((a0 / c).alias("f0"), (a1 / c).alias("f1"), (acc["ll"] + F.log(c)).alias("ll"), (acc["n"] + 1).alias("n"))

    start = F.struct(F.lit(0.0).alias("f0"), F.lit(0.0).alias("f1"), F.lit(0.0).alias("ll"), F.lit(0).alias("n"))
    r = F.aggregate("counts", start, move)
    return _grid(spark, sf).select("author_id", r.alias("r")).select("author_id", F.round("r.ll", 5).alias("log_likelihood"), F.round("r.f0", 6).alias("coding_now"))


Q22 = f"""
WITH RECURSIVE {GRID},
k AS (SELECT author_id, -1::BIGINT AS i, 0.0::DOUBLE AS f0, 0.0::DOUBLE AS f1, 0.0::DOUBLE AS ll FROM ss UNION ALL
  SELECT author_id, i, a0 / (a0 + a1), a1 / (a0 + a1), ll + ln(a0 + a1) FROM (
    SELECT k.author_id, gg.i, k.ll, CASE WHEN gg.i = 0 THEN 0.5::DOUBLE ELSE f0 * {1 - END}::DOUBLE + f1 * {START}::DOUBLE END * CASE WHEN y > 0 THEN {EMIT}::DOUBLE ELSE {1 - EMIT}::DOUBLE END AS a0,
      CASE WHEN gg.i = 0 THEN 0.5::DOUBLE ELSE f0 * {END}::DOUBLE + f1 * {1 - START}::DOUBLE END * CASE WHEN y > 0 THEN {EPS}::DOUBLE ELSE {1 - EPS}::DOUBLE END AS a1
    FROM k JOIN gg ON gg.author_id = k.author_id AND gg.i = k.i + 1))
SELECT author_id, round(arg_max(ll, i), 5) AS log_likelihood, round(arg_max(f0, i), 6) AS coding_now FROM k WHERE i >= 0 GROUP BY author_id"""

def q61(spark, sf):
    """Fits kept by author: the histories up to the last day first, then all; which authors the second run had to fit."""
    commits = T.commits(spark, sf)
    last_day = commits.agg(F.max(F.to_date("authored_at"))).scalar()
    fits = AuthorFits(spark, shared_dir(spark, "fits"), "state_space", HOUR)
    fits.fit(C.grids(commits.filter(F.to_date("authored_at") < last_day), HOUR))
    grid = C.grids(commits, HOUR)
    own = shared_dir(spark, "refitted")
    fits.missing(grid).select("author_id", F.lit(True).alias("refitted")).write.parquet(own)
    fits.fit(grid)
    steps, total = F.size("coding_prob"), F.aggregate("coding_prob", F.lit(0.0), lambda a, q: a + q)
    out = fits.curves(grid, steps.alias("steps"), F.round("last", 6).alias("last_log_intensity"), F.round(total / steps, 6).alias("mean_prob"))
    return out.join(spark.read.parquet(own), "author_id", "left").select("author_id", F.coalesce("refitted", F.lit(False)).alias("refitted"), "steps", "last_log_intensity", "mean_prob")


def _q61_sql() -> str:
    head, tail = Q17.rsplit("SELECT k.author_id, steps", 1)
    return head.rstrip() + """,
q AS (SELECT k.author_id, steps""" + tail + """)
SELECT author_id, EXISTS (SELECT 1 FROM events e WHERE e.user_id = q.author_id AND e.ts::DATE = (SELECT max(ts::DATE) FROM events)) AS refitted, steps, last_log_intensity, mean_prob FROM q"""


AUTHORS, DAYS, CHANCE = SYN.AUTHORS, SYN.DAYS, SYN.CHANCE


def q43(spark, sf):
    """Synthetic commits: a coin a 5-minute step in office hours; a PR for 8 commits of an author."""
    return SYN.commits(spark).select("author_id", F.date_format("authored_at", "yyyy-MM-dd HH:mm").alias("authored_at"), "pr")


Q43 = f"""
WITH s AS (SELECT r AS id, r // {DAYS * 288} AS author_id, TIMESTAMP '2025-01-06' + to_minutes((r % {DAYS * 288} * 5)) AS t FROM (SELECT unnest(generate_series(0, {AUTHORS * DAYS * 288 - 1})) AS r))
SELECT author_id, strftime(t, '%Y-%m-%d %H:%M') AS authored_at, (row_number() OVER (PARTITION BY author_id ORDER BY t) - 1) // 8 AS pr FROM s
WHERE isodow(t) <= 5 AND hour(t) >= 9 AND hour(t) < 17 AND {uniform_sql("'7|synthetic|' || id")} < {CHANCE}::DOUBLE"""


def q60(spark, sf):
    """The synthetic commits' edits: their diffs and what they do to the module's syntax tree."""
    rows = SYN.changes(SYN.commits(spark))
    f = X.code_features(rows.select("id", F.lit("python").alias("language"), "before_blobs", "after_blobs"))
    return rows.select("id", "author_id", "diff_text").join(f, "id")


def q46(spark, sf):
    return C.fitted(C.grids(T.commits(spark, sf)), "hawkes")


def q47(spark, sf):
    return C.fitted(C.grids(T.commits(spark, sf), HOUR, span_extra=0), "hmm", HOUR, epochs=15)


QUERIES = {
    "q16_time_histogram": (q16, Q16), "q17_ekf_curve": (q17, Q17), "q18_hawkes_excitation": (q18, Q18), "q19_expected_minutes": (q19, Q19), "q20_label_samples": (q20, Q20),
    "q21_time_features": (q21, Q21), "q22_hmm_forward": (q22, Q22), "q61_fits_by_author": (q61, _q61_sql()), "q43_synthetic_commits": (q43, Q43), "q60_synthetic_changes": (q60, None), "q46_hawkes_fit": (q46, None), "q47_hmm_fit": (q47, None),
}
