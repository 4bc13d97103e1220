"""Queries over effort distributions and predictor heads."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import dist as D
from ..functions.rng import normal_sql, uniform_sql
from ..functions.scalars import lognormal_quantiles
from ..operators import models as N
from ..sources import tables as T


def _quantiles():
    v = F.col("value") / 100
    top = F.when(F.col("event_id") % 17 == 0, v * 0.5).otherwise(v * 2)
    return F.array(*[F.struct(F.lit(q).alias("q"), x.alias("v")) for q, x in ((0.5, v), (0.8, v * 1.5), (0.9, top))])


def q25(spark, sf):
    d = T.table(spark, sf, "events").select("event_id", _quantiles().alias("d"))
    c = F.col("d")
    return d.select("event_id", D.quantile_valid(c).alias("valid"), F.round(D.quantile_mean(c), 8).alias("mean"), *[F.round(D.quantile_at(c, F.lit(q)), 8).alias(f"p{int(q * 100)}") for q in (0.2, 0.6, 0.85, 0.95)])


Q25 = """
WITH d AS (SELECT event_id, value / 100 AS a, value / 100 * 1.5::DOUBLE AS b, CASE WHEN event_id % 17 = 0 THEN value / 100 * 0.5::DOUBLE ELSE value / 100 * 2 END AS c FROM events)
SELECT event_id, b >= a AND c >= b AS valid, round(0.5::DOUBLE * a + (0.8::DOUBLE - 0.5::DOUBLE) * (a + b) / 2 + (0.9::DOUBLE - 0.8::DOUBLE) * (b + c) / 2 + (1 - 0.9::DOUBLE) * c, 8) AS mean,
  round(a, 8) AS p20, round(a + (b - a) * (0.6::DOUBLE - 0.5::DOUBLE) / (0.8::DOUBLE - 0.5::DOUBLE), 8) AS p60, round(b + (c - b) * (0.85::DOUBLE - 0.8::DOUBLE) / (0.9::DOUBLE - 0.8::DOUBLE), 8) AS p85, round(c, 8) AS p95 FROM d"""


def _mixtures(spark, sf):
    e = lambda k: F.element_at("embedding", k).cast("double")
    w = F.lit(1.0) / (F.lit(1.0) + F.exp(-e(1)))
    m = F.struct(
        F.array(w, F.lit(1.0) - w).alias("weights"), F.array(e(2), e(3) + 0.5).alias("means"), F.array(F.abs(e(4)) + 0.1, F.abs(e(5)) + 0.1).alias("stds"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high")
    )
    return T.table(spark, sf, "embeddings").select("vec_id", m.alias("m"), (F.col("label") / 10).alias("y"), "embedding")


MIX = """
m AS (SELECT vec_id, label / 10 AS y, 1.0::DOUBLE / (1.0::DOUBLE + exp(-embedding[1]::DOUBLE)) AS w, embedding[2]::DOUBLE AS m1, embedding[3]::DOUBLE + 0.5::DOUBLE AS m2,
  abs(embedding[4]::DOUBLE) + 0.1::DOUBLE AS s1, abs(embedding[5]::DOUBLE) + 0.1::DOUBLE AS s2 FROM embeddings)"""


def q26(spark, sf):
    return _mixtures(spark, sf).select("vec_id", D.mixture_valid(F.col("m")).alias("valid"), F.round(D.clipped_mean(F.col("m")), 5).alias("clipped_mean"))


def _phi(z: str) -> str:
    return D.normal_cdf_sql(z)


def _clip_sql(m: str, s: str) -> str:
    a, b = f"((0 - {m}) / {s})", f"((1 - {m}) / {s})"
    pdf = "(exp(-{z} * {z} / 2) * 0.3989422804014327::DOUBLE)"
    return f"({m} * ({_phi(b)} - {_phi(a)}) - {s} * ({pdf.format(z=b)} - {pdf.format(z=a)}) + (1 - {_phi(b)}))"


Q26 = f"WITH {MIX} SELECT vec_id, true AS valid, round(w * {_clip_sql('m1', 's1')} + (1 - w) * {_clip_sql('m2', 's2')}, 5) AS clipped_mean FROM m"


def q27(spark, sf):
    return _mixtures(spark, sf).select("vec_id", F.round(D.mixture_cdf(F.col("m"), F.col("y")), 5).alias("cdf"))


def _raw(x: str) -> str:
    return f"(w * {_phi(f'(({x} - m1) / s1)')} + (1 - w) * {_phi(f'(({x} - m2) / s2)')})"


Q27 = f"WITH {MIX} SELECT vec_id, round(CASE WHEN y <= 0 THEN 0.0 WHEN y >= 1 THEN 1.0 ELSE ({_raw('y')} - {_raw('0')}) / greatest(1e-12, {_raw('1')} - {_raw('0')}) END::DOUBLE, 5) AS cdf FROM m"


def q28(spark, sf):
    x = F.log(F.greatest(F.lit(1e-9), F.col("l_quantity")))
    return T.table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.stddev_pop(x), 6).alias("sigma"), F.round(F.exp(F.avg(x)), 6).alias("scale"))


Q28 = """
SELECT l_returnflag, l_linestatus, round(stddev_pop(ln(greatest(1e-9::DOUBLE, l_quantity))), 6) AS sigma, round(exp(avg(ln(greatest(1e-9::DOUBLE, l_quantity)))), 6) AS scale FROM lineitem GROUP BY ALL"""

HOURS_PER_POINT, CV = 4.0, 0.6


def q29(spark, sf):
    q = lognormal_quantiles(F.greatest(F.lit(1e-6), F.col("p_size").cast("double")) * HOURS_PER_POINT, CV)
    return T.table(spark, sf, "part").select("p_partkey", *[F.round(x, 5).alias(n) for x, n in zip(q, ("p50", "p80", "p90"), strict=True)])


_S2 = math.log(CV * CV + 1)
Q29 = f"""
SELECT p_partkey, round(exp(ln(greatest(1e-6::DOUBLE, p_size::DOUBLE) * {HOURS_PER_POINT}) - {_S2 / 2!r}::DOUBLE), 5) AS p50, round(exp(ln(greatest(1e-6::DOUBLE, p_size::DOUBLE) * {HOURS_PER_POINT}) - {_S2 / 2!r}::DOUBLE + {math.sqrt(_S2) * 0.8416212335729143!r}::DOUBLE), 5) AS p80,
  round(exp(ln(greatest(1e-6::DOUBLE, p_size::DOUBLE) * {HOURS_PER_POINT}) - {_S2 / 2!r}::DOUBLE + {math.sqrt(_S2) * 1.2815515655446004!r}::DOUBLE), 5) AS p90 FROM part"""


def q31(spark, sf):
    e = lambda k: F.element_at("embedding", k).cast("double")
    y = F.col("label") / 10
    loss = lambda p, q: F.greatest((y - p) * q, (y - p) * (q - 1))
    return T.table(spark, sf, "embeddings").groupBy("label").agg(F.round(F.avg((loss(e(1), 0.5) + loss(e(1) + F.abs(e(2)), 0.9)) / 2), 6).alias("pinball"))


Q31 = """
WITH d AS (SELECT label, label / 10 - embedding[1]::DOUBLE AS a, label / 10 - (embedding[1]::DOUBLE + abs(embedding[2]::DOUBLE)) AS b FROM embeddings)
SELECT label, round(avg((greatest(a * 0.5::DOUBLE, a * -0.5::DOUBLE) + greatest(b * 0.9::DOUBLE, b * (0.9::DOUBLE - 1))) / 2), 6) AS pinball FROM d GROUP BY label"""


def q32(spark, sf):
    m = _mixtures(spark, sf).select("vec_id", F.col("m"), "y", F.element_at("embedding", 1).alias("e"))
    t = F.zip_with(F.col("m.weights"), F.arrays_zip("m.means", "m.stds"), lambda w, c: F.log(w) - F.log(c["stds"]) - 0.9189385332046727 - F.pow((F.col("y") - c["means"]) / c["stds"], 2) / 2)
    top = F.array_max(t)
    return m.select("vec_id", F.round(-(top + F.log(F.aggregate(F.transform(t, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x))), 5).alias("nll"))


_T1 = "(ln(w) - ln(s1) - 0.9189385332046727::DOUBLE - ((y - m1) / s1) ** 2 / 2)"
_T2 = "(ln(1 - w) - ln(s2) - 0.9189385332046727::DOUBLE - ((y - m2) / s2) ** 2 / 2)"
Q32 = f"WITH {MIX} SELECT vec_id, round(-(greatest({_T1}, {_T2}) + ln(exp({_T1} - greatest({_T1}, {_T2})) + exp({_T2} - greatest({_T1}, {_T2})))), 5) AS nll FROM m"


def q33(spark, sf):
    """Monotone quantiles: softplus base and cumulated softplus steps of the first five values."""
    raw = F.transform(F.slice("embedding", 1, 5), lambda x: F.log1p(F.exp(x.cast("double"))))
    cum = F.transform(raw, lambda x, i: F.aggregate(F.slice(raw, 1, i + 1), F.lit(0.0), lambda a, v: a + v))
    return T.table(spark, sf, "embeddings").select("vec_id", *[F.round(F.get(cum, F.lit(k)), 5).alias(f"v{k}") for k in range(5)])


_SP = [f"ln(1 + exp(embedding[{k}]::DOUBLE))" for k in range(1, 6)]
Q33 = "SELECT vec_id, " + ", ".join(f"round({' + '.join(_SP[: k + 1])}, 5) AS v{k}" for k in range(5)) + " FROM embeddings"


def _training(spark, sf):
    return T.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), (F.col("label") / 10).alias("y"), F.least(F.lit(1.0), F.col("label") / 10 + 0.1).alias("z"))


def q48(spark, sf):
    rows = _training(spark, sf)
    return N.predict(rows, N.train(rows, {"y": "mdn"}, epochs=8)).withColumn("p90", D.mixture_quantile(0.9)(F.col("y_mdn")))


def q49(spark, sf):
    rows = _training(spark, sf)
    return N.predict(rows, N.train(rows, {"y": "mdn", "z": "quantile"}, epochs=8))


def q63(spark, sf):
    """A mixture head learnt from all rows in tasks, two steps an epoch."""
    rows = _training(spark, sf)
    return N.predict(rows, N.train_all(rows, {"y": "mdn"}, epochs=4, steps=2)).withColumn("p90", D.mixture_quantile(0.9)(F.col("y_mdn")))


def q54(spark, sf):
    """A draw from each event's quantile distribution, null where it isn't one, and the lognormal with its p50 and p90."""
    d = T.table(spark, sf, "events").select("event_id", _quantiles().alias("d"))
    ln = D.lognormal_from_quantiles(F.get("d", F.lit(0))["v"], F.get("d", F.lit(2))["v"])
    draw = F.when(D.quantile_valid(F.col("d")), D.quantile_sample(F.col("d"), 5, F.col("event_id")))
    return d.select("event_id", F.round(draw, 7).alias("draw"), F.round(ln["mu"], 6).alias("mu"), F.round(ln["sigma"], 6).alias("sigma"))


_U = uniform_sql("'5|' || event_id")
Q54 = f"""
WITH d AS (SELECT event_id, {_U} AS u, value / 100 AS a, value / 100 * 1.5::DOUBLE AS b, CASE WHEN event_id % 17 = 0 THEN value / 100 * 0.5::DOUBLE ELSE value / 100 * 2 END AS c FROM events)
SELECT event_id, CASE WHEN b >= a AND c >= b THEN round(CASE WHEN u < 0.5 THEN a WHEN u < 0.8 THEN a + (b - a) * (u - 0.5::DOUBLE) / (0.8::DOUBLE - 0.5::DOUBLE) WHEN u < 0.9 THEN b + (c - b) * (u - 0.8::DOUBLE) / (0.9::DOUBLE - 0.8::DOUBLE) ELSE c END, 7) END AS draw,
  CASE WHEN a > 0 AND c >= a THEN round(ln(a), 6) END AS mu, CASE WHEN a > 0 AND c >= a THEN round(ln(c / a) / 1.2815515655446004::DOUBLE, 6) END AS sigma FROM d"""


def q55(spark, sf):
    """A clipped draw from each vector's mixture."""
    m = _mixtures(spark, sf)
    return m.select("vec_id", F.round(D.mixture_sample(F.col("m"), 6, F.col("vec_id")), 6).alias("draw"))


_N, _C = normal_sql("'6|' || vec_id"), uniform_sql("'6|' || vec_id || '|c'")
Q55 = f"WITH {MIX} SELECT vec_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN w <= {_C} * (w + (1 - w)) THEN m2 + s2 * {_N} ELSE m1 + s1 * {_N} END)), 6) AS draw FROM m"

def q56(spark, sf):
    """Median and 90 % quantile of each vector's truncated mixture."""
    return _mixtures(spark, sf).select("vec_id", *[F.round(D.mixture_quantile(q)(F.col("m")), 5).alias(n) for q, n in ((0.5, "p50"), (0.9, "p90"))])


def _q56_sql() -> str:
    def half(k: str) -> str:
        return f"CASE WHEN {_raw(f'((a{k} + b{k}) / 2)')} < c0 + q{k} * greatest(1e-12, c1 - c0) THEN (a{k} + b{k}) / 2 ELSE a{k} END, CASE WHEN {_raw(f'((a{k} + b{k}) / 2)')} < c0 + q{k} * greatest(1e-12, c1 - c0) THEN b{k} ELSE (a{k} + b{k}) / 2 END"

    return f"""
WITH RECURSIVE {MIX},
s AS (SELECT 0 AS i, *, {_raw('0')} AS c0, {_raw('1')} AS c1, 0.5::DOUBLE AS q1, 0.9::DOUBLE AS q2, 0.0::DOUBLE AS a1, 1.0::DOUBLE AS b1, 0.0::DOUBLE AS a2, 1.0::DOUBLE AS b2 FROM m
  UNION ALL SELECT i + 1, vec_id, y, w, m1, m2, s1, s2, c0, c1, q1, q2, {half('1')}, {half('2')} FROM s WHERE i < 80)
SELECT vec_id, round((a1 + b1) / 2, 5) AS p50, round((a2 + b2) / 2, 5) AS p90 FROM s WHERE i = 80"""


def q57(spark, sf):
    """Effort payloads of both kinds as JSON and back, drawn from and checked."""
    m = _mixtures(spark, sf).select(F.col("vec_id").alias("id"), D.encode_mixture(F.col("m")).alias("body"))
    q = T.table(spark, sf, "events").select((-F.col("event_id") - 1).alias("id"), D.encode_quantiles(_quantiles()).alias("body"))
    p = F.col("p")
    out = m.unionByName(q).select("id", D.decoded(F.col("body")).alias("p"))
    valid = D.payload_valid(p)
    return out.select("id", p["type"].alias("type"), valid.alias("valid"), F.round(F.when(valid, D.payload_sample(p, 8, F.col("id"))), 5).alias("draw"))


_N8, _C8, _U8 = normal_sql("'8|' || vec_id"), uniform_sql("'8|' || vec_id || '|c'"), uniform_sql("'8|' || (-event_id - 1)")
Q57 = f"""
WITH {MIX},
d AS (SELECT event_id, {_U8} AS u, value / 100 AS a, value / 100 * 1.5::DOUBLE AS b, CASE WHEN event_id % 17 = 0 THEN value / 100 * 0.5::DOUBLE ELSE value / 100 * 2 END AS c FROM events)
SELECT vec_id AS id, 'gmm' AS type, true AS valid, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN w <= {_C8} * (w + (1 - w)) THEN m2 + s2 * {_N8} ELSE m1 + s1 * {_N8} END)), 5) AS draw FROM m
UNION ALL SELECT -event_id - 1, 'quantiles', b >= a AND c >= b, CASE WHEN b >= a AND c >= b THEN round(CASE WHEN u < 0.5 THEN a WHEN u < 0.8 THEN a + (b - a) * (u - 0.5::DOUBLE) / (0.8::DOUBLE - 0.5::DOUBLE) WHEN u < 0.9 THEN b + (c - b) * (u - 0.8::DOUBLE) / (0.9::DOUBLE - 0.8::DOUBLE) ELSE c END, 5) END FROM d"""

QUERIES = {
    "q56_mixture_quantiles": (q56, _q56_sql()), "q57_payload_round_trip": (q57, Q57),
    "q54_quantile_samples": (q54, Q54), "q55_mixture_samples": (q55, Q55),
    "q25_quantile_dist": (q25, Q25), "q26_clipped_mixture_mean": (q26, Q26), "q27_truncated_cdf": (q27, Q27), "q28_lognormal_fit": (q28, Q28), "q29_story_points": (q29, Q29),
    "q31_pinball_loss": (q31, Q31), "q32_mdn_nll": (q32, Q32), "q33_quantile_head": (q33, Q33), "q48_mdn_train": (q48, None), "q49_multitask_train": (q49, None), "q63_data_parallel_train": (q63, None),
}
