"""Effort distributions as column functions.

A quantile distribution is an array of structs (q, v) sorted by q; a mixture is a struct of
weights, means, stds and bounds low and high (null: open).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .rng import normal, uniform

# Abramowitz and Stegun 26.2.17, |error| < 7.5e-8.
CDF_P = 0.2316419
CDF_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) * F.lit(0.3989422804014327)


def normal_cdf(z: Column) -> Column:
    """The normal distribution function by a published polynomial; the engine has no erf."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(CDF_P) * F.abs(z))
    poly = t * (F.lit(CDF_B[0]) + t * (F.lit(CDF_B[1]) + t * (F.lit(CDF_B[2]) + t * (F.lit(CDF_B[3]) + t * F.lit(CDF_B[4])))))
    tail = normal_pdf(z) * poly
    return F.when(z >= 0, F.lit(1.0) - tail).otherwise(tail)


def normal_cdf_sql(z: str) -> str:
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {CDF_P}::DOUBLE * abs({z})))"
    b = [f"({x}::DOUBLE)" for x in CDF_B]
    tail = f"(exp(-({z}) * ({z}) / 2) * 0.3989422804014327::DOUBLE * ({t} * ({b[0]} + {t} * ({b[1]} + {t} * ({b[2]} + {t} * ({b[3]} + {t} * {b[4]}))))))"
    return f"(CASE WHEN ({z}) >= 0 THEN 1.0::DOUBLE - {tail} ELSE {tail} END)"


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _over(m: Column, fn: Callable[[Column, Column], Column]) -> Column:
    """Weighted sum of fn(mean, std) over the components."""
    return _sum(F.zip_with(m["weights"], F.arrays_zip(m["means"], m["stds"]), lambda w, c: w * fn(c["means"], c["stds"])))


def mixture_cdf(m: Column, x: Column) -> Column:
    """Truncated distribution function: the mixture's, renormalised between the bounds."""

    def raw(v: Column) -> Column:
        return _over(m, lambda mu, sd: normal_cdf((v - mu) / sd))

    below = F.coalesce(raw(m["low"]), F.lit(0.0))
    above = F.coalesce(raw(m["high"]), F.lit(1.0))
    return F.when(x <= m["low"], 0.0).when(x >= m["high"], 1.0).otherwise((raw(x) - below) / F.greatest(F.lit(1e-12), above - below))


def clipped_mean(m: Column) -> Column:
    """Mean of draws clipped to the bounds, in closed form."""

    def one(mu: Column, sd: Column) -> Column:
        a, b = (m["low"] - mu) / sd, (m["high"] - mu) / sd
        pa, pb = F.coalesce(normal_cdf(a), F.lit(0.0)), F.coalesce(normal_cdf(b), F.lit(1.0))
        da, db = F.coalesce(normal_pdf(a), F.lit(0.0)), F.coalesce(normal_pdf(b), F.lit(0.0))
        return F.coalesce(m["low"] * pa, F.lit(0.0)) + mu * (pb - pa) - sd * (db - da) + F.coalesce(m["high"] * (F.lit(1.0) - pb), F.lit(0.0))

    return _over(m, one)


def mixture_sample(m: Column, *key) -> Column:
    """A draw: component by weight, then normal, then clipped to the bounds."""
    u = uniform(*key, "c") * _sum(m["weights"])
    ends = F.transform(m["weights"], lambda w, i: _sum(F.slice(m["weights"], 1, i + 1)))
    at = F.least(F.size(F.filter(ends, lambda e: e <= u)), F.size(ends) - 1)
    x = F.get(m["means"], at) + F.get(m["stds"], at) * normal(*key)
    return F.least(F.greatest(x, m["low"]), m["high"])


def mixture_valid(m: Column) -> Column:
    n = F.size(m["weights"])
    return F.coalesce((n > 0) & (n == F.size(m["means"])) & (n == F.size(m["stds"])) & (F.abs(_sum(m["weights"]) - 1) <= 1e-4), F.lit(False))


def _np_cdf(z: np.ndarray) -> np.ndarray:
    """normal_cdf for arrays."""
    t = 1 / (1 + CDF_P * np.abs(z))
    tail = np.exp(-z * z / 2) * 0.3989422804014327 * np.polyval((*CDF_B[::-1], 0.0), t)
    return np.where(z >= 0, 1 - tail, tail)


def mixture_quantiles(w: np.ndarray, mu: np.ndarray, sd: np.ndarray, lo: np.ndarray, hi: np.ndarray, q: float) -> np.ndarray:
    """q-quantiles of mixtures (a row each, unused components of weight 0) by 80 bisections of the truncated cdf; nan bounds are open."""
    used = w > 0
    open_lo, open_hi = np.isnan(lo), np.isnan(hi)
    a = np.where(open_lo, np.where(used, mu - 6 * sd, np.inf).min(1), lo)
    b = np.where(open_hi, np.where(used, mu + 6 * sd, -np.inf).max(1), hi)
    if q <= 0 or q >= 1:
        return np.where(open_lo, -np.inf, lo) if q <= 0 else np.where(open_hi, np.inf, hi)

    def cdf(x: np.ndarray) -> np.ndarray:
        return (w * _np_cdf((x[:, None] - mu) / sd)).sum(1)

    c0, c1 = np.where(open_lo, 0.0, cdf(a)), np.where(open_hi, 1.0, cdf(b))
    aim = c0 + q * np.maximum(1e-12, c1 - c0)
    for _ in range(80):
        mid = (a + b) / 2
        below = cdf(mid) < aim
        a, b = np.where(below, mid, a), np.where(below, b, mid)
    return (a + b) / 2


def mixture_quantile(q: float):
    """A pandas UDF: the q-quantile of mixture structs, a batch at once; null without components."""

    def padded(x: pd.Series, width: int, fill: float) -> np.ndarray:
        out = np.full((len(x), width), fill)
        for i, v in enumerate(x):
            out[i, : len(v)] = v
        return out

    @F.pandas_udf("double")
    def quantile(m: pd.DataFrame) -> pd.Series:
        ok = m["weights"].map(lambda v: v is not None and len(v) > 0).to_numpy(bool)
        out, m = np.full(len(m), np.nan), m[ok]
        if len(m):
            width = int(m["weights"].map(len).max())
            w, mu, sd = (padded(m[c], width, x) for c, x in (("weights", 0.0), ("means", 0.0), ("stds", 1.0)))
            out[ok] = mixture_quantiles(w, mu, sd, m["low"].to_numpy(float, na_value=np.nan), m["high"].to_numpy(float, na_value=np.nan), q)
        return pd.Series(out).where(pd.Series(ok), None)

    return quantile


def quantile_at(d: Column, q: Column) -> Column:
    """Value at q: linear between the given quantiles, flat beyond them."""
    below = F.filter(d, lambda x: x["q"] <= q)
    above = F.filter(d, lambda x: x["q"] > q)
    a, b = F.try_element_at(below, F.lit(-1)), F.get(above, F.lit(0))
    between = a["v"] + (b["v"] - a["v"]) * (q - a["q"]) / (b["q"] - a["q"])
    return F.when(F.size(below) == 0, b["v"]).when(F.size(above) == 0, a["v"]).otherwise(between)


def quantile_mean(d: Column) -> Column:
    """Mean of the piecewise linear inverse, flat tails included."""
    n = F.size(d)
    first, last = F.get(d, F.lit(0)), F.try_element_at(d, F.lit(-1))
    inner = F.zip_with(F.slice(d, 1, n - 1), F.slice(d, 2, n - 1), lambda a, b: (b["q"] - a["q"]) * (a["v"] + b["v"]) / 2)
    return first["q"] * first["v"] + _sum(inner) + (F.lit(1.0) - last["q"]) * last["v"]


def quantile_valid(d: Column) -> Column:
    """Keys inside (0, 1) and values that don't fall."""
    keys = F.forall(d, lambda x: (x["q"] > 0) & (x["q"] < 1))
    steps = F.forall(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(d) - 1)), lambda i: F.coalesce(F.get(d, i)["v"] >= F.get(d, i - 1)["v"], F.lit(True)))
    return F.coalesce((F.size(d) > 0) & keys & steps, F.lit(False))


def quantile_sample(d: Column, *key) -> Column:
    return quantile_at(d, uniform(*key))


def lognormal_from_quantiles(p50: Column, p90: Column) -> Column:
    """mu and sigma of the lognormal with these quantiles; null unless 0 < p50 <= p90."""
    ok = (p50 > 0) & (p90 >= p50)
    return F.when(ok, F.struct(F.log(p50).alias("mu"), (F.log(p90 / p50) / 1.2815515655446004).alias("sigma")))


#: An effort payload, either quantiles or a mixture by its type.
PAYLOAD = "struct<type:string,quantiles:map<string,double>,weights:array<double>,means:array<double>,stds:array<double>,low:double,high:double>"


def encode_quantiles(d: Column) -> Column:
    """The JSON payload of a quantile distribution, its keys as text."""
    return F.to_json(F.struct(F.lit("quantiles").alias("type"), F.map_from_arrays(F.transform(d, lambda x: x["q"].cast("string")), F.transform(d, lambda x: x["v"])).alias("quantiles")))


def encode_mixture(m: Column) -> Column:
    """The JSON payload of a mixture; open bounds are left out."""
    return F.to_json(F.struct(F.lit("gmm").alias("type"), *[m[c].alias(c) for c in ("weights", "means", "stds", "low", "high")]))


def decoded(payload: Column) -> Column:
    """A JSON payload as a struct; null if it isn't one."""
    return F.from_json(payload, PAYLOAD)


def payload_quantiles(p: Column) -> Column:
    """The quantile distribution of a decoded payload, sorted by its keys."""
    return F.array_sort(F.transform(F.map_entries(p["quantiles"]), lambda e: F.struct(e["key"].cast("double").alias("q"), e["value"].alias("v"))))


def payload_valid(p: Column) -> Column:
    """Whether a decoded payload is a distribution that can be drawn from."""
    return F.when(p["type"] == "quantiles", quantile_valid(payload_quantiles(p))).when(p["type"] == "gmm", mixture_valid(p)).otherwise(False)


def payload_sample(p: Column, *key) -> Column:
    """A draw from a valid payload."""
    return F.when(p["type"] == "quantiles", quantile_sample(payload_quantiles(p), *key)).otherwise(mixture_sample(p, *key))
