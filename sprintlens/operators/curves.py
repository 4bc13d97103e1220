"""Coding-probability curves of authors on a grid of time steps, and draws from them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rng import below, mark, normal, stem
from ..functions.scalars import minute

STEP, MIN_MINUTES = 5, 50
#: Authors that are fitted in one numpy batch, the steps of their chains, and the steps of the curves that a task gives out at a time.
TOGETHER, STEPS, GIVEN = 64, 1 << 17, 1 << 18


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key over at least all cores: few rows, but much work on each."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, key)


def grids(commits: DataFrame, step: int = STEP, min_minutes: int = MIN_MINUTES, span_extra: int = 1) -> DataFrame:
    """author_id, base_minute, n_minutes, steps, met (structs at, k of the steps that have any) and counts (one a step) of authors with enough distinct minutes.

    Kernels get met, which is as long as the history, and make the dense array in their task. A distinct minute counts once; the array is dense but no empty step is ever a row. span_extra tells the two grid lengths apart: 1 for the
    point-process models, 0 for the hidden Markov model."""
    m = commits.select("author_id", minute(F.col("authored_at")).alias("m")).distinct()
    own = Window.partitionBy("author_id")
    m = m.select("author_id", "m", F.min("m").over(own).alias("base_minute"), F.max("m").over(own).alias("last"), F.count(F.lit(1)).over(own).alias("n_minutes"))
    span = F.greatest(F.lit(1), F.col("last") - F.col("base_minute")) if span_extra == 0 else F.col("last") - F.col("base_minute") + span_extra
    at = F.floor((F.col("m") - F.col("base_minute")) / step).cast("int")
    m = m.filter(F.col("n_minutes") >= min_minutes).withColumns({"steps": (F.ceil(span / step) + 1).cast("int"), "at": at})
    n = m.groupBy("author_id", "base_minute", "n_minutes", "steps", "at").agg(F.count(F.lit(1)).cast("int").alias("k"))
    g = n.groupBy("author_id", "base_minute", "n_minutes", "steps").agg(F.array_sort(F.collect_list(F.struct("at", "k"))).alias("met"))
    # the zeros since the last met step, then its count; the zeros after the last one
    runs = F.transform("met", lambda x, i: F.concat(F.array_repeat(F.lit(0), x["at"] - F.coalesce(F.get("met", i - 1)["at"], F.lit(-1)) - 1), F.array(x["k"])))
    tail = F.array_repeat(F.lit(0), F.col("steps") - 1 - F.try_element_at("met", F.lit(-1))["at"])
    return g.select("author_id", "base_minute", "n_minutes", "steps", "met", F.concat(F.flatten(runs), tail).alias("counts"))


def slice_bounds(a: Column, b: Column, base: Column, step: int, length: Column) -> tuple[Column, Column]:
    """First step and number of steps of [a, b) on a curve, both ends clamped to it."""

    def at(m: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.floor((m - base) / step), length - 1)).cast("int")

    i, j = at(F.least(a, b)), at(F.greatest(a, b))
    return i, j - i


#: Slices of up to so many steps are drawn coin by coin.
COINS = 256


#: Pairs of an author that lie in one row at most.
BLOCK = 1 << 16


def _let(value: Column, fn) -> Column:
    """fn(value), where value is worked out once however often fn names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def pair_slices(pairs: DataFrame, curves: DataFrame, step: int, prob: Column | None = None, parts: bool = True) -> DataFrame:
    """The pairs of authors with a curve (author_id, base_minute and what prob, by default coding_prob, is made of), with first, n, mean and var of their minutes, and part.

    An author's pairs meet the curve as a list, BLOCK pairs a row, so a curve is shuffled as
    what prob is made of, is there once for all of them and leaves with none. Pairs of
    neighbouring commits share no step: summing their slices is linear in the curve. part, the
    slice itself, is there for up to COINS steps only, and not at all without parts."""
    kept = [c for c in pairs.columns if c != "author_id"]
    block = F.floor(F.monotonically_increasing_id() / BLOCK).alias("block")
    lists = spread(pairs, "author_id").select("author_id", block, F.struct(*kept).alias("pair")).groupBy("author_id", "block").agg(F.collect_list("pair").alias("pairs"))
    prob = F.col("coding_prob") if prob is None else prob

    def met(curve: Column) -> Column:
        def found(pair: Column) -> Column:
            first, n = slice_bounds(pair["parent_minute"], pair["child_minute"], F.col("base_minute"), step, F.size(curve))

            def summed(at: Column) -> Column:
                own = F.slice(curve, at["first"] + 1, F.greatest(F.lit(0), at["n"]))
                total = lambda f: F.aggregate(own, F.lit(0.0), lambda s, p: s + f(p))
                out = [at["first"].alias("first"), at["n"].alias("n"), (total(lambda p: p) * step).alias("mean"), (total(lambda p: p * (1 - p)) * (step * step)).alias("var")]
                return F.struct(pair.alias("pair"), *out, *([F.when(at["n"].between(1, COINS), own).alias("part")] if parts else []))

            return _let(F.struct(first.alias("first"), n.alias("n")), summed)

        return F.transform("pairs", found)

    out = lists.join(curves, "author_id").select("author_id", F.explode(_let(prob, met)).alias("s"))
    own = ["first", "n", "mean", "var", *(["part"] if parts else [])]
    return out.select(*[F.col(c) if c == "author_id" else F.col(f"s.pair.{c}").alias(c) for c in pairs.columns], *[f"s.{c}" for c in own])


def sample_minutes(step: int, gap: Column, samples: int, *key) -> Column:
    """Draws 0 to samples - 1 of coding minutes for a row of pair_slices: a coin a step up to COINS steps, beyond that a clipped normal."""

    def coins(marks: Column) -> Column:
        def draw(k: Column) -> Column:
            bell = F.greatest(F.lit(0.0), F.least(gap, F.col("mean") + F.sqrt(F.greatest(F.lit(0.0), F.col("var"))) * normal(*key, k)))
            hits = _let(stem(*key, k), lambda s: F.size(F.filter(marks, lambda m, i: below(m, s, i))))
            return F.when(F.col("n") <= 0, F.lit(0.0)).when(F.col("n") <= COINS, hits * float(step)).otherwise(bell)

        return F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), draw)

    return _let(F.transform("part", mark), coins)


# -- kernels over whole curves: linear in the steps, in batches of authors ------------


def scan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with x[i] = a[i] * x[i-1] + b[i]: blocks side by side, then carried from block to block, about 2 sqrt(n) vector steps."""
    n = len(a)
    w = max(1, math.isqrt(max(0, n - 1)) + 1)
    a, b = (np.concatenate((v, np.zeros(w * w - n))).reshape(w, w) for v in (a, b))
    x, p = np.empty((w, w)), np.empty((w, w))
    at, through = np.zeros(w), np.ones(w)
    for j in range(w):
        at, through = a[:, j] * at + b[:, j], through * a[:, j]
        x[:, j], p[:, j] = at, through
    carry = 0.0
    for k in range(w):
        x[k] += p[k] * carry
        carry = x[k, -1]
    return x.ravel()[:n]


def ekf(counts: np.ndarray, step: int, process_var: float = 0.05) -> np.ndarray:
    """Filtered log intensities of an extended Kalman filter over Poisson counts."""
    m, p, dt, out = 0.0, 1.0, float(step), []
    for y in counts.tolist():
        p += process_var
        lam = math.exp(m) * dt
        gain = p * lam / max(1e-12, lam * p * lam + max(1e-6, lam))
        m += gain * (y - lam)
        p *= 1 - gain * lam
        out.append(m)
    return np.array(out)


def _above(x: np.ndarray, base: float) -> np.ndarray:
    """Probability from the part of an intensity above its base."""
    return 1 - np.exp(-np.maximum(0.0, x - base) / max(1e-6, base))


def dense(steps: int, at: np.ndarray, k: np.ndarray) -> np.ndarray:
    y = np.zeros(steps)
    y[at] = k
    return y


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    def column(values, kind: pa.DataType) -> pa.Array:
        if not pa.types.is_list(kind):
            return pa.array(values, kind)
        return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32), pa.array(np.concatenate(values), kind.value_type))

    return pa.RecordBatch.from_arrays([column(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _mapped(grid: DataFrame, fn, schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """fn over the rows of a grid, dealt by author: bunches of (author_id, base_minute, steps, at, k) become rows of the schema, which carry's columns follow.

    A bunch is up to TOGETHER authors of like length, whose padded steps are up to STEPS if
    they are several. What leaves a task holds about GIVEN values at a time, so that its memory
    grows with neither the number of authors nor all their curves."""
    names = {x.strip().split(" ")[0]: x.strip().split(" ")[1] for x in schema.split(",")}
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}
    met = F.col("met") if "met" in grid.columns else F.filter(F.transform("counts", lambda k, i: F.struct(i.alias("at"), k.alias("k"))), lambda x: x["k"] > 0)
    steps = F.col("steps") if "steps" in grid.columns else F.size("counts")
    rows = grid.select("author_id", "base_minute", steps.alias("steps"), F.transform(met, lambda x: x["at"]).alias("at"), F.transform(met, lambda x: x["k"]).alias("k"), *carry)
    arrow = pa.schema([(n, kinds[k]) for n, k in names.items()])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column(2).to_numpy()
            order, out, held, i = np.argsort(size, kind="stable"), [], 0, 0

            def given(out=out, b=b):
                done = _batch([row for _, row in out], arrow)
                more = b.take(pa.array([j for j, _ in out])) if carry else b
                return pa.RecordBatch.from_arrays([*done.columns, *(more.column(5 + c) for c in range(len(carry)))], names=[*names, *carry])

            while i < len(order):
                n = 1
                while n < TOGETHER and i + n < len(order) and (n + 1) * size[order[i + n]] <= STEPS:
                    n += 1
                own = order[i : i + n]
                i += n
                bunch = [(b.column(0)[j].as_py(), b.column(1)[j].as_py(), int(size[j]), *(np.asarray(b.column(c)[j].values) for c in (3, 4))) for j in own.tolist()]
                for j, row in zip(own.tolist(), fn(bunch), strict=True):
                    out.append((j, row))
                    held += int(size[j])
                    if held >= GIVEN:
                        yield given()
                        held = 0
                        out.clear()
            if out:
                yield given()

    types = dict(rows.dtypes)
    return spread(rows, "author_id").mapInArrow(task, ", ".join([schema, *(f"{c} {types[c]}" for c in carry)]))


def filtered(grid: DataFrame, step: int = STEP, process_var: float = 0.05, carry: tuple[str, ...] = ()) -> DataFrame:
    """author_id, base_minute, steps, last (log intensity), baseline (its 20 % quantile as intensity, at least 1e-6) and coding_prob by the filter."""

    def fits(bunch: list[tuple]) -> Iterator[tuple]:
        for author, base, steps, at, k in bunch:
            m = ekf(dense(steps, at, k), step, process_var)
            x = np.exp(m)
            low = max(1e-6, float(np.quantile(x, 0.2)))
            yield author, base, len(m), float(m[-1]), low, _above(x, low)

    return _mapped(grid, fits, "author_id bigint, base_minute bigint, steps int, last double, baseline double, coding_prob array<double>", carry)


def excited(grid: DataFrame, mu: float, alpha: float, beta: float, step: int = STEP) -> DataFrame:
    """author_id, base_minute, steps and coding_prob from a decaying sum of counts (intensity above its base)."""

    def curves(bunch: list[tuple]) -> Iterator[tuple]:
        for author, base, steps, at, k in bunch:
            g = scan(np.full(steps, math.exp(-beta * step)), dense(steps, at, k))
            yield author, base, steps, 1 - np.exp(-np.minimum(700.0, alpha * g / max(1e-6, mu)))

    return _mapped(grid, curves, "author_id bigint, base_minute bigint, steps int, coding_prob array<double>")


def with_sums(curves: DataFrame) -> DataFrame:
    """author_id, base_minute, coding_prob, and running sums of p and p (1 - p) with a 0 in front, for look-ups at any two steps."""
    schema = "author_id bigint, base_minute bigint, coding_prob array<double>, mean_sums array<double>, var_sums array<double>"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            p = np.asarray(row.column(2)[0].values, float)
            sums = [pa.array([np.concatenate(([0.0], np.cumsum(x)))], pa.list_(pa.float64())) for x in (p, p * (1 - p))]
            yield pa.RecordBatch.from_arrays([*row.columns, *sums], names=["author_id", "base_minute", "coding_prob", "mean_sums", "var_sums"])

    return spread(curves.select("author_id", "base_minute", "coding_prob"), "author_id").mapInArrow(task, schema)


# -- fitted models: one author a group, numpy inside ---------------------------------


def hawkes_fit(times: list[np.ndarray], horizons: list[float], iterations: int = 200) -> list[np.ndarray]:
    """mu, alpha, beta and log likelihood of exponential-kernel processes by expectation maximisation, an array each.

    The kernel is alpha * exp(-beta * t); see Veen and Schoenberg (2008). Pair weights of
    all earlier events come from two linear recursions. The processes lie one after the
    other in one array, a recursion's factor being 0 at each first event, so that a round is
    a few vector steps for all of them."""
    sizes = np.array([len(t) for t in times])
    own = np.repeat(np.arange(len(times)), sizes)
    at, ends = np.concatenate(times), np.maximum(1e-9, np.array(horizons, float))
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    gaps = np.concatenate(([0.0], np.diff(at)))
    gaps[first] = 0.0
    inner = np.ones(len(at))
    inner[first] = 0.0

    def total(x: np.ndarray) -> np.ndarray:
        return np.bincount(own, x, len(times))

    def kernel(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = inner * np.exp(-beta[own] * gaps)
        return f, scan(f, f)  # the kernel's sum over earlier events

    mu, alpha, beta = sizes / ends / 2, sizes / ends / 2, np.ones(len(times))
    for _ in range(iterations):
        f, g = kernel(beta)
        earlier = np.concatenate(([0.0], g[:-1]))
        d = scan(f, f * gaps * (1 + earlier))  # the same, weighted by age
        lam = mu[own] + alpha[own] * g
        kids, age = total(alpha[own] * g / lam), total(alpha[own] * d / lam)
        tail = total(1 - np.exp(-beta[own] * (ends[own] - at)))
        mu = np.maximum(1e-12, total(mu[own] / lam) / ends)
        beta = np.clip(kids / np.maximum(1e-12, age), 1e-6, 50.0)
        alpha = np.maximum(1e-12, kids / np.maximum(1e-12, tail) * beta)
    lam = mu[own] + alpha[own] * kernel(beta)[1]
    tail = total(1 - np.exp(-beta[own] * (ends[own] - at)))
    ll = total(np.log(np.maximum(1e-12, lam))) - mu * ends - alpha / beta * tail
    return [mu, alpha, beta, ll]


def time_features(base: int, steps: int, step: int) -> np.ndarray:
    """Sines and cosines of day and week, and the place in the series, of each step."""
    sec = (base + np.arange(steps) * step) * 60.0
    day, week = 2 * np.pi * (sec % 86400) / 86400, 2 * np.pi * (sec % 604800) / 604800
    return np.stack([np.sin(day), np.cos(day), np.sin(week), np.cos(week), np.arange(steps) / max(1, steps - 1)], 1)


def _runs(m: np.ndarray, back: bool = False) -> np.ndarray:
    """Products of 2x2 matrices (4, chain, step) from the start of each block up to each step, or from each step to its block's end.

    All blocks of all chains move together, about sqrt(steps) vector steps. Products are
    scaled to a greatest entry of 1: they give directions. Result: (4, chain, block, step)."""
    _, k, n = m.shape
    w = max(1, math.isqrt(max(0, n - 1)) + 1)
    blocks = -(-n // w)
    padded = np.zeros((4, k, blocks * w))
    padded[[0, 3]] = 1.0
    padded[:, :, :n] = m
    m = np.ascontiguousarray(padded.reshape(4, k, blocks, w).transpose(3, 0, 1, 2))
    out = np.empty_like(m)
    at = m[w - 1 if back else 0].copy()
    for j in range(w - 1, -1, -1) if back else range(w):
        if j != (w - 1 if back else 0):
            (a, b, c, d), (e, f, g, h) = (m[j], at) if back else (at, m[j])
            at = np.stack((a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h))
        at = at / at.max(0)
        out[j] = at
    return out.transpose(1, 2, 3, 0)


def hmm_forward(y: np.ndarray, s: np.ndarray, e: np.ndarray, c: np.ndarray, lengths: np.ndarray, eps: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihoods, posteriors of coding and expected transitions of many two-state chains at once.

    Arrays are (chain, step), padded after each chain's length. State 0 codes and commits
    with probability c; s and e are the chances to start and to end coding at each step.
    A step is a 2x2 matrix, so both recursions are products of matrices: scanned inside
    blocks, carried from block to block, and applied to all steps at once. Directions are
    enough, as scaled forward vectors sum to 1, and so do their products with the backward
    ones. Padding passes states on unchanged."""
    k, n = y.shape
    inside = np.arange(n) < lengths[:, None]
    b = np.stack([np.where(y > 0, c[:, None], 1 - c[:, None]), np.where(y > 0, eps, 1 - eps)], 2)
    b[~inside] = 1.0
    goes = np.arange(n) < lengths[:, None] - 1
    a = np.empty((k, n, 2, 2))
    a[..., 0, 0], a[..., 0, 1], a[..., 1, 0], a[..., 1, 1] = 1 - e, e, s, 1 - s
    a[~goes] = np.eye(2)
    step = (a[:, :-1] * b[:, 1:, None, :]).reshape(k, n - 1, 4).transpose(2, 0, 1)  # from each step to the next one

    first = 0.5 * b[:, 0]
    f = np.empty((k, n, 2))
    f[:, 0] = first / first.sum(1, keepdims=True)
    if n > 1:
        p = _runs(step)
        cur, at = f[:, 0], np.empty((*p.shape[1:], 2))
        for j in range(p.shape[2]):
            x, z = cur[:, :1], cur[:, 1:]
            v = np.stack((x * p[0, :, j] + z * p[2, :, j], x * p[1, :, j] + z * p[3, :, j]), 2)
            at[:, j] = v / v.sum(2, keepdims=True)
            cur = at[:, j, -1]
        f[:, 1:] = at.reshape(k, -1, 2)[:, : n - 1]
    scale = np.empty((k, n))
    scale[:, 0] = first.sum(1)
    scale[:, 1:] = f[:, :-1, 0] * (step[0] + step[1]) + f[:, :-1, 1] * (step[2] + step[3])

    back = np.ones((k, n, 2))
    if n > 1:
        q = _runs(step, back=True)
        cur, at = np.ones((k, 2)), np.empty((*q.shape[1:], 2))
        for j in range(q.shape[2] - 1, -1, -1):
            x, z = cur[:, :1], cur[:, 1:]
            v = np.stack((q[0, :, j] * x + q[1, :, j] * z, q[2, :, j] * x + q[3, :, j] * z), 2)
            at[:, j] = v / v.max(2, keepdims=True)
            cur = at[:, j, 0]
        back[:, :-1] = at.reshape(k, -1, 2)[:, : n - 1]
        back[:, :-1] /= (f[:, :-1] * back[:, :-1]).sum(2, keepdims=True)
    gamma = f * back
    moves = f[:, :-1, :, None] * a[:, :-1] * (b[:, 1:] * back[:, 1:])[:, :, None, :] / scale[:, 1:, None, None]
    moves[~goes[:, :-1]] = 0.0
    return np.log(scale).sum(1), gamma, moves


def hmm_fit(ys: list[np.ndarray], bases: list[int], step: int, epochs: int = 60, hidden: int = 8, rate: float = 0.02, seed: int = 0) -> tuple[np.ndarray, list[np.ndarray]]:
    """Log likelihood and coding probabilities of each chain, with a small transition net of its own over time features.

    Fisher's identity turns posteriors into the likelihood's gradient, so each epoch is one
    forward-backward pass and one pass through the nets, with Adam and a clipped norm. All
    chains move together; each starts from the same draws, so company doesn't matter."""
    k, lengths = len(ys), np.array([len(y) for y in ys])
    n = int(lengths.max())
    y, x = np.zeros((k, n)), np.zeros((k, n, 5))
    for i, (v, base) in enumerate(zip(ys, bases, strict=True)):
        y[i, : len(v)], x[i, : len(v)] = v, time_features(base, len(v), step)
    inside = (np.arange(n) < lengths[:, None])[..., None]
    r = np.random.default_rng(seed)
    shapes = {"w1": (5, hidden), "b1": (1, hidden), "w2": (hidden, hidden), "b2": (1, hidden), "w3": (hidden, 2), "b3": (1, 2), "c": (1, 1)}
    p = {q: np.repeat((r.standard_normal(v) * (v[0] ** -0.5 if q[0] == "w" else 0.0))[None], k, 0) for q, v in shapes.items()}
    p["b3"] += np.array([-3.0, -2.0])
    m, v = ({q: np.zeros_like(a) for q, a in p.items()} for _ in range(2))

    def chances():
        h1 = np.tanh(x @ p["w1"] + p["b1"])
        h2 = np.tanh(h1 @ p["w2"] + p["b2"])
        o = np.clip(1 / (1 + np.exp(-(h2 @ p["w3"] + p["b3"]))), 1e-6, 1 - 1e-6)
        return h1, h2, o, np.clip(1 / (1 + np.exp(-p["c"][:, 0, 0])), 1e-6, 1 - 1e-6)

    def turned(a):
        return np.swapaxes(a, 1, 2)

    for t in range(1, epochs + 1):
        h1, h2, o, c = chances()
        _, gamma, moves = hmm_forward(y, o[..., 0], o[..., 1], c, lengths)
        do = np.zeros_like(o)
        do[:, :-1, 0] = moves[..., 1, 0] - o[:, :-1, 0] * (moves[..., 1, 0] + moves[..., 1, 1])
        do[:, :-1, 1] = moves[..., 0, 1] - o[:, :-1, 1] * (moves[..., 0, 0] + moves[..., 0, 1])
        d2 = (do @ turned(p["w3"])) * (1 - h2**2)
        d1 = (d2 @ turned(p["w2"])) * (1 - h1**2)
        g = {
            "w3": turned(h2) @ do, "b3": do.sum(1, keepdims=True), "w2": turned(h1) @ d2, "b2": d2.sum(1, keepdims=True), "w1": turned(x) @ d1, "b1": d1.sum(1, keepdims=True),
            "c": (gamma[..., :1] * (y[..., None] - c[:, None, None]) * inside).sum(1, keepdims=True),
        }
        norm = np.sqrt(sum((q * q).sum((1, 2)) for q in g.values()))
        clip = np.minimum(1.0, 5 / (norm + 1e-9))[:, None, None]
        for q in p:
            d = g[q] * clip
            m[q], v[q] = 0.9 * m[q] + 0.1 * d, 0.999 * v[q] + 0.001 * d * d
            p[q] = p[q] + rate * (m[q] / (1 - 0.9**t)) / (np.sqrt(v[q] / (1 - 0.999**t)) + 1e-8)
    _, _, o, c = chances()
    ll, gamma, _ = hmm_forward(y, o[..., 0], o[..., 1], c, lengths)
    return ll, [gamma[i, :q, 0] for i, q in enumerate(lengths)]


def fitted(grid: DataFrame, model: str, step: int = STEP, carry: tuple[str, ...] = (), **options) -> DataFrame:
    """author_id, base_minute, step_minutes, coding_prob, mu, alpha, beta, log_likelihood, model_version by grouped fits.

    One row an author comes in, so authors are dealt over tasks and fitted in bunches."""

    def hawkes(bunch: list[tuple]) -> Iterator[tuple]:
        times = [np.repeat(at, k) * float(step) for _, _, _, at, k in bunch]
        values = hawkes_fit(times, [max(1.0, float((steps - 1) * step)) for _, _, steps, _, _ in bunch], **options)
        for (a, base, steps, at, k), mu, alpha, beta, ll in zip(bunch, *(v.tolist() for v in values), strict=True):
            g = scan(np.full(steps, math.exp(-beta * step)), dense(steps, at, k))
            yield a, base, step, 1 - np.exp(-np.minimum(700.0, alpha * g / max(1e-6, mu))), mu, alpha, beta, ll, "hawkes"

    def hmm(bunch: list[tuple]) -> Iterator[tuple]:
        ys = [dense(steps, at, np.minimum(k, 1)) for _, _, steps, at, k in bunch]
        ll, probs = hmm_fit(ys, [base for _, base, _, _, _ in bunch], step, **options)
        for (a, base, _, _, _), x, p in zip(bunch, ll.tolist(), probs, strict=True):
            yield a, base, step, p, None, None, None, x, "hmm"

    schema = "author_id bigint, base_minute bigint, step_minutes int, coding_prob array<double>, mu double, alpha double, beta double, log_likelihood double, model_version string"
    return _mapped(grid, hawkes if model == "hawkes" else hmm, schema, carry)
