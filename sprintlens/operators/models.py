"""Effort predictors: mixture, quantile and multi-task heads on one small network.

``train_all`` learns from every row: tasks sum gradients over their rows, the sums meet in
two levels, and only sums reach the driver, which takes the step and broadcasts the weights
anew. ``train`` is numpy on the driver over a bounded sample of rows, for quick fits.
Prediction broadcasts the weights and runs in tasks over batches.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import delete, shared_dir

#: At most about so many rows train a model.
SAMPLE = 50_000
LAYERS, COMPONENTS, QUANTILES = (128, 64, 64), 3, (0.1, 0.5, 0.8, 0.9)


def softplus(x):
    return np.logaddexp(0, x)


def _softmax(x):
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def mixture_loss(o: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood of y under the head's mixture, and its gradient by o."""
    k = o.shape[1] // 3
    pi, mu, raw = o[:, :k], o[:, k : 2 * k], o[:, 2 * k :]
    sd = softplus(raw) + 1e-4
    z = (y[:, None] - mu) / sd
    w = _softmax(pi)
    t = np.log(w + 1e-12) - np.log(sd) - 0.5 * z * z - 0.9189385332046727
    r = _softmax(t)
    top = t.max(1)
    loss = -(top + np.log(np.exp(t - top[:, None]).sum(1)))
    g = np.concatenate((w - r, -r * z / sd, -r * (z * z - 1) / sd / (1 + np.exp(-raw))), 1)
    return float(loss.mean()), g / len(y)


def monotone(o: np.ndarray) -> np.ndarray:
    return np.cumsum(softplus(o), 1)


def pinball_loss(o: np.ndarray, y: np.ndarray, quantiles=QUANTILES) -> tuple[float, np.ndarray]:
    q = np.array(quantiles)
    e = y[:, None] - monotone(o)
    loss = np.maximum(q * e, (q - 1) * e)
    d = np.where(e >= 0, -q, 1 - q) / loss.size
    g = np.cumsum(d[:, ::-1], 1)[:, ::-1] / (1 + np.exp(-o))
    return float(loss.mean()), g


@dataclass
class Model:
    """Layers of the trunk, then one linear head a target."""

    heads: dict[str, str]
    weights: dict[str, np.ndarray]
    losses: list[float] = field(default_factory=list)

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        hs = [x]
        for k in range(len(LAYERS)):
            hs.append(np.maximum(0, hs[-1] @ self.weights[f"w{k}"] + self.weights[f"b{k}"]))
        return hs

    def out(self, h: np.ndarray, target: str) -> np.ndarray:
        return h @ self.weights[f"w_{target}"] + self.weights[f"b_{target}"]

    def to_json(self) -> str:
        return json.dumps({"heads": self.heads, "weights": {k: v.tolist() for k, v in self.weights.items()}})

    @staticmethod
    def from_json(text: str) -> Model:
        d = json.loads(text)
        return Model(d["heads"], {k: np.array(v) for k, v in d["weights"].items()})


@dataclass
class Checkpoint:
    """Where a fit's state is kept between epochs: two functions, and after how many epochs it is written."""

    load: Callable[[], str | None]
    save: Callable[[str], None]
    every: int = 5


def _resumed(text: str | None, shapes: dict[str, tuple]) -> dict | None:
    """A kept state, if there is one of these shapes."""
    if not text:
        return None
    d = json.loads(text)
    arrays = {part: {k: np.array(v) for k, v in d[part].items()} for part in ("w", "m", "v")}
    return {**d, **arrays} if {k: a.shape for k, a in arrays["w"].items()} == shapes else None


def _sizes(width: int, heads: dict[str, str], r: np.random.Generator) -> dict[str, np.ndarray]:
    """First weights for inputs of a width."""
    sizes, w = (width, *LAYERS), {}
    for k in range(len(LAYERS)):
        w[f"w{k}"], w[f"b{k}"] = r.standard_normal((sizes[k], sizes[k + 1])) * np.sqrt(2 / max(1, sizes[k])), np.zeros(sizes[k + 1])
    for t, kind in heads.items():
        n = 3 * COMPONENTS if kind == "mdn" else len(QUANTILES)
        w[f"w_{t}"], w[f"b_{t}"] = r.standard_normal((sizes[-1], n)) * np.sqrt(1 / sizes[-1]), r.standard_normal(n) * 0.1
    return w


def gradients(model: Model, x: np.ndarray, ys: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over rows, summed over heads, and its gradient by each weight."""
    hs, w = model.forward(x), model.weights
    g, dh, total = {}, np.zeros_like(hs[-1]), 0.0
    for t, kind in model.heads.items():
        loss, do = (mixture_loss if kind == "mdn" else pinball_loss)(model.out(hs[-1], t), ys[t])
        total += loss
        g[f"w_{t}"], g[f"b_{t}"] = hs[-1].T @ do, do.sum(0)
        dh = dh + do @ w[f"w_{t}"].T
    for k in range(len(LAYERS) - 1, -1, -1):
        dh = dh * (hs[k + 1] > 0)
        g[f"w{k}"], g[f"b{k}"] = hs[k].T @ dh, dh.sum(0)
        dh = dh @ w[f"w{k}"].T
    return total, g


class Adam:
    """A fit's state: weights, moments, steps and losses, kept in a checkpoint and taken up from it."""

    def __init__(self, heads: dict[str, str], w: dict[str, np.ndarray], rate: float, checkpoint: Checkpoint | None):
        self.w, self.rate, self.checkpoint = w, rate, checkpoint
        self.m, self.v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
        self.step, self.losses = 0, []
        if checkpoint and (old := _resumed(checkpoint.load(), {k: a.shape for k, a in w.items()})):
            self.w, self.m, self.v, self.step, self.losses = (old[k] for k in ("w", "m", "v", "step", "losses"))
        self.model = Model(heads, self.w, self.losses)

    def move(self, g: dict[str, np.ndarray]) -> None:
        """A step along a mean gradient, whose norm is clipped."""
        self.step += 1
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        for k, a in g.items():
            a = a * min(1.0, 5 / (norm + 1e-12))
            self.m[k], self.v[k] = 0.9 * self.m[k] + 0.1 * a, 0.999 * self.v[k] + 0.001 * a * a
            self.w[k] -= self.rate * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.999**self.step)) + 1e-8)

    def epoch_ends(self, loss: float, epochs: int) -> None:
        self.losses.append(loss)
        c = self.checkpoint
        if c and (len(self.losses) % c.every == 0 or len(self.losses) == epochs):
            state = {part: {k: a.tolist() for k, a in arrays.items()} for part, arrays in (("w", self.w), ("m", self.m), ("v", self.v))}
            c.save(json.dumps({**state, "step": self.step, "losses": self.losses}))


def fit(x: np.ndarray, ys: dict[str, np.ndarray], heads: dict[str, str], epochs: int = 60, batch: int = 512, rate: float = 1e-3, seed: int = 0, checkpoint: Checkpoint | None = None) -> Model:
    """Adam over minibatches with a clipped norm; the losses of all heads are summed.

    An epoch's order depends on seed and epoch alone, so a fit that is resumed from a
    checkpoint ends where one without a break would."""
    a = Adam(heads, _sizes(x.shape[1], heads, np.random.default_rng(seed)), rate, checkpoint)
    for epoch in range(len(a.losses), epochs):
        order, total = np.random.default_rng((seed, epoch)).permutation(len(x)), 0.0
        for i in range(0, len(x), batch):
            at = order[i : i + batch]
            loss, g = gradients(a.model, x[at], {t: y[at] for t, y in ys.items()})
            total += loss * len(at)
            a.move(g)
        a.epoch_ends(total / max(1, len(x)), epochs)
    return a.model


def train(rows: DataFrame, heads: dict[str, str], sample: int = SAMPLE, **options) -> Model:
    """Fits on about ``sample`` rows (id, x, targets) drawn by a hash of the id."""
    n = rows.count()
    if n > sample:
        rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    got = rows.select("id", "x", *[F.col(t).cast("double") for t in heads]).toArrow().sort_by("id")
    return fit(_matrix(got.column("x").combine_chunks()), {t: got.column(t).to_numpy() for t in heads}, heads, **options)


def _matrix(x: pa.ListArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(x), len(flat) // len(x) if len(x) else 0)


def _packed(loss: float, n: int, g: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([[loss, n], *[g[k].ravel() for k in sorted(g)]])


def _unpacked(v: np.ndarray, like: dict[str, np.ndarray]) -> tuple[float, float, dict[str, np.ndarray]]:
    out, at = {}, 2
    for k in sorted(like):
        out[k] = v[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return v[0], v[1], out


def _added(values: Iterator[bytes]) -> np.ndarray | None:
    total = None
    for b in values:
        v = np.frombuffer(b)
        total = v.copy() if total is None else np.add(total, v, out=total)
    return total


def _sums(rows: DataFrame, model: Model) -> np.ndarray | None:
    """Loss, number and gradient sums over rows (x, targets): a task adds up its rows, then about the square root of the tasks meet at a time."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    targets = list(model.heads)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, total = shared.value, None
        for b in batches:
            if b.num_rows:
                loss, g = gradients(net, _matrix(b.column(0)), {t: b.column(1 + k).to_numpy(zero_copy_only=False) for k, t in enumerate(targets)})
                v = _packed(loss, 1, g) * b.num_rows
                total = v if total is None else np.add(total, v, out=total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def meet(t: pa.Table) -> pa.Table:
        return pa.table({"sums": pa.array([_added(t.column("sums").to_pylist()).tobytes()], pa.binary())})

    parts = rows.select("x", *[F.col(t).cast("double").alias(t) for t in targets]).mapInArrow(task, "sums binary")
    tasks = rows.rdd.getNumPartitions()
    if tasks > MEET:
        parts = parts.withColumn("k", F.pmod(F.spark_partition_id(), F.lit(math.isqrt(tasks)))).groupBy("k").applyInArrow(lambda t: meet(t.select(["sums"])), "sums binary")
    try:
        return _added(r["sums"] for r in parts.collect())
    finally:
        shared.destroy()


#: Up to so many tasks send their sums to the driver themselves.
MEET = 64


def train_all(rows: DataFrame, heads: dict[str, str], epochs: int = 60, steps: int = 1, rate: float = 1e-3, seed: int = 0, checkpoint: Checkpoint | None = None) -> Model:
    """Fits on all rows (id, x, targets), data-parallel: ``steps`` steps an epoch, each over the rows of one hash class of the id.

    The rows are written once, a folder a class, and read by every epoch; no row reaches the
    driver. A step's gradient is the mean over its rows, whatever the partitions. Ids may
    repeat; rows of one id fall into one class."""
    spark, at = rows.sparkSession, shared_dir(rows.sparkSession, "training")
    first = rows.select(F.size("x").alias("n")).first()
    a = Adam(heads, _sizes(first["n"] if first else 0, heads, np.random.default_rng(seed)), rate, checkpoint)
    if first is None or len(a.losses) >= epochs:
        return a.model
    classes = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(steps)).cast("int").alias("class")
    rows.select("x", *heads, classes).write.partitionBy("class").parquet(at)
    own = spark.read.parquet(at)
    try:
        for _ in range(len(a.losses), epochs):
            total = n = 0.0
            for k in range(steps):
                if (v := _sums(own.filter(F.col("class") == k), a.model)) is not None:
                    loss, count, g = _unpacked(v, a.w)
                    a.move({key: x / count for key, x in g.items()})
                    total, n = total + loss, n + count
            a.epoch_ends(total / n, epochs)
    finally:
        delete(spark, at)
    return a.model


MIXTURE = "struct<weights:array<double>,means:array<double>,stds:array<double>,low:double,high:double>"


def predict(rows: DataFrame, model: Model) -> DataFrame:
    """id and a distribution column a head: <target>_mdn structs or <target>_quantile arrays."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shared.value
        for f in frames:
            h = net.forward(np.array(f["x"].tolist(), float).reshape(len(f), -1))[-1] if len(f) else np.zeros((0, LAYERS[-1]))
            cols = {"id": f["id"]}
            for t, kind in net.heads.items():
                o = net.out(h, t)
                if kind == "mdn":
                    w, mu, sd = _softmax(o[:, :COMPONENTS]), o[:, COMPONENTS : 2 * COMPONENTS], softplus(o[:, 2 * COMPONENTS :]) + 1e-4
                    cols[f"{t}_mdn"] = [{"weights": a, "means": b, "stds": c, "low": 0.0, "high": 1.0} for a, b, c in zip(w.tolist(), mu.tolist(), sd.tolist(), strict=True)]
                else:
                    cols[f"{t}_quantile"] = [[{"q": q, "v": x} for q, x in zip(QUANTILES, row, strict=True)] for row in monotone(o).tolist()]
            yield pd.DataFrame(cols)

    kinds = [f"{t}_mdn {MIXTURE}" if k == "mdn" else f"{t}_quantile array<struct<q:double,v:double>>" for t, k in model.heads.items()]
    return rows.select("id", "x").mapInPandas(task, ", ".join([f"id {rows.schema['id'].dataType.simpleString()}", *kinds]))
