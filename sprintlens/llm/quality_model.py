"""Quality classifier: a generalised additive model with pairwise interactions.

Features are ratios of the whole text. They are cut into quantile bins, and one lookup
table a feature is learnt by cyclic boosting: round after round each feature in turn gets a
two-cut tree over its bins, fitted to the residual by Newton steps and added at a small
rate. Then the pairs that explain most of the rest get tables of their own from trees with
one cut a side. A score is the sigmoid of summed table entries, so scoring is bin look-ups
and additions over whole batches.

Labels come from at most ``BOUND`` documents a class. Null and empty texts have all-zero
features and a score like any other text. Without labels of both classes the score is the
share of label 1, or one half. Rows that repeat a doc_id are scored each. Only ``doc_id``
and ``text`` of the documents are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_table, table
from .quality_rules import STOP_WORDS
from .sampling import bucket, labelled

BOUND, BINS, ROUNDS, RATE, PAIRS, PAIR_ROUNDS = 8000, 32, 120, 0.1, 6, 40
FOLDS, HELD_OUT, CUTOFF = 5, 0, 0.3

_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_SYMBOL = b"#*$%&|<>"
_MARK = b"!?"
_STOP = frozenset(w.encode() for w in STOP_WORDS.split())

FEATURES = (
    "log_words", "word_bytes", "upper", "digits", "symbols", "marks", "bars", "stop_words", "distinct",
    "same_as_previous", "top_word", "lines", "dup_lines", "sentences", "distinct_triples",
)


def features(text: str | None) -> tuple[float, ...]:
    """The text's values of FEATURES."""
    b = (text or "").encode()
    w = b.split()
    n = len(w)
    if not n:
        return (0.0,) * len(FEATURES)
    size = len(b)
    left = [size - len(b.translate(None, cs)) for cs in (_UPPER, _DIGIT, _SYMBOL, _MARK, b"|")]
    low = b.lower().split()
    counts: dict[bytes, int] = {}
    for x in low:
        counts[x] = counts.get(x, 0) + 1
    lines = [x for x in b.split(b"\n") if x.strip()]
    return (
        np.log1p(n),
        sum(map(len, w)) / n,
        left[0] / size,
        left[1] / size,
        left[2] / n,
        left[3] / n,
        left[4] / n,
        sum(c for x, c in counts.items() if x in _STOP) / n,
        len(counts) / n,
        sum(map(eq, low, low[1:])) / n,
        max(counts.values()) / n,
        len(lines) / n,
        1 - len(set(lines)) / len(lines),
        (b.count(b". ") + b.count(b".\n") + 1) / n,
        len(set(zip(low, low[1:], low[2:], strict=False))) / n,
    )


@dataclass
class AdditiveModel:
    """Lookup tables over binned features and over pairs of them."""

    cuts: list[np.ndarray]
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)], 1)

    def margin(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.intercept)
        for k, t in enumerate(self.tables):
            out += t[b[:, k]]
        for (i, j), t in self.pairs.items():
            out += t[b[:, i], b[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(self.binned(x))))


_RIDGE = 1.0


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + _RIDGE)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A step for each bin: the best two cuts of the bins' gradient and hessian sums."""
    n = len(g)
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    i, j = np.triu_indices(n + 1)
    parts = _gain(cg[i], ch[i]) + _gain(cg[j] - cg[i], ch[j] - ch[i]) + _gain(cg[n] - cg[j], ch[n] - ch[j])
    k = int(np.argmax(parts))
    out = np.empty(n)
    for a, b in ((0, i[k]), (i[k], j[k]), (j[k], n)):
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + _RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A step for each cell of a pair's table from the best cut of each side, and its gain."""
    cg, ch = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (g, h))

    def corner(c):
        a, right, below = c[1:-1, 1:-1], c[1:-1, -1:], c[-1:, 1:-1]
        return a, right - a, below - a, c[-1, -1] - right - below + a

    parts_g, parts_h = corner(cg), corner(ch)
    gain = sum(_gain(x, y) for x, y in zip(parts_g, parts_h, strict=True))
    out = np.zeros_like(g)
    if not gain.size:
        return out, 0.0
    a, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    value = [-x[a, b] / (y[a, b] + _RIDGE) for x, y in zip(parts_g, parts_h, strict=True)]
    out[: a + 1, : b + 1], out[: a + 1, b + 1 :], out[a + 1 :, : b + 1], out[a + 1 :, b + 1 :] = value
    return out, float(gain[a, b] - _gain(g.sum(), h.sum()))


def fit(x: np.ndarray, y: np.ndarray, bins: int = BINS, rounds: int = ROUNDS, rate: float = RATE, pairs: int = PAIRS, pair_rounds: int = PAIR_ROUNDS) -> AdditiveModel:
    """The model of labels y (0 or 1) on the rows of x."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0) for k in range(x.shape[1])]
    model = AdditiveModel(cuts)
    share = y.mean() if len(y) else 0.5
    if not 0 < share < 1:
        model.intercept = float(np.log((share + 0.01) / (1.01 - share))) if len(y) else 0.0
        return model
    model.intercept = float(np.log(share / (1 - share)))
    b = model.binned(x)
    sizes = [len(c) + 1 for c in cuts]
    model.tables = [np.zeros(s) for s in sizes]
    m = model.margin(b)

    def slopes():
        p = 1 / (1 + np.exp(-m))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for k, s in enumerate(sizes):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, k], g, s), np.bincount(b[:, k], h, s))
            model.tables[k] += step
            m += step[b[:, k]]

    cell = {(i, j): b[:, i] * sizes[j] + b[:, j] for i, j in combinations(range(len(sizes)), 2)}

    def sums(p, g, h):
        shape = sizes[p[0]], sizes[p[1]]
        return (np.bincount(cell[p], v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    g, h = slopes()
    best = sorted(cell, key=lambda p: -_quadrants(*sums(p, g, h))[1])[:pairs]
    model.pairs = {p: np.zeros((sizes[p[0]], sizes[p[1]])) for p in best}
    for _ in range(pair_rounds):
        for p in best:
            g, h = slopes()
            step = rate * _quadrants(*sums(p, g, h))[0]
            model.pairs[p] += step
            m += step.ravel()[cell[p]]
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [list(features(t)) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64())), b.column(2)], ["doc_id", "x", "y"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", usable=None, bound: int = BOUND) -> AdditiveModel:
    """Fits on a sample of at most about ``bound`` labelled documents a class; only features reach the driver."""
    usable = F.lit(True) if usable is None else usable
    rows = labelled(docs, labels, label, usable, bound).mapInArrow(_featured, "doc_id bigint, x array<double>, y int").collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["y"] for r in rows], float))


def _scored(model):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column(1).to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.value.score(x))], ["doc_id", "score"])

    return task


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id and score of every row of docs."""
    return docs.select("doc_id", "text").mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model)), "doc_id bigint, score double")


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents", "doc_id")
    fold = bucket(F.col("doc_id"), FOLDS)
    model = train(docs, table(spark, sf_dir, "labels"), usable=fold != HELD_OUT)
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
