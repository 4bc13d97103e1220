"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A word enters as the sum of a hashed word vector and the mean of hashed vectors of its
character triples; a word of over ``LONG`` bytes counts as several, which overlap so that
each triple is in one of them. Both directions run over windows of ``WIDTH`` words, ``STRIDE`` apart,
attention pools a window's states and a text scores as its most toxic window; all
windows of the whole text are scored. The network is numpy throughout: training on the
driver from a bounded sample, scoring in tasks over batches of windows.

Labels come from at most ``BOUND`` documents a class; one of over ``MAX_CHARS`` characters
is learnt from random runs of ``RUN`` characters over all of it, as many as make up
``MAX_CHARS``. A document's label trains its highest scoring window, after two rounds on random windows.
Null and empty texts are one window of padding. Without labels of both classes every
score is one half. Rows that repeat a doc_id are scored each. Only ``doc_id`` and ``text``
of the documents are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_table, table
from .sampling import bucket, labelled

BOUND, MAX_CHARS, RUN = 1600, 12_000, 1500
#: Bytes of the longest word that is one.
LONG = 64
WIDTH, STRIDE = 32, 16
DIM, STATE, WORD_ROWS, CHAR_ROWS = 12, 8, 1 << 14, 1 << 12
EPOCHS, BATCH, RATE, SEED = 12, 64, 0.02, 5
FOLDS, HELD_OUT, CUTOFF = 3, 1, 0.7
#: Words whose inputs a task remembers, and windows scored at once.
CACHE, CHUNK = 400_000, 2048

_EDGE = b" .,;:!?\"'()[]{}<>|#*$%&@_+=-~`^/\\"


def core_rows(core: bytes) -> tuple[int, list[int]]:
    """Rows of a lower-case word's vector and of its character vectors; row 0 is padding's."""
    marked = b"<" + core + b">"
    chars = [1 + zlib.crc32(marked[i : i + 3]) % (CHAR_ROWS - 1) for i in range(max(1, len(marked) - 2))]
    return 1 + zlib.crc32(core) % (WORD_ROWS - 1), chars


def parts(word: bytes) -> list[bytes]:
    """A long word as overlapping runs of LONG bytes."""
    return [word[i : i + LONG] for i in range(0, len(word) - 2, LONG - 2)]


def _sums(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """n rows, row k the sum of those of ``rows`` whose ``at`` is k."""
    order = np.argsort(at, kind="stable")
    own = at[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    out[own[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Vocabulary:
    """Numbers words in the order met, without case and marks at their edges; number 0 is padding."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.count = 1
        self.rows: list[tuple[int, list[int]]] = [(0, [0])]

    def _add(self, word: bytes) -> int:
        core = word.strip(_EDGE) or word
        i = self.number.get(core)
        if i is None:
            i = self.number[core] = self.count
            self.rows.append(core_rows(core))
            self.count += 1
        self.number[word] = i
        return i

    def of(self, text: str | None) -> np.ndarray:
        """The numbers of a text's words."""
        words = (text or "").encode().lower().split()
        out = list(map(self.number.get, words))
        if None in out:
            met, out = zip(words, out, strict=True), []
            for w, i in met:
                if i is not None:
                    out.append(i)
                elif len(w) <= LONG:
                    out.append(self._known(w))
                else:
                    out += map(self._known, parts(w))
        return np.array(out, np.int64)

    def _known(self, word: bytes) -> int:
        i = self.number.get(word)
        return self._add(word) if i is None else i

    def taken(self) -> list[tuple[int, list[int]]]:
        """The rows since the last call, which are given up."""
        out, self.rows = self.rows, []
        return out


def windows(n: int) -> np.ndarray:
    """Starts of the overlapping windows that cover n words; the last one ends with the text."""
    if n <= WIDTH:
        return np.zeros(1, np.int64)
    s = np.arange(0, n - WIDTH, STRIDE)
    return np.append(s, n - WIDTH)


def windowed(ids: np.ndarray) -> np.ndarray:
    """The windows of a text's word numbers, padded with 0."""
    if len(ids) < WIDTH:
        ids = np.concatenate((ids, np.zeros(WIDTH - len(ids), np.int64)))
    return ids[windows(len(ids))[:, None] + np.arange(WIDTH)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(1) / (np.float32(1) + np.exp(-x))


class Network:
    """Parameters by name; ``d`` is the direction, 0 forward and 1 backward."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)

        def normal(*shape, scale):
            return (r.standard_normal(shape) * scale).astype(np.float32)

        self.p = {"word": normal(WORD_ROWS, DIM, scale=0.3), "char": normal(CHAR_ROWS, DIM, scale=0.3)}
        self.p["word"][0] = self.p["char"][0] = 0
        for d in (0, 1):
            self.p |= {f"W{d}": normal(DIM, 3 * STATE, scale=DIM**-0.5), f"U{d}": normal(STATE, 3 * STATE, scale=STATE**-0.5), f"b{d}": np.zeros(3 * STATE, np.float32)}
        self.p |= {"A": normal(2 * STATE, STATE, scale=(2 * STATE) ** -0.5), "v": normal(STATE, scale=STATE**-0.5), "o": normal(2 * STATE, scale=(2 * STATE) ** -0.5), "c": np.zeros(1, np.float32)}

    def inputs(self, rows: list[tuple[int, list[int]]]) -> np.ndarray:
        """Word vector plus mean character vector of each word."""
        sizes = np.fromiter((len(c) for _, c in rows), np.int64, len(rows))
        flat = np.fromiter((x for _, c in rows for x in c), np.int64, int(sizes.sum()))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        chars = np.add.reduceat(self.p["char"][flat], starts, axis=0) / sizes[:, None].astype(np.float32)
        return self.p["word"][[w for w, _ in rows]] + chars

    def projected(self, x: np.ndarray) -> list[np.ndarray]:
        return [x @ self.p[f"W{d}"] + self.p[f"b{d}"] for d in (0, 1)]

    def forward(self, gates: list[np.ndarray], ids: np.ndarray, keep: bool = False):
        """Logit of each window (rows of ids into the projected inputs)."""
        n, states, saved = len(ids), np.empty((2, WIDTH, len(ids), STATE), np.float32), []
        for d in (0, 1):
            h, u = np.zeros((n, STATE), np.float32), self.p[f"U{d}"]
            for t in range(WIDTH) if d == 0 else range(WIDTH - 1, -1, -1):
                x, q = gates[d][ids[:, t]], h @ u
                zr = _sigmoid(x[:, : 2 * STATE] + q[:, : 2 * STATE])
                z, r = zr[:, :STATE], zr[:, STATE:]
                c = np.tanh(x[:, 2 * STATE :] + r * q[:, 2 * STATE :])
                if keep:
                    saved.append((d, t, h, z, r, c, q[:, 2 * STATE :]))
                h = c + z * (h - c)
                states[d, t] = h
        both = np.concatenate((states[0], states[1]), axis=2)  # time, window, state
        e = np.tanh(both @ self.p["A"])
        a = e @ self.p["v"] + np.where(ids.T == 0, np.float32(-30), np.float32(0))
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        pooled = (a[:, :, None] * both).sum(0)
        logit = pooled @ self.p["o"] + self.p["c"]
        return (logit, (both, e, a, pooled, saved)) if keep else logit

    def gradients(self, rows, ids: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Gradients of the mean log loss of windows ids with labels y, and the loss."""
        x = self.inputs(rows)
        gates = self.projected(x)
        logit, (both, e, a, pooled, saved) = self.forward(gates, ids, keep=True)
        p, g = self.p, {}
        prob = _sigmoid(logit)
        loss = float(-np.mean(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7)))
        dl = ((prob - y) / len(y)).astype(np.float32)
        g["o"], g["c"] = pooled.T @ dl, dl.sum(keepdims=True)
        dpool = dl[:, None] * p["o"]
        da = (both * dpool).sum(2)
        dboth = a[:, :, None] * dpool
        ds = a * (da - (a * da).sum(0))
        g["v"] = np.einsum("tn,tns->s", ds, e)
        de = ds[:, :, None] * p["v"] * (1 - e * e)
        g["A"] = np.einsum("tni,tnj->ij", both, de)
        dboth = dboth + de @ p["A"].T
        dgates = []
        for d in (0, 1):
            u, du, dh = p[f"U{d}"], np.zeros_like(p[f"U{d}"]), np.zeros((len(ids), STATE), np.float32)
            steps = np.empty((WIDTH, len(ids), 3 * STATE), gates[d].dtype)
            for _, t, h, z, r, c, qc in reversed([s for s in saved if s[0] == d]):
                dh = dh + dboth[t][:, d * STATE : (d + 1) * STATE]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * qc * r * (1 - r)
                dq = np.concatenate((dz, dr, dc * r), 1)
                steps[t] = np.concatenate((dz, dr, dc), 1)
                du += h.T @ dq
                dh = dh * z + dq @ u.T
            dgates.append(_sums(ids.T.ravel(), steps.reshape(-1, 3 * STATE), len(x)))
            g[f"U{d}"], g[f"W{d}"], g[f"b{d}"] = du, x.T @ dgates[d], dgates[d].sum(0)
        dx = sum(dgates[d] @ p[f"W{d}"].T for d in (0, 1))
        sizes = np.fromiter((len(c) for _, c in rows), np.int64, len(rows))
        flat = np.fromiter((x for _, c in rows for x in c), np.int64, int(sizes.sum()))
        g["word"] = _sums(np.fromiter((w for w, _ in rows), np.int64, len(rows)), dx, WORD_ROWS)
        g["char"] = _sums(flat, np.repeat(dx / sizes[:, None], sizes, axis=0).astype(dx.dtype), CHAR_ROWS)
        g["word"][0] = g["char"][0] = 0
        return g, loss


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.rate, self.t = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        for k, x in g.items():
            x = x * scale
            m, v = self.m[k], self.v[k]
            m *= 0.9
            m += 0.1 * x
            v *= 0.99
            v += 0.01 * x * x
            p[k] -= (self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-6)).astype(np.float32)


def fit(texts: list[str], y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network | None:
    """The network of document labels y; None unless there are both labels."""
    if len(set(y.tolist())) < 2:
        return None
    words = Vocabulary()
    bags = [windowed(words.of(t)) for t in texts]
    net, r = Network(seed), np.random.default_rng(seed)
    adam = Adam(net.p, RATE)
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    for epoch in range(epochs):
        adam.rate = RATE * (1 - epoch / (epochs + 1))
        one = r.permutation(pos)
        two = r.permutation(neg)
        steps = max(1, -(-(len(pos) + len(neg)) // BATCH))
        for k in range(steps):
            docs = np.concatenate((np.take(one, range(k * BATCH // 2, (k + 1) * BATCH // 2), mode="wrap"), np.take(two, range(k * BATCH // 2, (k + 1) * BATCH // 2), mode="wrap")))
            own = [bags[i] for i in docs]
            if epoch < 2:
                picked = np.stack([b[r.integers(len(b))] for b in own])
            else:
                used, ids = np.unique(np.concatenate(own), return_inverse=True)
                ids = ids.reshape(-1, WIDTH)
                mapped = ids if used[0] == 0 else ids + 1
                rows = [words.rows[i] for i in used] if used[0] == 0 else [words.rows[0], *(words.rows[i] for i in used)]
                logit = net.forward(net.projected(net.inputs(rows)), mapped)
                at = np.cumsum([0, *map(len, own)])
                picked = np.stack([b[int(np.argmax(logit[at[i] : at[i + 1]]))] for i, b in enumerate(own)])
            used, ids = np.unique(np.append(picked.ravel(), 0), return_inverse=True)
            g, _ = net.gradients([words.rows[i] for i in used], ids[:-1].reshape(picked.shape), y[docs].astype(np.float32))
            adam.step(net.p, g)
    return net


class _Memory:
    """Words met by a task and their projected inputs, in arrays that double when full."""

    def __init__(self, net: Network):
        self.net, self.words, self.n = net, Vocabulary(), 0
        self.gates = [np.empty((1 << 14, 3 * STATE), np.float32) for _ in (0, 1)]

    def grown(self) -> list[np.ndarray]:
        rows = self.words.taken()
        if rows:
            while self.n + len(rows) > len(self.gates[0]):
                self.gates = [np.concatenate((g, np.empty_like(g))) for g in self.gates]
            for g, new in zip(self.gates, self.net.projected(self.net.inputs(rows)), strict=True):
                g[self.n : self.n + len(rows)] = new
            self.n += len(rows)
        return self.gates


def _scored(network):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = network.value
        memory = getattr(net, "memory", None) or _Memory(net)  # a worker's tasks share the network and what it has met
        for b in batches:
            texts = b.column(1).to_pylist()
            out = np.full(len(texts), -np.inf, np.float32)
            held, owner, n = [], [], 0
            for k, t in enumerate(texts):
                w = windowed(memory.words.of(t))
                held.append(w), owner.append(np.full(len(w), k))
                n += len(w)
                if n >= CHUNK or k + 1 == len(texts):
                    gates, ids, own = memory.grown(), np.concatenate(held), np.concatenate(owner)
                    for i in range(0, len(ids), CHUNK):
                        np.maximum.at(out, own[i : i + CHUNK], net.forward(gates, ids[i : i + CHUNK]))
                    held, owner, n = [], [], 0
                    if len(memory.words.number) > CACHE:
                        memory = _Memory(net)
            net.memory = memory
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-out.astype(float))))], ["doc_id", "score"])

    return task


def shortened(text: str | None, doc_id: int) -> str:
    """A text of up to MAX_CHARS characters as it is; of a longer one random runs over all of it."""
    text = text or ""
    if len(text) <= MAX_CHARS:
        return text
    starts = np.sort(np.random.default_rng(doc_id & (1 << 63) - 1).integers(0, len(text) - RUN + 1, MAX_CHARS // RUN))
    return " ".join(text[i : i + RUN] for i in starts.tolist())


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [shortened(t, d) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), b.column(2)], ["doc_id", "text", "y"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", usable=None, bound: int = BOUND) -> Network | None:
    usable = F.lit(True) if usable is None else usable
    rows = labelled(docs, labels, label, usable, bound).mapInArrow(_sampled, "doc_id bigint, text string, y int").collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    return fit([r["text"] for r in rows], np.array([r["y"] for r in rows]))


def score(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id and score of every row of docs."""
    if network is None:
        return docs.select("doc_id", F.lit(0.5).alias("score"))
    return docs.select("doc_id", "text").mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(network)), "doc_id bigint, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents", "doc_id")
    fold = bucket(F.col("doc_id"), FOLDS)
    scored = score(docs, train(docs, table(spark, sf_dir, "labels"), usable=fold != HELD_OUT))
    return scored.select("doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
