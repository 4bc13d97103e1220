"""Hard negatives by slot-decomposed selection.

Each anchor has up to k positives, the best rows of its own label, and each positive opens a
window of negative scores between two shares of its own score. Windows overlap, but their
upper limits cut the scores into disjoint slots: slot c holds the scores that exactly the
first c positives' limits admit. A combiner keeps the best few of each slot, block by block
and then over all blocks; a window is answered from the slots at and below its own, merged
from the lowest slot upwards and cut to the best few at each step. What lies under a
window's lower limit comes last in that order, so it is cut off at the end. No window
gathers its rows, and a score is looked at once for all windows.

Anchors meet the rows block by block: parts of rows and blocks of anchors, at most ``ROWS``
and ``ANCHORS`` each, go to the tasks of a cogroup, which multiply them in slices of ``CELLS``
scores. A part is drawn by the row's place in a written table, never by a value, so neither
a label nor a vector nor a vec_id that many rows share gathers in a task. A task passes on
at most k rows an anchor and slot.

Rows with a null vec_id or label, a null vector, or a component that is null or not finite
(also after scaling) take no part. Other rows of an anchor are rows of another vec_id; rows that
repeat a vec_id count as often as they come, as rows and as anchors. Vectors of unequal
lengths have no score; empty vectors score 0 with each other. Scores are exact up to 2**53,
and beyond that exact until they saturate at 2**56. Other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table

POSITIVES, NEGATIVES = 5, 10
#: Percent of the positive's score between which a negative's has to lie.
LOW, HIGH = 30, 90
ROWS, ANCHORS, CELLS = 4096, 4096, 1 << 21
#: Scores saturate here, so that their hundredfold is a long.
MOST = 1 << 56


def prepared(vectors: DataFrame, vec_id: Column, label: Column, vector: Column, scale: int) -> DataFrame:
    """vec_id, label and v (floor(scale * x) of each component, as doubles) of the rows that take part."""
    v = F.transform(vector, lambda x: _floor(x.cast("double") * float(scale)))
    out = vectors.select(vec_id.cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return out.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(~odd)


def _floor(x: Column) -> Column:
    """floor as a double; numbers of 2**52 and more, and those that are not finite, are left as they are."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def _matrix(column: pa.ChunkedArray, length: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, length) if length else np.zeros((len(column), 0))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, as 64-bit integers."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1)
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in a], object).reshape(a.shape) @ np.array([[int(x) for x in r] for r in b], object).reshape(b.shape).T
    return np.clip(whole, -MOST, MOST).astype(np.int64) if whole.size else np.zeros((len(a), len(b)), np.int64)


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each group's k best by score, then smaller id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return order[rank < k]


def _slices(rows: pa.Table, anchors: pa.Table):
    """(rows, anchors, scores) of equal vector lengths, at most CELLS scores at a time."""
    sizes = [t.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False) for t in (rows, anchors)]
    for length in np.intersect1d(*map(np.unique, sizes)).tolist():
        r, a = (t.filter(pa.array(s == length)) for t, s in zip((rows, anchors), sizes, strict=True))
        step = max(1, CELLS // len(a))
        q = _matrix(a.column("v"), length)
        for at in range(0, len(r), step):
            part = r.slice(at, step)
            yield part, a, scores(q, _matrix(part.column("v"), length))


def _out(pieces: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Table:
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*pieces, strict=True) if pieces else [()] * len(names))]
    return pa.table({n: pa.array(x.astype(np.int64)) for n, x in zip(names, joined, strict=True)})


def _kept(pieces: list[tuple[np.ndarray, ...]], k: int) -> list[tuple[np.ndarray, ...]]:
    """(group..., score, id) pieces cut to the best k of each group."""
    if not pieces:
        return pieces
    *group, score, ids = (np.concatenate(x) for x in zip(*pieces, strict=True))
    number = np.unique(group[0], return_inverse=True)[1] * 1024 + (group[1] if len(group) > 1 else 0)
    top = best(number, score, ids, k)
    return [tuple(x[top] for x in (*group, score, ids))]


def _positives(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Cogroup of rows and anchors: the best k rows of each anchor's label."""

    def find(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        pieces: list[tuple[np.ndarray, ...]] = []
        for r, a, s in _slices(rows, anchors):
            ids, own = r.column("vec_id").to_numpy(), a.column("vec_id").to_numpy()
            fits = (a.column("label").to_numpy()[:, None] == r.column("label").to_numpy()) & (own[:, None] != ids)
            if s.shape[1] > k:  # ahead of the sort, what a full row of better scores rules out
                least = np.where(fits, s, np.iinfo(np.int64).min)
                fits &= s >= -np.partition(-np.maximum(least, -MOST - 1), k - 1, axis=1)[:, k - 1 : k]
            i, j = np.nonzero(fits)
            top = best(i, s[i, j], ids[j], k)
            pieces = _kept([*pieces, (a.column("anchor").to_numpy()[i[top]], s[i, j][top], ids[j[top]])], k)
        return _out(pieces, ["anchor", "score", "vec_id"])

    return find


def _slots(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Cogroup of rows and anchors with ``limits`` (upper limits in hundredths, descending) and ``least``: the best k negatives of each slot."""

    def find(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        pieces: list[tuple[np.ndarray, ...]] = []
        for r, a, s in _slices(rows, anchors):
            ids = r.column("vec_id").to_numpy()
            limits, least = a.column("limits").to_pylist(), a.column("least").to_numpy()
            top_limit = np.array([x[0] for x in limits], np.int64)
            width = max(map(len, limits))
            padded = np.array([x + [np.iinfo(np.int64).min] * (width - len(x)) for x in limits], np.int64)
            h = s * 100
            fits = (a.column("label").to_numpy()[:, None] != r.column("label").to_numpy()) & (h <= top_limit[:, None]) & (h >= least[:, None])
            i, j = np.nonzero(fits)
            slot = (h[i, j][:, None] <= padded[i]).sum(1)
            top = best(i * 1024 + slot, s[i, j], ids[j], k)
            pieces = _kept([*pieces, (a.column("anchor").to_numpy()[i[top]], slot[top], s[i, j][top], ids[j[top]])], k)
        return _out(pieces, ["anchor", "slot", "score", "vec_id"])

    return find


def _met(rows: DataFrame, anchors: DataFrame, n: tuple[int, int], kernel: Callable, schema: str) -> DataFrame:
    """The kernel over every part of rows and block of anchors; n: how many there are of each."""
    left = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n[1] - 1)))).groupBy("part", "block")
    right = anchors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n[0] - 1)))).groupBy("part", "block")
    return left.cogroup(right).applyInArrow(kernel, schema)


def _best(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """The best k rows of each group, with their rank; a task passes on k a group at most."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id"))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, part_rows: int = ROWS, block_anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, for each anchor's positives.

    rows: as ``prepared`` gives them; is_anchor: condition on vec_id."""
    at = Scratch(rows.sparkSession, "negatives")
    rows = at.write(rows, "rows")
    anchors = at.write(rows.filter(is_anchor).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    n_rows, n_anchors = rows.count(), anchors.count()
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n_rows // part_rows), min(2 * tasks, n_rows // 256))
    blocks = max(1, -(-n_anchors // block_anchors))
    rows = rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int"))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int"))
    found = _met(rows, anchors, (parts, blocks), _positives(positives), "anchor bigint, score bigint, vec_id bigint")
    found = _best(found, ["anchor"], positives).groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "score"))).alias("own"))
    found = at.write(found, "positives")
    limits = found.select("anchor", F.transform("own", lambda p: p["score"] * high).alias("limits"), F.array_min(F.transform("own", lambda p: p["score"] * low)).alias("least"))
    limited = at.write(anchors.join(limits, "anchor"), "limited")
    slots = _met(rows, limited, (parts, blocks), _slots(negatives), "anchor bigint, slot bigint, score bigint, vec_id bigint")
    slots = _best(slots, ["anchor", "slot"], negatives)
    slots = slots.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "rank", F.col("vec_id").alias("id"), "score"))).alias("slots"))
    joined = limited.select("anchor", F.col("vec_id").alias("anchor_id")).join(found, "anchor").join(slots, "anchor")
    windows = joined.select("anchor_id", F.posexplode(F.arrays_zip("own", _windows(positives, negatives).alias("best"))).alias("at", "x"))
    fits = F.filter("x.best", lambda n: n["score"] * 100 >= F.col("x.own.score") * low)
    out = windows.select("anchor_id", F.col("x.own.id").alias("positive_id"), F.col("x.own.score").alias("positive_score"), F.posexplode(fits).alias("place", "n"))
    return out.select("anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))


def _windows(positives: int, negatives: int) -> Column:
    """The best negatives under each positive's upper limit, from each slot's best: the lowest slot first, each step adds the next one in front.

    ``slots`` is sorted by slot and rank; an anchor with fewer positives has fewer slots,
    and what is merged beyond them is empty."""
    one = lambda c: F.filter("slots", lambda s: s["slot"] == c)
    merged: list[Column] = [one(positives)]
    for c in range(positives - 1, 0, -1):
        merged.insert(0, F.slice(F.concat(one(c), merged[0]), 1, negatives))
    return F.slice(F.array(*merged), F.lit(1), F.size("own"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of ``embeddings``; anchors are the rows whose vec_id is divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = prepared(table(spark, sf_dir, "embeddings"), F.col("vec_id"), label, F.col("embedding"), 256)
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


def sql() -> str:
    return f"""
WITH scaled AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
own AS (SELECT *, row_number() OVER () AS r FROM scaled WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
met AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM own a JOIN own b ON a.vec_id % 100 = 0 AND len(a.v) = len(b.v) AND (a.label <> b.label OR a.vec_id <> b.vec_id)),
positives AS (
  SELECT * FROM met WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= {POSITIVES}),
numbered AS (SELECT *, row_number() OVER () AS p FROM positives),
fits AS (
  SELECT p.p, p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.p ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
  FROM numbered p JOIN met n ON p.anchor = n.anchor AND NOT n.same AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM fits WHERE rank <= {NEGATIVES}
"""
