"""SimHash near-dedup with pigeonhole blocks.

Fingerprints: 64 bits by majority over the XXH64 hashes (seed 42) of the 3-word shingles
of the lower-cased text. Copies collapse first: from there on a fingerprint is one node,
whatever doc_ids its rows have. Two fingerprints that differ in at most 3 bits agree on at
least 3 of 6 blocks, so each is filed under the 20 triples of blocks, about 32 bits a key,
and only fingerprints under one key are compared. A key with more than ``SPLIT``
fingerprints is filed again under triples of its other bits: at most 17 bits are then
free, which bounds a bucket to 2**17 fingerprints whatever the input.

A bucket yields a spanning forest of its links, never all its pairs: small buckets by
bit counts, large ones by bit flips (a within 1 flip, b within 2 flips of one value), which
is linear in the bucket. The forest has the links' components, so no link is lost.

Null, empty and blank texts have fingerprint zero and link like any other. A component is
named by its smallest doc_id, null if it has none. Each row is in the component of its own
text; ``keep_one`` decides by row and keeps exactly one of each component. ``near_dedup``
reads only ``doc_id`` and ``text``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_groups, kept_rows, numbered, spread_table
from .components import components

SHINGLE, SEED, DISTANCE, BLOCKS = 3, 42, 3, 6
SPLIT = 1 << 16
#: Up to here a bucket's members are compared by bit counts.
DENSE = 1024


def fingerprint(text: str | None) -> int:
    """Majority bits over the hashes of the text's shingles, as a signed 64-bit number."""
    w = (text or "").encode().lower().split()  # bytes: ASCII letters and breaks only
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) < SHINGLE:
        h = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        digest = xxhash.xxh64_intdigest
        h = np.fromiter(
            (digest(joined[a:b], SEED) for a, b in zip(starts[: len(w) - SHINGLE + 1].tolist(), (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)),
            np.uint64,
            len(w) - SHINGLE + 1,
        )
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def _spans(n: int = 64, parts: int = BLOCKS) -> list[int]:
    """Masks of ``parts`` runs of bits that cover n bits."""
    cuts = [n * k // parts for k in range(parts + 1)]
    return [((1 << cuts[k + 1]) - 1) ^ ((1 << cuts[k]) - 1) for k in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks() -> list[int]:
    """Keys' masks: every choice of all but DISTANCE blocks."""
    return [sum(c) for c in combinations(_spans(), BLOCKS - DISTANCE)]


def finer_masks(mask: int) -> list[int]:
    """The mask with every choice of half of six pieces of the bits outside of it."""
    free = [i for i in range(64) if not mask >> i & 1]
    pieces = [sum(1 << free[i] for i in range(len(free) * k // BLOCKS, len(free) * (k + 1) // BLOCKS)) for k in range(BLOCKS)]
    return [mask | sum(c) for c in combinations(pieces, BLOCKS - DISTANCE)]


def _hook(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the components of positions a and b; up names each position's component, before and after."""
    while True:
        x, y = up[a], up[b]
        apart = x != y
        if not apart.any():
            return up
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]


def linked(fp: np.ndarray) -> np.ndarray:
    """For each of a bucket's distinct fingerprints the first one of its component there."""
    n = len(fp)
    up = np.arange(n)
    if n <= DENSE:
        return _hook(up, *np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= DISTANCE, 1)))
    varied = np.bitwise_or.reduce(fp ^ fp[0])
    bits = [np.uint64(1 << k) for k in range(64) if int(varied) >> k & 1]
    one = [np.uint64(0), *bits]
    two = [*one, *(a | b for a, b in combinations(bits, 2))]
    # all values within one flip, each once with the first position near it, whose component holds all the others near it
    value = np.concatenate([fp ^ m for m in one])
    owner = np.tile(np.arange(n), len(one))
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    heads = owner[first]
    up = _hook(up, owner, np.repeat(heads, np.diff(np.append(first, len(value)))))
    keys = value[first]
    for m in two:
        at = np.minimum(np.searchsorted(keys, fp ^ m), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == (fp ^ m))
        up = _hook(up, hit, heads[at[hit]])
    return up


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between nodes, from rows of (fps, nodes) of one bucket each."""
    for b in batches:
        fps, nodes = b.column(0), b.column(1)
        off = np.asarray(fps.offsets)
        fp = np.asarray(fps.values).view(np.uint64) if len(fps) else np.empty(0, np.uint64)
        node = np.asarray(nodes.values)
        noff = np.asarray(nodes.offsets)
        size = np.diff(off)
        two = np.flatnonzero(size == 2)
        near = two[np.bitwise_count(fp[off[two]] ^ fp[off[two] + 1]) <= DISTANCE]
        a, c = [node[noff[near]]], [node[noff[near] + 1]]
        for i in np.flatnonzero(size > 2).tolist():
            own = node[noff[i] : noff[i + 1]]
            root = linked(fp[off[i] : off[i + 1]])
            far = np.flatnonzero(root != np.arange(len(root)))
            a.append(own[far]), c.append(own[root[far]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(c), pa.int64())], ["a", "b"])


def _filed(nodes: DataFrame, per: list[tuple[int, int]]) -> DataFrame:
    """A row for each node and (table, mask): the fingerprint's masked bits as the key."""
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in per])
    return nodes.select("fp", "node", F.inline(keys))


def _bucket_links(filed: DataFrame) -> DataFrame:
    buckets = filed.groupBy("t", "key").agg(F.collect_list("fp").alias("fps"), F.collect_list("node").alias("nodes")).filter("size(fps) > 1")
    return buckets.select("fps", "nodes").mapInArrow(_links, "a bigint, b bigint")


def near_links(nodes: DataFrame, at: Scratch, split: int = SPLIT) -> DataFrame:
    """Edges (a, b) whose components are those of all links; nodes has distinct fp and node."""
    coarse = masks()
    filed = _filed(nodes, list(enumerate(coarse)))
    shared = at.write(filed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    edges = _bucket_links(filed.join(shared.filter(F.col("n") <= split), ["t", "key"], "left_semi"))
    crowded = shared.filter(F.col("n") > split)
    if not crowded.isEmpty():
        members = at.write(filed.join(crowded, ["t", "key"], "left_semi"), "crowded")
        for t, mask in enumerate(coarse):
            own = members.filter(F.col("t") == t).select("fp", "node")
            edges = edges.unionByName(_bucket_links(_filed(own, [(k, m) for k, m in enumerate(finer_masks(mask))])))
    return edges


def near_dedup(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """doc_id, fp (signed) and component_id of every row of docs."""
    at = Scratch(docs.sparkSession, "simhash")
    fps = at.write(fingerprints(docs), "fingerprints")
    nodes = at.write(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    part = at.write(components(near_links(nodes.select("fp", F.col("fp").alias("node")), at, split)).withColumnRenamed("node", "fp"), "part")
    names = part.join(nodes, "fp").groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size"))
    named = join_groups(part, at.write(names, "names"), "component", "size", part.count()).select("fp", "component_id", F.lit(True).alias("in_part"))
    at.delete("shared"), at.delete("crowded")
    classes = nodes.join(named, "fp", "left").select("fp", F.when(F.col("in_part"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"), "n")
    return join_groups(fps, at.write(classes, "classes"), "fp", "n", fps.count()).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The input's rows, all columns as they were, of each component the one of the smallest doc_id (null counts as the largest)."""
    rows = numbered(docs, Scratch(docs.sparkSession, "simhash-rows"))
    if rows is None:
        return docs.join(near_dedup(docs).filter("doc_id = component_id").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    found = near_dedup(rows.select(F.col("row").alias("doc_id"), "body.text")).select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "row")
    best = found.join(rows.select("row", "body.doc_id", "tie"), "row").groupBy("component_id").agg(F.min(order).alias("best"))
    return kept_rows(rows, best.select("best.row"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spread_table(spark, sf_dir, "documents", "doc_id")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
