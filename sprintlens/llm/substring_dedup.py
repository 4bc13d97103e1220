"""Substring dedup with a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words. Of each window the index holds the hash of one
inner run of ``INNER`` words, the least by hash among the window's runs (winnowing), so
equal windows always share their indexed hash while only about a sixth of all positions is
indexed. The index lies under a folder and outlives the session that made it: a new
``FingerprintIndex`` of the same path goes on where the last whole batch ended. It holds

* runs: immutable tables of hashes and counts, and of postings (hash, batch, document,
  position), both bucketed and sorted by hash; the postings of heavy hashes, of which there
  are few, are strewn over all buckets instead, so that none gathers them;
* the texts of each batch, bucketed by document, and the ranges of its repeated windows;
* a manifest, written last, that names the tables which count and each batch's token.

A batch of documents

1. becomes a new run,
2. is merge-joined with the older runs, bucket by bucket, for hashes seen before,
3. is verified: around those hashes only, the real windows of the batch and of the older
   documents that hold them are compared by 128-bit digests of their words; all but the
   first by (batch, document, start) are repeats, whose ranges are written,
4. wherever ``FANOUT`` runs of one level have piled up they are compacted into one of
   the next level,
5. and counts from the moment its manifest is whole.

A batch that fails before that leaves nothing that counts, whatever it has written; the next
batch clears it away. Afterwards its result can always be had again: it follows from its
texts and ranges. A batch that is added under a token it had before gets that result and is
not added twice, so a job that doesn't know whether it ended may simply run again.

Decisions on older documents never change. A batch reads the older runs and texts in their
buckets, without a shuffle; only postings of matched hashes and the texts that hold them go
further. So an add costs one sequential pass over the index and work in proportion to the
batch and to what it matches.

Counts are combined before they are shuffled, and the postings of heavy hashes meet them in
a broadcast, so a passage that a third of all documents hold gathers in no task. A hash met
over ``HOT`` times is not handled as one group either: its windows are dealt by their own
digests and by document, first within each slot, then among the slots' firsts.

Every row is a document of its own. Where doc_id is null or repeated in a batch, its rows
are numbered in the order of doc_id (null last), text digest and place. A null text has no
words. Texts shorter than a window lose nothing. Only ``doc_id`` and ``text`` are read; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HEAVY_SHARE, TASK_ROWS, Scratch, drops_shuffles, shared_root, table

WINDOW, INNER = 20, 10
BATCHES, FANOUT, HOT = 3, 2, 4096
_STEP = 0x9E3779B97F4A7C15
_BYTE = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=8).digest() for b in range(256)), "<u8").copy()


class _Powers:
    """Powers of the rolling hash's odd base and of its inverse modulo 2**64, as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 1 << 16, 2 * len(self.up))
            for name, base in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x))


_powers = _Powers()


class _Laid:
    """A text's words joined by one space, with where each starts and ends."""

    def __init__(self, text: str | None):
        self.body = b" ".join((text or "").encode().split())
        self.bytes = np.frombuffer(self.body, np.uint8)
        gaps = np.flatnonzero(self.bytes == 32)
        self.starts = np.concatenate(([0], gaps + 1))
        self.ends = np.append(gaps, len(self.body))
        self.n = len(self.starts) if self.body else 0


def chosen(laid: _Laid, window: int, inner: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each inner run of words, and for each window the position of its chosen run.

    A run's hash comes from prefix sums over the bytes. The low bits give way to the
    position, so that the least of a window tells where it is; runs that tie have one hash."""
    _powers.to(len(laid.body) + 1)
    sums = np.zeros(len(laid.body) + 1, np.uint64)
    np.cumsum(_BYTE[laid.bytes] * _powers.up[: len(laid.body)], out=sums[1:])
    first = laid.starts[: laid.n - inner + 1]
    h = (sums[laid.ends[inner - 1 :]] - sums[first]) * _powers.down[first]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    runs = window - inner + 1
    low = (1 << runs.bit_length()) - 1
    h &= np.uint64(~low & (1 << 64) - 1)
    at = np.arange(len(h))
    least, span = h | (at & low).astype(np.uint64), 1
    while 2 * span <= runs:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < runs:
        least = np.minimum(least[: span - runs], least[runs - span :])
    at = at[: len(least)]
    return h.view(np.int64), at + (((least & np.uint64(low)).astype(np.int64) - at) & low)


def _near_ties(h: np.ndarray, reach: int) -> np.ndarray:
    """Positions of equal hashes within reach: overlapping windows with equal words choose one of them, and it must count as met twice."""
    tied = np.zeros(len(h), bool)
    for d in range(1, min(reach, len(h) - 1) + 1):
        same = h[d:] == h[:-d]
        if same.any():
            tied[d:] |= same
            tied[:-d] |= same
    return np.flatnonzero(tied)


def _changes(c: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))


def _anchors(window: int, inner: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, rows, at = [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                laid = _Laid(t)
                if laid.n >= window:
                    h, c = chosen(laid, window, inner)
                    c = np.union1d(c[_changes(c)], _near_ties(h, window - inner))
                    hs.append(h[c]), at.append(c), rows.append(np.full(len(c), k))
            if hs:
                own = b.column(0).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), own, pa.array(np.concatenate(at).astype(np.int32))], ["h", "id", "pos"])

    return task


#: Windows of older batches that a task remembers to have passed on.
PASSED = 300_000


def _windows(window: int, inner: int, hot: int, older: bool):
    """The digests of the windows around candidate positions: a row a position, or a row a window where hot.

    Of an older batch it only counts that there is such a window, so a task passes each on once."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, passed = xxhash.xxh3_128_digest, set()
        for b in batches:
            key, slot, ids, starts, blobs, held = [], [], [], [], [], 0

            def out():
                columns = [pa.array(key, pa.int64()), pa.array(slot, pa.int32()), pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(blobs, pa.binary())]
                return pa.RecordBatch.from_arrays(columns, ["key", "slot", "id", "start", "digests"])

            spots, counts = b.column(2), b.column(3)
            offsets, spots, counts = np.asarray(spots.offsets), np.asarray(spots.values), np.asarray(counts.values)
            for k, (d, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                laid = _Laid(t)
                if laid.n < window:
                    continue
                h, c = chosen(laid, window, inner)
                n_of = np.zeros(len(h), np.int64)
                n_of[spots[offsets[k] : offsets[k + 1]]] = counts[offsets[k] : offsets[k + 1]]
                lo = _changes(c)
                hi = np.append(lo[1:], len(c))
                met = np.flatnonzero(n_of[c[lo]])
                p = c[lo[met]]
                body, first, ends = laid.body, laid.starts.tolist(), laid.ends[window - 1 :].tolist()
                for i, j, x, n in zip(lo[met].tolist(), hi[met].tolist(), h[p].tolist(), n_of[p].tolist(), strict=True):
                    own = [digest(body[u:v]) for u, v in zip(first[i:j], ends[i:j], strict=True)]
                    if older:
                        new = [m for m, x in enumerate(own) if x not in passed]
                        if not new:
                            continue
                        if len(passed) > PASSED:
                            passed.clear()
                        passed.update(own)
                        # a row may repeat windows that were passed on; it begins and ends with new ones
                        i, own = i + new[0], own[new[0] : new[-1] + 1]
                    if n <= hot:
                        key.append(x), slot.append(-1), ids.append(d), starts.append(i), blobs.append(b"".join(own))
                    else:
                        s = xxhash.xxh3_64_intdigest(d.to_bytes(8, "little", signed=True)) % -(-n // hot)
                        for m, x in enumerate(own):
                            key.append(int.from_bytes(x[:8], "little", signed=True)), slot.append(s), ids.append(d), starts.append(i + m), blobs.append(x)
                    held += 16 * len(own)
                if held > 8 << 20:
                    yield out()
                    key, slot, ids, starts, blobs, held = [], [], [], [], [], 0
            if key:
                yield out()

    return task


def _repeats(newest: int):
    """From rows in the order of key, slot, batch, id and start: the newest batch's repeated windows as ranges of starts, and the firsts of hot slots."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, seen = None, {}
        for b in batches:
            rows, lo, hi, first = [], [], [], []
            for r, (k, s, batch, d, start, blob) in enumerate(zip(*(b.column(i).to_pylist() for i in range(6)), strict=True)):
                if group != (k, s):
                    group, seen = (k, s), {}
                n, run = len(blob) // 16, -1
                for i in range(n):
                    x = blob[16 * i : 16 * i + 16]
                    me = (batch, d, start + i)
                    if seen.setdefault(x, me) != me:
                        if run < 0:
                            run = i
                    else:
                        if run >= 0 and batch == newest:
                            rows.append(r), lo.append(start + run), hi.append(start + i - 1), first.append(None)
                        run = -1
                        if s >= 0:
                            rows.append(r), lo.append(start), hi.append(start), first.append(x)
                if run >= 0 and batch == newest:
                    rows.append(r), lo.append(start + run), hi.append(start + n - 1), first.append(None)
            if rows:
                own = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(2).take(own), b.column(3).take(own), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(first, pa.binary())], ["batch", "id", "lo", "hi", "first"]
                )

    return task


def _kept(window: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, removed, kept = [], [], []
            for t, lo, hi in zip(*(b.column(i).to_pylist() for i in range(1, 4)), strict=True):
                w = (t or "").encode().split()
                words.append(len(w))
                if lo:
                    step = np.zeros(len(w) + 1, np.int64)
                    np.add.at(step, np.array(lo), 1)
                    np.add.at(step, np.array(hi) + window, -1)
                    keep = np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()
                    removed.append(len(w) - len(keep))
                    w = [w[i] for i in keep]
                else:
                    removed.append(0)
                kept.append(b" ".join(w).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return task


def _keyed(docs: DataFrame, at: Scratch) -> DataFrame:
    """id, doc_id and text of every row; ids tell rows apart and rise with doc_id.

    Numbers hold only within one written copy, so rows that need them are read from there."""
    docs = docs.select("doc_id", "text")
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("doc_id IS NULL OR n > 1").isEmpty():
        return docs.select(F.col("doc_id").alias("id"), "doc_id", "text")
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("place")]
    placed = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("tie"), F.monotonically_increasing_id().alias("place"))
    ordered = at.write(placed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.monotonically_increasing_id().alias("id")), f"keyed-{uuid.uuid4().hex}")
    return ordered.select("id", "doc_id", "text")


@dataclass
class _Run:
    """Tables of a run by name: counts (h, n), postings, and the list of heavy hashes.

    A posting's place is its hash, and h is null; or a number of its own, with h, if the hash is heavy."""

    level: int
    total: int
    counts: str
    postings: str
    heavy: str

    def tables(self) -> tuple[str, str, str]:
        return self.counts, self.postings, self.heavy


#: Columns and bucket column of the index's tables, by kind.
_TABLES = {"counts": ("h bigint, n bigint", "h"), "postings": ("place bigint, h bigint, batch int, id bigint, pos int", "place"), "found": ("h bigint, n bigint", "h"), "texts": ("id bigint, doc_id bigint, text string", "id")}
#: Columns of these whose values are mostly distinct.
_DISTINCT = ("h", "place", "id")
#: Columns of its tables without buckets.
_PLAIN = {"heavy": "h bigint", "ranges": "id bigint, lo int, hi int"}


class FingerprintIndex:
    """The index under a path, by default one of its own under the shared folder. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT, window: int = WINDOW, inner: int = INNER, hot: int = HOT, buckets: int | None = None):
        self.spark, self.fanout, self.hot = spark, fanout, hot
        self.path = (path or f"{shared_root(spark)}/fingerprints-{uuid.uuid4().hex}").rstrip("/")
        self.window, self.inner, self.buckets = window, inner, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[_Run]
        self.texts: list[str]  # of each batch, like the next two
        self.ranges: list[str]
        self.tokens: list[str]
        self._open()

    # -- manifest and tables -----------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, root = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []

    def _open(self) -> None:
        """Takes up the last manifest that was written whole."""
        fs = self._fs(self.path)[0]
        self.runs, self.texts, self.ranges, self.tokens, self.version = [], [], [], [], 0
        whole = [int(n) for n in self._names(f"{self.path}/manifest") if n.isdigit() and fs.exists(self._fs(f"{self.path}/manifest/{n}/_SUCCESS")[1])]
        if whole:
            self.version = max(whole)
            d = json.loads(self.spark.read.text(f"{self.path}/manifest/{self.version}").first()[0])
            self.window, self.inner, self.buckets = d["window"], d["inner"], d["buckets"]
            self.texts, self.ranges, self.tokens, self.runs = d["texts"], d["ranges"], d["tokens"], [_Run(**r) for r in d["runs"]]

    def _commit(self) -> None:
        """Writes the manifest, from which on the batch counts."""
        d = {"window": self.window, "inner": self.inner, "buckets": self.buckets, "texts": self.texts, "ranges": self.ranges, "tokens": self.tokens, "runs": [asdict(r) for r in self.runs]}
        self.spark.createDataFrame([(json.dumps(d),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/{self.version + 1}")
        self.version += 1

    def _sweep(self) -> None:
        """Drops the tables that the last manifest doesn't name, also those of crashed sessions, and older manifests."""
        used = {x for r in self.runs for x in r.tables()} | set(self.texts) | set(self.ranges)
        for name in self._names(self.path):
            if name.startswith("fingerprints_") and name not in used:
                self._drop(name)
        for name in self._names(f"{self.path}/manifest"):
            if name != str(self.version):
                fs, p = self._fs(f"{self.path}/manifest/{name}")
                fs.delete(p, True)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        fs, p = self._fs(f"{self.path}/{name}")
        fs.delete(p, True)

    def close(self) -> None:
        """Deletes the index; only for one that nothing will use again."""
        for name in self._names(self.path):
            if name.startswith("fingerprints_"):
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        fs, p = self._fs(self.path)
        fs.delete(p, True)
        self.runs, self.texts, self.ranges, self.tokens = [], [], [], []

    def _write(self, df: DataFrame, kind: str) -> str:
        """Writes a table and returns its name: bucketed and sorted, or plain if the kind has no bucket column."""
        name = f"fingerprints_{kind}_{uuid.uuid4().hex}"
        with drops_shuffles(self.spark):
            if kind in _TABLES:
                by = _TABLES[kind][1]
                # hashes and positions hardly repeat: a dictionary of them would only be given up
                writer = df.repartition(self.buckets, by).write.bucketBy(self.buckets, by).sortBy(by).options(**{f"parquet.enable.dictionary#{c}": "false" for c in _DISTINCT})
                writer.option("path", f"{self.path}/{name}").saveAsTable(name)
            else:
                df.write.parquet(f"{self.path}/{name}")
        return name

    def _table(self, name: str) -> DataFrame:
        """A table of the index; one that another session wrote is registered first."""
        kind = name.split("_")[1]
        if kind not in _TABLES:
            return self.spark.read.schema(_PLAIN[kind]).parquet(f"{self.path}/{name}")
        if not self.spark.catalog.tableExists(name):
            columns, by = _TABLES[kind]
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(name)

    # -- runs --------------------------------------------------------------------------

    def _run(self, postings: DataFrame, counts: DataFrame, level: int) -> _Run:
        """A run of postings (written) with counts (h, n) of their hashes."""
        name = self._write(counts, "counts")
        counts = self._table(name)
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        # fewer than total / least hashes are heavy, so their list is broadcast
        least = min(total * HEAVY_SHARE, TASK_ROWS)
        heavy = self._write(counts.filter(F.col("n") > least).select("h"), "heavy")
        marked = postings.join(F.broadcast(self._table(heavy).withColumn("is_heavy", F.lit(True))), "h", "left")
        place = F.when(F.col("is_heavy"), F.xxhash64("batch", "id", "pos")).otherwise(F.col("h"))
        own = F.when(F.col("is_heavy"), F.col("h"))
        return _Run(level, total, name, self._write(marked.select(place.alias("place"), own.alias("h"), "batch", "id", "pos"), "postings"), heavy)

    def _repeated(self, run: _Run) -> DataFrame:
        """h and its count n over run and all older runs, of hashes of run that are met twice or more."""
        counts = self._table(run.counts)
        for k, old in enumerate(self.runs):
            counts = counts.join(self._table(old.counts).withColumnRenamed("n", f"n{k}"), "h", "left")
        n = reduce(lambda a, k: a + F.coalesce(F.col(f"n{k}"), F.lit(0)), range(len(self.runs)), F.col("n"))
        return self._table(self._write(counts.select("h", n.alias("n")).filter("n > 1"), "found"))

    def _met(self, run: _Run, found: DataFrame) -> DataFrame:
        """batch, id, pos and n of the run's postings whose hash is found."""
        listed = found.join(F.broadcast(self._table(run.heavy)), "h", "left_semi").withColumnRenamed("n", "heavy_n")
        rows = self._table(run.postings).join(found.select(F.col("h").alias("place"), F.col("n").alias("light_n")).hint("merge"), "place", "left")
        rows = rows.join(F.broadcast(listed), "h", "left")
        n = F.coalesce(F.when(F.col("h").isNull(), F.col("light_n")), F.col("heavy_n"))
        return rows.select("batch", "id", "pos", n.alias("n")).filter("n IS NOT NULL")

    def _compact(self) -> None:
        """Merges runs of one level, wherever there are enough of them, into one of the next."""
        level = 0
        while any(r.level >= level for r in self.runs):
            own = [r for r in self.runs if r.level == level]
            if len(own) >= self.fanout:
                postings = reduce(DataFrame.unionByName, [self._table(r.postings).withColumn("h", F.coalesce("h", "place")).drop("place") for r in own])
                counts = reduce(DataFrame.unionByName, [self._table(r.counts) for r in own]).groupBy("h").agg(F.sum("n").alias("n"))
                self.runs = [r for r in self.runs if r.level != level] + [self._run(postings, counts, level + 1)]
            level += 1

    # -- batches -----------------------------------------------------------------------

    def find(self, docs: DataFrame, token: str | None = None) -> int:
        """Adds a batch, unless one was added under the token before; its number."""
        if token is not None and token in self.tokens:
            return self.tokens.index(token)
        at = Scratch(self.spark, "substring")
        self._sweep()
        try:
            texts = self._write(_keyed(docs, at), "texts")
            anchors = self._table(texts).select("id", "text").mapInArrow(_anchors(self.window, self.inner), "h bigint, id bigint, pos int")
            anchors = at.write(anchors.select("h", F.lit(len(self.texts)).alias("batch"), "id", "pos"), "anchors")
            run = self._run(anchors, anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")), 0)
            at.delete("anchors")
            found = self._repeated(run)
            spots = reduce(DataFrame.unionByName, [self._met(r, found) for r in (*self.runs, run)])
            spots = spots.groupBy("batch", "id").agg(F.collect_list("pos").alias("at"), F.collect_list("n").alias("n"))
            spots = at.write(spots, "spots", "batch")
            ranges = self._write(self._verified([*self.texts, texts], spots, at), "ranges")
            at.delete()
            self.texts, self.ranges, self.runs = [*self.texts, texts], [*self.ranges, ranges], [*self.runs, run]
            self.tokens = [*self.tokens, token or uuid.uuid4().hex]
            self._compact()
            self._commit()
        except BaseException:
            self._open()  # what counts is what the last manifest names
            raise
        self._sweep()
        return len(self.texts) - 1

    def _verified(self, texts: list[str], spots: DataFrame, at: Scratch) -> DataFrame:
        """The ranges (id, lo, hi) of starts of repeated windows of the last of the batches."""
        k = len(texts) - 1
        parts = []
        for j in sorted(r["batch"] for r in spots.select("batch").distinct().collect()):  # one row a batch
            rows = self._table(texts[j]).join(spots.filter(F.col("batch") == j).select("id", "at", "n"), "id").select("id", "text", "at", "n")
            rows = rows.mapInArrow(_windows(self.window, self.inner, self.hot, j < k), "key bigint, slot int, id bigint, start int, digests binary")
            parts.append(rows.select("key", "slot", F.lit(j).alias("batch"), "id", "start", "digests"))
        if not parts:
            return self.spark.createDataFrame([], _PLAIN["ranges"])
        rows = reduce(DataFrame.unionByName, parts).repartition("key", "slot").sortWithinPartitions("key", "slot", "batch", "id", "start")
        marks = at.write(rows.mapInArrow(_repeats(k), "batch int, id bigint, lo int, hi int, first binary"), "marks")
        at.delete("spots")
        among = Window.partitionBy("first").orderBy("batch", "id", "lo")
        late = marks.filter("first IS NOT NULL").withColumn("k", F.dense_rank().over(among)).filter("k > 1")
        return marks.filter("first IS NULL").unionByName(late.drop("k")).filter(F.col("batch") == k).select("id", "lo", "hi")

    def kept(self, batch: int) -> DataFrame:
        """doc_id, n_words, n_removed and kept_text of every row of a batch."""
        gone = self._table(self.ranges[batch]).groupBy("id").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
        rows = self._table(self.texts[batch]).join(gone, "id", "left").select("doc_id", "text", "lo", "hi")
        return rows.mapInArrow(_kept(self.window), "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")

    def add(self, docs: DataFrame, token: str | None = None) -> DataFrame:
        """doc_id, n_words, n_removed and kept_text of every row of docs, judged after all that was added before.

        token: a name of the batch. Under a name that the index knows nothing is added, and
        the result is that of the batch which had it. The result is read from the index."""
        return self.kept(self.find(docs, token))


def substring_dedup(docs: DataFrame, batches: int = BATCHES, **options) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of every row of docs.

    The rows go through an index of its own in batches of rising doc_id (null last); options
    are those of the index. All but the result is deleted in the end."""
    result = Scratch(docs.sparkSession, "substring-kept")
    index = FingerprintIndex(docs.sparkSession, **options)
    try:
        top = (1 << 63) - 1
        last = F.coalesce("doc_id", F.lit(top))
        cuts = docs.select(F.percentile_approx(last, [k / batches for k in range(1, batches)]).alias("c")).first()["c"] if batches > 1 else []
        bounds = [None, *sorted({c for c in cuts or [] if c < top}), None]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            own = docs if lo is None else docs.filter((F.col("doc_id") > lo) | F.col("doc_id").isNull())
            index.find(own if hi is None else own.filter(F.col("doc_id") <= hi))
        return reduce(DataFrame.unionByName, [result.write(index.kept(k), f"kept{k}") for k in range(len(index.texts))])
    finally:
        index.close()


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
