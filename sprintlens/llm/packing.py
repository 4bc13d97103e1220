"""Packing documents into fixed windows by minimum bin slack.

Documents are tokenized, end with id ``END`` and are cut at every full window; what is left
over has one of the lengths 1 .. window-1. A window is filled for the longest length that
still has pieces: a subset sum over a big-integer bitset finds the reachable total closest
to the window, the counts are traced back, and the found multiset is used as often as the
pieces allow. A sequence is padded to the window unless its length is a power of two; where
no total fills the window, the greatest reachable power of two is taken, which pads nothing. The plan knows lengths and counts only, so it is a few thousand numbers for
any corpus; pieces find their place in it by their rank among the pieces of equal length.

Ranks are two-level (counts per hash slot of a piece, then rows of a slot), so a length
that a third of all pieces have is not sorted in one task; the number of slots follows the
number of pieces.

Null and empty texts are the single id END. Rows that repeat a doc_id are packed each. Ties
in rank are between equal pieces. Only ``doc_id`` and ``text`` are read; an empty table
gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, spread_table, tokenizer_path

WINDOW, END = 2048, 1
#: Slots a length: at least so many, and so many pieces a slot on average.
SLOTS, SLOT_ROWS = 1024, 50_000
VOCABULARY = "word_bpe_49k.json"
#: A special token of the vocabulary, which parts words that are encoded together.
SEPARATOR = "<|endoftext|>"
#: What the vocabulary ends the last token of a run of letters with, and marks that may follow one.
WORD_END, MARKS = "</w>", b".,;:!?"
#: Words whose ids a task remembers, the longest word remembered, and characters of texts done together.
CACHE, CACHED_WORD, TOGETHER = 700_000, 64, 1 << 21


class _Ids(dict):
    """The little-endian ids of words, remembered.

    The tokenizer drops white space and takes runs of letters and runs of marks apart, so
    words, and the marks after a word, can be encoded on their own. What is new in a group
    of texts is encoded in one call."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.separator = self.tokenizer.token_to_id(SEPARATOR)
        known = self.tokenizer.get_vocab()
        self.last = np.zeros(max(known.values()) + 1, bool)
        self.last[[i for t, i in known.items() if t.endswith(WORD_END)]] = True
        self.marks: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _put(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray, skip: int) -> None:
        body, at = ids.tobytes(), 0
        for w, to in zip(words, ends.tolist(), strict=True):
            self[w] = body[4 * at : 4 * to]
            at = to + skip

    def _parted(self, words: list[bytes]) -> None:
        """Learns any words, by a separator between them."""
        for w in [w for w in words if b"<|" in w]:
            self[w] = self._encode(w.decode()).tobytes()
        if words := [w for w in words if b"<|" not in w]:
            ids = self._encode(f" {SEPARATOR} ".join(w.decode() for w in words))
            self._put(words, ids, np.append(np.flatnonzero(ids == self.separator), len(ids)), 1)

    def _learn(self, new: set[bytes]) -> None:
        """Learns words: letters by their last tokens, letters with marks from both parts, others by a separator."""
        plain, marked, odd = set(), [], []
        for w in new:
            if (ids := self.older.get(w)) is not None:
                self[w] = ids
                continue
            core = w.rstrip(MARKS)
            text = core.decode()
            if text.isalpha() and (text.isascii() or text.lower().isalpha()):
                if len(core) < len(w):
                    marked.append((w, core))
                if core in self.older:
                    self[core] = self.older[core]
                elif core not in self:
                    plain.add(core)
            else:
                odd.append(w)
        if plain := list(plain):
            ids = self._encode(b" ".join(plain).decode())
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(plain):
                self._put(plain, ids, ends, 0)
            else:
                self._parted(plain)
        self._parted(odd)
        for w, core in marked:
            tail = w[len(core) :]
            ids = self.marks.get(tail)
            if ids is None:
                ids = self._encode(tail.decode()).tobytes()
                if len(tail) <= 4:
                    self.marks[tail] = ids
            self[w] = self[core] + ids

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        if len(self) >= CACHE:  # what isn't met again until the next time goes
            self.older = dict(self)
            self.clear()
        split, at = [], [0]
        for t in texts:
            body = (t or "").encode()
            # the tokenizer composes accents and finds special tokens before it lowers letters, so those texts are left to it
            split += (body if b"\xcc" in body or b"\xcd" in body or b"<|" in body else body.lower()).split()
            at.append(len(split))
        parts = list(map(self.get, split))
        gaps = [k for k, x in enumerate(parts) if x is None]
        if gaps:
            new = {split[k] for k in gaps}
            self._learn(new)
            for k in gaps:
                parts[k] = self[split[k]]
            for w in new:
                if len(w) > CACHED_WORD:
                    self.pop(w, None)
                    self.pop(w.rstrip(MARKS), None)
        return [b"".join(parts[i:j]) for i, j in zip(at, at[1:], strict=False)]


@lru_cache(maxsize=1)
def _ids(vocabulary: str) -> _Ids:
    """One memory a Python worker, which outlives its tasks."""
    return _Ids(vocabulary)


def _together(ids: list, texts: list) -> Iterator[tuple[list, list]]:
    """Runs of rows of about TOGETHER characters."""
    first, held = 0, 0
    for k, t in enumerate(texts, 1):
        held += len(t or "")
        if held >= TOGETHER or k == len(texts):
            yield ids[first:k], texts[first:k]
            first, held = k, 0


def _pieces(vocabulary, window: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(vocabulary.value)
        end = np.array([END], "<u4").tobytes()
        for b in batches:
            doc, start, length, crc, tokens = [], [], [], [], []
            for docs, texts in _together(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for d, body in zip(docs, ids.texts(texts), strict=True):
                    body += end
                    n = len(body) // 4
                    for s in range(0, n, window):
                        part = body[4 * s : 4 * (s + window)]
                        doc.append(d), start.append(s), length.append(len(part) // 4), crc.append(zlib.crc32(part)), tokens.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (doc, start, length, crc, tokens)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return task


def pieces(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows of doc_id, start, length, ids_crc32 and doc_tokens: each document cut at full windows."""
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path(vocabulary)).read_text())
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return docs.select("doc_id", "text").mapInArrow(_pieces(spec, window), schema)


def closest(counts: dict[int, int], room: int, stops: tuple[int, ...] = ()) -> dict[int, int]:
    """The multiset of lengths, within counts, that fills room; else the greatest stop; else what comes closest to room.

    One bitset a length: bit s is set if the lengths so far can sum to s. Longer lengths
    come first and the search ends when room itself is reached."""
    full, reach, steps = (1 << room + 1) - 1, 1, []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        steps.append((length, reach))
        left, k = min(counts[length], room // length), 1
        while left > 0:  # as many copies as there are, by doubling
            k = min(k, left)
            reach |= reach << k * length & full
            left, k = left - k, 2 * k
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    if total < room:
        total = max((s for s in stops if reach >> s & 1), default=total)
    for length, before in reversed(steps):
        n = 0
        while not before >> total & 1:
            total, n = total - length, n + 1
        if n:
            out[length] = n
    return out


def plan(counts: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """Rows (length, first rank, copies a sequence, first sequence, offset), by length and rank."""
    counts, used, sequence, rows = dict(counts), dict.fromkeys(counts, 0), 0, []
    powers = [1 << k for k in range(window.bit_length()) if 1 << k < window]
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        found = closest(counts, window - longest, tuple(p - longest for p in powers if p >= longest))
        counts[longest] += 1
        found[longest] = found.get(longest, 0) + 1
        times = min(counts[x] // n for x, n in found.items())
        offset = 0
        for x, n in sorted(found.items(), reverse=True):
            rows.append((x, used[x], n, sequence, offset))
            offset += x * n
            used[x] += n * times
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placed(steps):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = steps.value
        key = (p[:, 0] << 48) + p[:, 1]
        for b in batches:
            length, rank = (np.asarray(b.column(i)) for i in (2, 5))
            row = p[np.searchsorted(key, (length << 48) + rank, "right") - 1]
            nth = rank - row[:, 1]
            cols = [*b.columns[:5], pa.array(row[:, 3] + nth // row[:, 2]), pa.array(row[:, 4] + nth % row[:, 2] * length)]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:5], "sequence_id", "offset"])

    return task


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, slots: int | None = None) -> DataFrame:
    """The pieces of every row of docs with their sequence_id and offset."""
    spark = docs.sparkSession
    at = Scratch(spark, "pack")
    cut = at.write(pieces(docs, window, vocabulary), "pieces")
    slots = slots or max(SLOTS, cut.count() // SLOT_ROWS)
    cut = cut.withColumn("slot", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(slots)).cast("int"))
    sums = at.write(cut.groupBy("length", "slot").agg(F.count(F.lit(1)).alias("n")), "counts")
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most window rows
    steps = spark.sparkContext.broadcast(plan(counts, window))
    before = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("length", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("length", "slot").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("nth", F.row_number().over(within)).join(ahead, ["length", "slot"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("ahead") + F.col("nth") - 1).alias("rank"))
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return ranked.mapInArrow(_placed(steps), schema)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spread_table(spark, sf_dir, "documents", "doc_id"))
