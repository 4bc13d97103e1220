"""Spelling variants of a corpus's words, grouped by asymmetric q-chunks.

A word of L code points is filed under its two disjoint chunks, its first L // 2 code points
and the rest. Another word that one edit turns into it keeps one of the chunks whole, no
further than one place from where it was. So the other side is filed under all its grams of
a chunk's length that begin within one place of a chunk's, and the two sides meet in an
equi-join on (length of the chunked word, which chunk, its text). Every meeting is verified
by edit distance. The chunked word is the shorter one, or the smaller of two equal lengths,
so each pair of words is found from one side only. Keys are 64-bit hashes: equal hashes of
unequal grams only add meetings to verify.

Words are counted inside the tasks before anything is shuffled: a word that makes up a third
of the corpus arrives as one row a task and flush. Pairs are joined between distinct words,
with AQE splitting a chunk that many words share. Chains of forms at least double a count at
each step, so pointer doubling ends after a few rounds; each round is a written table.

A null text has no words. A null doc_id counts as the empty text before the colon. Rows that
repeat a doc_id are texts of their own under that id. Runs and words may have any length.
Other columns are ignored; an empty table gives an empty result. Ties between near words of
one count go to the smaller word by code points.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, spread_table

#: Letters of a run, after A-Z are lower-cased.
LETTERS = "a-zÀ-ÿ"
#: One in so many (document, run) pairs loses a code point.
SLIP = 97
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: Distinct words that a task holds before it passes their counts on.
HELD = 200_000


def slipped(run: str, h: int, slip: int = SLIP) -> str:
    """The run without its code point h % length, if slip divides h."""
    if h % slip:
        return run
    cut = h % len(run)
    return run[:cut] + run[cut + 1 :]


def _counted(slip: int, least: int, held: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"[{LETTERS}]+").findall
        total: Counter[str] = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in Counter(runs(text.encode().lower().decode())).items():  # bytes: A-Z only
                    word = slipped(run, zlib.crc32(run.encode(), head), slip)
                    if len(word) >= least:
                        total[word] += n
                if len(total) > held:
                    yield _counts(total)
                    total.clear()
        yield _counts(total)

    return count


def _counts(total: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT, slip: int = SLIP, held: int = HELD) -> DataFrame:
    """word and n (occurrences over all texts) of the words of at least ``least`` code points and ``count`` occurrences."""
    parts = docs.select("doc_id", "text").mapInArrow(_counted(slip, least, held), "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= count)


def _key(length: Column | int, which: int, gram: Column) -> Column:
    return F.xxhash64(F.lit(length) if isinstance(length, int) else length, F.lit(which), gram)


def _chunks(word: Column, size: Column) -> Column:
    """Keys of a word's two disjoint chunks."""
    half = (size / 2).cast("int")
    return F.array(_key(size, 0, F.substring(word, F.lit(1), half)), _key(size, 1, F.substring(word, half + 1, size - half)))


def _grams(word: Column, size: Column, least: int) -> Column:
    """Keys of a word's grams that can be a chunk of a word as long as it, or one shorter, shifted by one place at most."""
    keys = []
    for shorter in (0, 1):
        other = size - shorter
        half = (other / 2).cast("int")
        for which, at, length in ((0, F.lit(0), half), (1, half, other - half)):
            for shift in (-1, 0, 1):
                inside = (at + shift >= 0) & (at + shift + length <= size) & (other >= least)
                keys.append(F.when(inside, _key(other, which, F.substring(word, at + shift + 1, length))))
    return F.array_distinct(F.array_compact(F.array(*keys)))


#: Which letters a word has, as bits.
_LETTERS = "aggregate(split(word, ''), 0L, (m, c) -> m | shiftleft(1L, cast(ascii(c) % 61 AS int)))"


def near_pairs(words: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """a, a_n, b, b_n: each pair of words, once, that one inserted, deleted or replaced code point turns into each other.

    words: distinct ``word``, of ``least`` code points or more, and its count ``n``."""
    size = F.length("word")
    words = words.withColumn("letters", F.expr(_LETTERS))
    left = words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("letters").alias("a_letters"), F.explode(_chunks(F.col("word"), size)).alias("key"))
    right = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("letters").alias("b_letters"), F.explode(_grams(F.col("word"), size, least)).alias("key"))
    once = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    alike = F.bit_count(F.col("a_letters").bitwiseXOR(F.col("b_letters"))) <= 2  # one edit takes one letter and brings one at most
    met = left.hint("merge").join(right, (left.key == right.key) & alike & once & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "a_n", "b", "b_n").distinct()


def variants(docs: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT, ratio: int = RATIO, slip: int = SLIP) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the corpus."""
    at = Scratch(docs.sparkSession, "spelling")
    words = at.write(vocabulary(docs, least, count, slip), "words")
    pairs = at.write(near_pairs(words, least), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    taken = -F.col("best.less") >= ratio * F.col("n")
    formed = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")
    )
    formed = at.write(formed, "formed")
    roots = _roots(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("up")), at)
    out = formed.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("up", "word").alias("root"), "n", "n_near", "form_n")


def _roots(ups: DataFrame, at: Scratch) -> DataFrame:
    """word and the end (``up``) of its chain, by doubling; chains have no rounds."""
    ups, k = at.write(ups, "up0"), 0
    while True:
        k += 1
        further = ups.select(F.col("word").alias("up"), F.col("up").alias("further"))
        longer = ups.join(further, "up", "left").select("word", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved"))
        longer = at.write(longer, f"up{k}")
        if longer.filter("moved").isEmpty():
            return longer.select("word", "up")
        at.delete(f"up{k - 1}")
        ups = longer.select("word", "up")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of ``documents``: word, form, root, n, n_near, form_n."""
    return variants(spread_table(spark, sf_dir, "documents", "doc_id"))


def crc_table() -> list[int]:
    """The 256 steps of the CRC-32 of zlib: reflected polynomial 0xEDB88320."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = (x >> 1) ^ (0xEDB88320 * (x & 1))
        out.append(x)
    return out


def sql() -> str:
    """DuckDB: CRC-32 byte by byte; near words share a deletion or a replaced place."""
    step = f"CAST({crc_table()} AS BIGINT[])"
    return f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents),
own AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
coded AS (
  SELECT *, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CAST(unicode(c) AS BIGINT)) AS points FROM own),
bytes AS (
  SELECT run, n, flatten(list_transform(points, lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 + p // 64, 128 + p % 64] END)) AS bytes FROM coded),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], bytes),
    lambda acc, b: xor(acc >> 8, {step}[xor(acc & 255, b) + 1]))) AS h
  FROM bytes),
cut AS (
  SELECT CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words),
holes AS (SELECT word, n, k, substr(word, 1, k - 1) AS head, substr(word, k + 1) AS tail FROM places),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.k = b.k AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.head || a.tail = b.word
  UNION
  SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.head || a.tail = b.word),
best AS (
  SELECT word, count(*) AS n_near, min({{'less': -near_n, 'near': near}}) AS best FROM pairs GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= {RATIO} * w.n THEN best.near END AS form, CASE WHEN -best.less >= {RATIO} * w.n THEN -best.less END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, coalesce(form, word) AS up, form IS NULL AS whole FROM formed
  UNION ALL
  SELECT c.word, coalesce(f.form, c.up), f.form IS NULL FROM chain c JOIN formed f ON c.up = f.word WHERE NOT c.whole)
SELECT word, form, up AS root, n, n_near, form_n FROM formed JOIN chain USING (word) WHERE whole
"""
