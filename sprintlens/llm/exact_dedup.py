"""Exact dedup by content-defined chunk recipes.

A text is cut where a rolling hash of its last 32 bytes has zeros in a mask, so equal
passages cut alike wherever they stand. A document becomes the ordered list of its chunks'
identifiers, its recipe, and documents are equal exactly when their recipes are. The texts
move once, as chunks, to verify that equal identifiers mean equal bytes; after that only
recipes are grouped and joined.

Null and empty texts have the empty recipe and form one group. Of a group the largest doc_id
stays (null doc_id only if there is no other). ``exact_dedup`` decides by doc_id, so that
rows of one doc_id and text have one decision; ``keep_one`` decides by row and keeps exactly
one of each group. ``exact_dedup`` reads only ``doc_id`` and ``text``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, join_groups, kept_rows, numbered, spread_table

#: Shortest, average (a power of two) and longest chunk in bytes.
MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 4096, 8192, 65536
DIGEST = 16


def _gear() -> np.ndarray:
    """A random word for each byte value, drawn from a digest of the value."""
    return np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=4).digest() for b in range(256)), "<u4").copy()


_GEAR = _gear()


def cut(body: bytes, least: int = MIN_CHUNK, mean: int = MEAN_CHUNK, most: int = MAX_CHUNK) -> list[bytes]:
    """The chunks of a text; each but the last is between least and most long."""
    if len(body) <= least:
        return [body] if body else []
    h = _GEAR[np.frombuffer(body, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # doubles the hashed span up to 32 bytes
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    ends = np.flatnonzero(h & np.uint32((mean - 1) << 16) == 0) + 1
    out, at = [], 0
    while len(body) - at > least:
        i = np.searchsorted(ends, at + least)
        to = min(int(ends[i]) if i < len(ends) else len(body), at + most, len(body))
        out.append(body[at:to])
        at = to
    if at < len(body):
        out.append(body[at:])
    return out


def _digest(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def _recipes(size: int, sizes: tuple[int, int, int]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(x or "").encode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                    pa.array([b"".join(_digest(c, size) for c in cut(t, *sizes)) for t in texts], pa.binary()),
                ],
                ["doc_id", "text_sha256", "recipe"],
            )

    return task


def _chunks(size: int, sizes: tuple[int, int, int], named: bool):
    """A row for each chunk of a text, with the text's digest where named."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, pos, digests, bodies, held = [], [], [], [], 0

            def out():
                columns = [pa.array(pos, pa.int32()), pa.array(digests, pa.binary()), pa.array(bodies, pa.binary())]
                return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *columns] if named else columns, ["text_sha256"] * named + ["pos", "digest", "body"])

            for t in b.column(0).to_pylist():
                body = (t or "").encode()
                name = hashlib.sha256(body).hexdigest() if named else None
                for k, c in enumerate(cut(body, *sizes)):
                    texts.append(name), pos.append(k), digests.append(_digest(c, size)), bodies.append(c)
                    held += len(c)
                if held > 8 << 20:
                    yield out()
                    texts, pos, digests, bodies, held = [], [], [], [], 0
            if pos:
                yield out()

    return task


def exact_dedup(docs: DataFrame, digest_size: int = DIGEST, sizes: tuple[int, int, int] = (MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK)) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs.

    digest_size: bytes of a chunk's digest. Chunks that share a digest and differ get
    different identifiers, so a short one only makes that path busier."""
    spark = docs.sparkSession
    at = Scratch(spark, "exact")
    read = docs.select("doc_id", "text")
    recipes = at.write(read.mapInArrow(_recipes(digest_size, sizes), "doc_id bigint, text_sha256 string, recipe binary"), "recipes")

    columns = "pos int, digest binary, body binary"
    chunks = read.select("text").mapInArrow(_chunks(digest_size, sizes, False), columns)
    distinct = chunks.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("n"))
    clash = at.write(distinct.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"), "clash")
    if not clash.isEmpty():
        chunks = read.select("text").mapInArrow(_chunks(digest_size, sizes, True), f"text_sha256 string, {columns}")
        recipes = at.write(_told_apart(recipes, chunks, clash, digest_size), "resolved")

    groups = at.write(recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    return join_groups(recipes, groups, "recipe", "group_size", recipes.count()).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256"
    )


def _told_apart(recipes: DataFrame, chunks: DataFrame, clash: DataFrame, size: int) -> DataFrame:
    """Recipes in which a chunk of a clashing digest carries its rank among the digest's bodies."""
    own = chunks.join(clash, "digest", "left_semi")
    rank = own.select("digest", "body").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("digest").orderBy("body")))
    named = own.join(rank, ["digest", "body"]).select("text_sha256", F.struct("pos", "rank").alias("at"))
    per_text = named.distinct().groupBy("text_sha256").agg(F.map_from_entries(F.collect_list("at")).alias("ranks"))
    n = (F.octet_length("recipe") / size).cast("int")
    part = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.lpad(F.coalesce(F.try_element_at("ranks", i), F.lit(0)).cast("string"), 10, "0"),
    )
    tail = F.when(n > 0, F.array_join(part, "")).otherwise(F.lit(""))
    return recipes.join(per_text, "text_sha256", "left").select("doc_id", "text_sha256", F.concat("recipe", tail.cast("binary")).alias("recipe"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The input's rows, all columns as they were, of each group of equal texts exactly one."""
    rows = numbered(docs, Scratch(docs.sparkSession, "exact-rows"))
    if rows is None:
        return docs.join(exact_dedup(docs).filter("kept").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    found = exact_dedup(rows.select(F.col("row").alias("doc_id"), "body.text")).select(F.col("doc_id").alias("row"), "keep_id")
    best = found.join(rows.select("row", "body.doc_id", "tie"), "row").groupBy("keep_id").agg(F.max(F.struct("doc_id", "tie", "row")).alias("best"))
    return kept_rows(rows, best.select("best.row"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spread_table(spark, sf_dir, "documents", "doc_id"))


def sql(docs: str = "documents") -> str:
    return f"""
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t,
        max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
        count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
      FROM {docs})"""
