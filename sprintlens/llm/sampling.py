"""A bounded sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(doc_id: Column, mod: int) -> Column:
    """crc32 of the doc_id as text, modulo mod: which fold a document is in."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def labelled(docs: DataFrame, labels: DataFrame, label: str, usable: Column, bound: int) -> DataFrame:
    """doc_id, text and y (0 or 1) of about ``bound`` documents of each class at most, a row a doc_id.

    usable: condition on doc_id that a label may be learnt from. Labels other than 0 and 1
    count as none; of unequal labels of a doc_id the 1 counts, of unequal texts the least.
    Documents are drawn by a hash of the doc_id. The sample is bounded, so it is broadcast
    to find its texts."""
    own = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & usable)
    own = own.groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    unit = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1_000_000))
    drawn = F.lit(False)
    for y, n in counts.items():
        drawn = drawn | ((F.col("y") == y) & (unit < F.lit(int(1_000_000 * min(1.0, bound / n)))))
    texts = docs.select("doc_id", "text").join(F.broadcast(own.filter(drawn)), "doc_id")
    return texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")
