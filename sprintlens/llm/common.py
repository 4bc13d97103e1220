"""Helpers that the operators share: shared scratch tables, words, skew-safe joins."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of characters other than space and \t \n \v \f \r.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
_BREAKS = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local session without the setting gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Parquet tables under the shared folder that cut a job's lineage."""

    #: Folders made since some ``passing`` block began; None outside of one.
    _made: list[Scratch] | None = None

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        if Scratch._made is not None:
            Scratch._made.append(self)

    def write(self, df: DataFrame, table: str, folders: str | None = None) -> DataFrame:
        """The table as written, with a folder for each value of the column ``folders``."""
        writer = df.write.partitionBy(folders) if folders else df.write
        with drops_shuffles(self.spark):
            writer.parquet(f"{self.root}/{table}")
        return self.read(table, df)

    def read(self, table: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{table}")

    def delete(self, table: str = "") -> None:
        """Removes a table, or all of them, that nothing reads any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def passing():
    """Scratch tables made within it are deleted in the end: for jobs that write their result inside."""
    old, Scratch._made = Scratch._made, []
    try:
        yield
    finally:
        made, Scratch._made = Scratch._made, old
        for x in made:
            x.delete()


@contextlib.contextmanager
def drops_shuffles(spark: SparkSession):
    """Within it, a finished write frees its shuffle files at once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "true")
        yield
    finally:
        spark.conf.set(key, old) if old is not None else spark.conf.unset(key)


#: A group is heavy with more than this share of the rows, or with more rows than a task should have.
HEAVY_SHARE, TASK_ROWS = 1e-3, 1_000_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined with one row a group, whatever share of the rows one group holds.

    A heavy group has over ``least`` rows, so there are under total / least of them: a
    thousand, or one for each full task of rows. Those are broadcast. The rest is a shuffled
    join whose keys are all light. ``rows`` and ``groups`` should be written tables, as both
    are read twice. Null keys don't match."""
    least = min(total * HEAVY_SHARE, TASK_ROWS)
    value = [c for c in groups.columns if c != key]
    heavy = groups.filter(F.col(size) > least).withColumn("__hit", F.lit(True))
    marked = rows.join(F.broadcast(heavy), key, "left")
    done = marked.filter(F.col("__hit").isNotNull()).drop("__hit")
    rest = marked.filter(F.col("__hit").isNull()).select(*rows.columns)
    light = groups.filter(F.col(size) <= least)
    return done.unionByName(rest.join(light.hint("merge"), key).select(*rows.columns, *value))


def numbered(docs: DataFrame, at: Scratch) -> DataFrame | None:
    """The rows written as (body, row, tie), if doc_id is null or repeated somewhere, else None.

    body holds the columns, row is a number and tie a digest of the whole row, which puts
    rows of one doc_id into an order."""
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("doc_id IS NULL OR n > 1").isEmpty():
        return None
    body = docs.select(F.struct("*").alias("body"))
    return at.write(body.select("body", F.monotonically_increasing_id().alias("row"), F.md5(F.to_json("body")).alias("tie")), "numbered")


def kept_rows(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Of numbered rows those whose row is in kept, with the columns that they had."""
    return rows.join(kept.select("row"), "row", "left_semi").select("body.*")


def running_sums(df: DataFrame, at: Scratch, name: str, order: list[Column], columns: list[str]) -> DataFrame:
    """df with ``<c>_before``, the sum of c over all rows ahead in the order, for each of columns.

    Two levels: rows are dealt by ranges of the order; the ranges' totals, one row a range,
    are summed first, then the rows of a range. The order should be total."""
    ranged = at.write(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), name)
    sums = ranged.groupBy("__part").agg(*[F.sum(c).alias(c) for c in columns])
    whole = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("__part", *[F.coalesce(F.sum(c).over(whole), F.lit(0)).alias(f"__{c}") for c in columns])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}_before") for c in columns])
    rows = rows.join(F.broadcast(ahead), "__part")
    return rows.select(*df.columns, *[(F.col(f"{c}_before") + F.col(f"__{c}")).alias(f"{c}_before") for c in columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table for work on single rows: dealt by key if its files give fewer tasks than there are cores."""
    df = table(spark, sf_dir, name)
    n = spark.sparkContext.defaultParallelism
    return df.repartition(n, key) if df.rdd.getNumPartitions() < n else df


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies: in $TOKENIZER_DIR, else in the installed package."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)
