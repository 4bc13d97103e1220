"""Keyed tables in hash buckets: a write touches the buckets of its keys and no others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as H
from .storage import delete, exists, names, read_text, write_text

BUCKETS = 64


class KeyedTable:
    """Rows unique by keys under a path, in folders rows/bucket=<n> by a hash of the keys. One writer at a time.

    A write merges its rows with those of their buckets only, lays the new buckets down
    whole beside the table, and then puts them in the place of the old ones (Spark's dynamic
    partition overwrite). From the moment they are whole they count: a reader takes them
    instead of the old ones, and the next writer finishes what one that died had begun. What
    isn't whole never counts."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys
        said = read_text(spark, f"{self.path}/buckets")
        self.buckets = int(said) if said else buckets

    def _read(self, folder: str, buckets: list[int] | None = None, but: bool = False) -> DataFrame:
        """Rows of a folder, with their bucket; those of some buckets or of all but these."""
        at = f"{self.path}/{folder}"
        if not exists(self.spark, at):
            return self.spark.createDataFrame([], f"{self.schema}, bucket int")
        df = self.spark.read.schema(f"{self.schema}, bucket int").option("basePath", at).parquet(at)
        own = F.col("bucket").isin(buckets or [])
        return df if buckets is None else df.filter(~own if but else own)

    def _staged(self) -> list[int]:
        """Buckets that lie whole beside the table."""
        at = f"{self.path}/staged"
        return [int(n[7:]) for n in names(self.spark, at) if n.startswith("bucket=")] if exists(self.spark, f"{at}/_SUCCESS") else []

    def _now(self) -> DataFrame:
        if staged := self._staged():
            return self._read("rows", staged, but=True).unionByName(self._read("staged"))
        return self._read("rows")

    def read(self) -> DataFrame:
        return self._now().drop("bucket")

    def _apply(self) -> None:
        """Puts staged buckets into their places; doing it twice does no harm."""
        if self._staged():
            self._read("staged").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/rows")
        delete(self.spark, f"{self.path}/staged")

    def _merge(self, rows: DataFrame, how: Callable[[DataFrame, DataFrame, list[str]], DataFrame]) -> None:
        self._apply()
        if not exists(self.spark, f"{self.path}/buckets"):
            write_text(self.spark, f"{self.path}/buckets", str(self.buckets))
        new = rows.select(*self._read("none").drop("bucket").columns, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket"))
        new.write.mode("overwrite").parquet(f"{self.path}/new")
        new = self.spark.read.schema(new.schema).parquet(f"{self.path}/new")
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most all buckets
        if touched:
            merged = how(self._read("rows", touched), new, [*self.keys, "bucket"])
            merged.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/staged")
            self._apply()
        delete(self.spark, f"{self.path}/new")

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace those of equal keys; of rows with one key the greatest wins."""
        self._merge(rows, H.upsert)

    def insert_ignore(self, rows: DataFrame) -> None:
        """Rows with new keys are added; of rows with one key the least wins."""
        self._merge(rows, H.insert_ignore)
