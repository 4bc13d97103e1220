"""Fits of authors' curves that are kept author by author.

A fit is named by its author and by a digest of what it was made from: the settings, the
first minute and the counts. So a changed history fits its own authors only, everything else
is an anti-join, and a run that broke off goes on with the authors that are left.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import delete, exists, names
from . import curves as C

#: Authors that are fitted in one job, after which their fits count.
CHUNK = 100_000
#: Parts from which on they are written together.
PARTS = 32
FITS = "author_id bigint, digest bigint, base_minute bigint, step_minutes int, coding_prob array<double>, mu double, alpha double, beta double, log_likelihood double, last double, baseline double, model_version string"
KINDS = ("hmm", "hawkes", "state_space")


class AuthorFits:
    """Fits of one kind, step and options under a path, in parts that count once they are whole. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, kind: str, step: int = C.STEP, chunk: int = CHUNK, **options):
        if kind not in KINDS:
            raise ValueError(f"unknown curves.kind: {kind}")
        self.spark, self.path, self.kind, self.step, self.chunk, self.options = spark, path.rstrip("/"), kind, step, chunk, options
        self.settings = json.dumps([kind, step, options], sort_keys=True)

    def _digest(self) -> Column:
        return F.xxhash64(F.lit(self.settings), F.col("base_minute"), F.col("counts"))

    def _parts(self) -> list[int]:
        own = [n[5:] for n in names(self.spark, self.path) if n.startswith("part-")]
        return sorted(int(n) for n in own if n.isdigit() and exists(self.spark, f"{self.path}/part-{n}/_SUCCESS"))

    def _append(self, fits: DataFrame) -> None:
        n = max(self._parts(), default=-1) + 1
        fits.select(*[c.split(" ")[0] for c in FITS.split(", ")]).write.mode("overwrite").parquet(f"{self.path}/part-{n}")

    def saved(self, *columns) -> DataFrame:
        """All fits there are, also of histories that have changed since; with columns, just these beside author_id and digest, so that no curve is shuffled for them."""
        parts = self._parts()
        df = self.spark.read.schema(FITS).parquet(*[f"{self.path}/part-{n}" for n in parts]) if parts else self.spark.createDataFrame([], FITS)
        df = df.select("author_id", "digest", *columns) if columns else df
        return df.dropDuplicates(["author_id", "digest"]) if len(parts) > 1 else df

    def missing(self, grid: DataFrame) -> DataFrame:
        """The rows of a grid, with their digest, that have no fit; a step that has no count is no part of them."""
        own = grid.withColumn("digest", self._digest())
        own = own.drop("counts") if {"met", "steps"} <= set(grid.columns) else own
        return own.join(self.saved().select("author_id", "digest"), ["author_id", "digest"], "left_anti")

    def curves(self, grid: DataFrame, *columns) -> DataFrame:
        """The fits of just these histories; with columns, just these beside author_id and digest."""
        return self.saved(*columns).join(grid.select("author_id", self._digest().alias("digest")), ["author_id", "digest"], "left_semi")

    def _fit(self, grid: DataFrame) -> DataFrame:
        """The fits of rows of ``missing``, whose digest goes with them."""
        if self.kind == "state_space":
            out = C.filtered(grid, self.step, carry=("digest",), **self.options).withColumns({"step_minutes": F.lit(self.step), "model_version": F.lit(self.kind)})
        else:
            out = C.fitted(grid, self.kind, self.step, carry=("digest",), **self.options)
        types = dict(c.split(" ", 1) for c in FITS.split(", "))
        return out.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in out.columns})

    def fit(self, grid: DataFrame) -> int:
        """Fits the authors of a grid that have no fit, chunk by chunk; how many those were."""
        todo = f"{self.path}/todo"
        self.missing(grid).write.mode("overwrite").parquet(todo)
        left = self.spark.read.parquet(todo)
        n = left.count()
        chunks = -(-n // self.chunk)
        for k in range(chunks):
            self._append(self._fit(left.filter(F.pmod(F.xxhash64("author_id", F.lit(3)), F.lit(chunks)) == k) if chunks > 1 else left))
        delete(self.spark, todo)
        if len(self._parts()) > PARTS:
            self._gather(grid)
        return n

    def _gather(self, grid: DataFrame) -> None:
        """Writes the fits of the present histories together; those of older ones go."""
        old = self._parts()
        self._append(self.curves(grid))
        for n in old:
            delete(self.spark, f"{self.path}/part-{n}")

    def take(self, fits: DataFrame) -> None:
        """Takes in fits that ``saved`` of another place gave, made with the same settings; equal ones do no harm."""
        if unlike := [c for c in FITS.split(", ") if c.split(" ")[0] not in fits.columns]:
            raise ValueError(f"not fits, without {', '.join(unlike)}")
        self._append(fits.filter(F.col("model_version") == self.kind).filter(F.col("step_minutes") == self.step))
