"""Synthetic change history: office-hour commits, a module that they edit, and their pull requests.

All draws are functions of a key, so the history doesn't depend on partitions.
"""

from __future__ import annotations

import difflib
import random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rng import uniform

AUTHORS, DAYS, STEP, CHANCE, SEED = 10, 35, 5, 0.06, 7
START = "timestamp_ntz'2025-01-06 00:00:00'"
PATH = "tools.py"
BASE = "def area(w, h):\n    return w * h\n\n\ndef share(a, b):\n    return a + b\n"
CHANGED = "author_id bigint, id bigint, authored_at timestamp_ntz, diff_text string, before_blobs map<string,string>, after_blobs map<string,string>"


def commits(spark: SparkSession, authors: int = AUTHORS, days: int = DAYS, chance: float = CHANCE, seed: int = SEED) -> DataFrame:
    """author_id, id, authored_at and pr: a coin a step in office hours; a PR for 8 commits of an author."""
    per = days * 24 * 60 // STEP
    steps = spark.range(authors * per).select(F.floor(F.col("id") / per).alias("author_id"), F.timestamp_add("MINUTE", (F.col("id") % per * STEP).cast("int"), F.expr(START)).alias("authored_at"), "id")
    office = (F.weekday("authored_at") < 5) & (F.hour("authored_at") >= 9) & (F.hour("authored_at") < 17)
    hit = steps.filter(office & (uniform(seed, "synthetic", F.col("id")) < chance))
    w = Window.partitionBy("author_id").orderBy("authored_at")
    return hit.withColumn("pr", F.floor((F.row_number().over(w) - 1) / 8).cast("bigint"))


def edited(code: str, draw: random.Random) -> str:
    """The module after one edit: a function more, a guard, a loop, or another operator."""
    name = f"step_{draw.randrange(10_000)}"
    kind = draw.randrange(4)
    if kind == 0:
        return f"{code}\n\ndef {name}(x):\n    half = x / 2\n    return area(half, x)\n"
    if kind == 1:
        return f"{code}\n\ndef {name}(x):\n    if x == 0:\n        raise ValueError(x)\n    return share(x, 1)\n"
    if kind == 2:
        return f"{code}\n\ndef {name}(rows):\n    best = 0\n    for r in rows:\n        best = max(best, r)\n    return best\n"
    for old, new in ((" == ", " <= "), (" * ", " - "), (" + ", " * ")):
        if old in code:
            return code.replace(old, new, 1)
    return f"{code}\n\nLIMIT_{draw.randrange(10_000)} = 1\n"


def diff(before: str, after: str) -> str:
    return "".join(difflib.unified_diff(before.splitlines(True), after.splitlines(True), f"a/{PATH}", f"b/{PATH}"))


def changes(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Commits (author_id, id, authored_at, pr) with diff_text, before_blobs and after_blobs: each PR edits a module of its own, commit by commit."""
    columns = [c.split(" ")[0] for c in CHANGED.split(", ")]

    def edits(key, f: pd.DataFrame) -> pd.DataFrame:
        code, out = BASE, []
        for at, i in sorted(zip(f["authored_at"], f["id"], strict=True)):
            new = edited(code, random.Random(f"{seed}|{key[0]}|{i}"))
            out.append((key[0], i, at, diff(code, new), {PATH: code}, {PATH: new}))
            code = new
        return pd.DataFrame(out, columns=columns)

    return rows.select("author_id", "pr", "id", "authored_at").groupBy("author_id", "pr").applyInPandas(edits, CHANGED)


def pull_requests(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """The commits' PRs as ``files.pull_requests`` has those of a file: opened with the first commit, merged 2 to 24 hours after the last."""
    g = rows.groupBy("author_id", "pr").agg(F.min("authored_at").alias("opened_at"), F.max("authored_at").alias("last"), F.array_sort(F.collect_list(F.col("id").cast("string"))).alias("commits"))

    def number(name: str, least: int, most: int):
        return (least + F.floor(uniform(seed, name, F.col("author_id"), F.col("pr")) * (most - least + 1))).cast("int")

    wait = (F.lit(120) + uniform(seed, "merge", F.col("author_id"), F.col("pr")) * 1320).cast("int")
    return g.select(
        F.concat_ws("-", F.lit("PR"), "author_id", "pr").alias("pr_id"), F.lit("synthetic/repo").alias("repo"), F.col("author_id").cast("string").alias("author_id"), F.col("opened_at").cast("timestamp").alias("opened_at"),
        F.timestamp_add("MINUTE", wait, F.col("last")).cast("timestamp").alias("merged_at"), "commits", number("rounds", 0, 3).alias("review_rounds"), number("comments", 0, 20).alias("review_comments"),
        number("runs", 1, 6).alias("ci_runs"), number("failures", 0, 2).alias("ci_failures"), F.lit(None).cast("map<string,string>").alias("metadata"),
    )
