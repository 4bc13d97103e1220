"""An end-to-end run over synthetic history: curves, labels, a predictor, and a sprint's forecast by the event bus."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import curves as C
from ..operators import forecast as M
from ..operators import history as H
from ..operators import models as N
from ..operators import sprints as P
from ..sources import synthetic
from ..sources.storage import shared_dir
from ..streaming.bus import SprintStore
from .config import Config, Features
from .stages import change_features, estimates, score, training_rows

SPRINT, LENGTH, SCOPE, DONE, GROWN = 1, 14, 40, 15, 20
HEADS = {"mdn": {"y": "mdn"}, "quantile": {"y": "quantile"}, "multitask": {"y": "mdn", "z": "quantile"}}


def run(spark: SparkSession, seed: int = 7, inference: str = "state_space", predictor: str = "mdn", syntax: bool = True, samples: int = 30, epochs: int = 30, n_sims: int = 5000) -> DataFrame:
    """Forecasts of a sprint of the last SCOPE commits, of which DONE are done and five have grown, in two scenarios."""
    at = shared_dir(spark, "demo")
    step, config = synthetic.STEP, Config(features=Features(use_syntax=syntax, tokens_max_features=256, tokens_min_df=1))

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{at}/{name}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    rows = kept(synthetic.commits(spark, seed=seed), "commits")
    changes = synthetic.changes(rows, seed).select(F.col("id").alias("commit_id"), "author_id", "authored_at", F.lit("python").alias("language"), "diff_text", "before_blobs", "after_blobs")
    changes = kept(changes, "changes")
    commits = changes.select("author_id", "commit_id", "authored_at", F.col("commit_id").cast("string").alias("sha"))
    grid = C.grids(commits, step, 60, 0 if inference == "hmm" else 1)
    curves = C.filtered(grid, step) if inference == "state_space" else C.fitted(grid, inference, step)
    features, vocab = change_features(changes, config)
    features = kept(features, "features")
    labels = training_rows(H.commit_pairs(commits, ("sha",)), curves, features, samples, seed, step, synthetic.pull_requests(rows, seed))
    model = N.train(labels, HEADS[predictor], epochs=epochs, seed=seed)

    last = changes.select("commit_id", "authored_at").orderBy(F.desc("authored_at"), F.desc("commit_id")).limit(SCOPE)
    scope = kept(last.select(F.row_number().over(Window.orderBy("authored_at", "commit_id")).alias("k"), F.col("commit_id").alias("item_id")), "scope")
    start = dt.date(2025, 1, 6) + dt.timedelta(days=synthetic.DAYS - 7)
    days = [start + dt.timedelta(days=d) for d in range(LENGTH)]
    team = synthetic.AUTHORS
    head = [(0, "configured", SPRINT, start, None, LENGTH, [0, 1, 2, 3, 4])] + [(1 + i, "availability", None, d, team * 6.0 - 8.0, None, None) for i, d in enumerate(days) if d.weekday() < 5]
    head = spark.createDataFrame(head, "seq bigint, type string, sprint_id bigint, day date, delta double, length_days int, working_days array<int>")

    def told(first: int, kind: str, keep, **columns) -> DataFrame:
        return scope.filter(keep).select((F.lit(first) + F.col("k")).cast("bigint").alias("seq"), F.lit(kind).alias("type"), "item_id", *[F.lit(v).alias(n) for n, v in columns.items()])

    k = F.col("k")
    events = [told(100, "added", F.lit(True), sprint_id=SPRINT), told(200, "status", k <= DONE, new_status="done"), told(300, "scope", (k > DONE) & (k <= GROWN), scope_factor=1.1)]
    scored = score(features.join(scope.filter(k > DONE), F.col("id") == F.col("item_id"), "left_semi").select("id", F.col("features").alias("x")), model)
    store = SprintStore(spark, f"{at}/bus")
    out = head
    for e in [*events, estimates(scored, 1000, f"{predictor}:{seed}")]:
        out = out.unionByName(e, allowMissingColumns=True)
    store.publish(out)

    prior = tuple(max(1.0, team * 4.0 + (i % 5 - 2) * 1.5) for i in range(60))
    off = P.on_days(days[2:4])
    scenarios = {"scope +10 %": (lambda items: P.scope_growth(items, 1.1), lambda caps: caps), "team off 2 days": (lambda items: items, lambda caps: P.time_off(caps, -team * 3.0, off))}
    items = store.current().join(store.state("effort").select("item_id", F.col("payload").alias("effort")), "item_id", "left")
    return M.sprint_forecasts(items, store.state("conf"), store.state("caps"), prior, n_sims, seed, scenarios)
