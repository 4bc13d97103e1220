"""The effort pipeline: mine, infer, train and forecast, each stage skipped if already done.

A stage's tables lie under its fingerprint, so changed settings never read old tables. All
of it may lie on any file system that Spark reads. A change is keyed by its repository and
commit, so that a commit of a fork is a change of its own.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import dist as D
from ..functions import scalars as S
from ..functions.rng import normal
from ..operators import curves as C
from ..operators import features as X
from ..operators import forecast as M
from ..operators import history as H
from ..operators import models as N
from ..operators.fits import AuthorFits
from ..sources import files, git, ingest, rest
from ..sources.storage import read_text, write_text
from .config import Config

STAGES = ("mine", "infer", "train", "forecast")


class RunState:
    """Which stages are done for which fingerprint, in a JSON file replaced whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        try:
            self.stages = json.loads(read_text(spark, path) or "")["stages"]
        except (ValueError, KeyError, TypeError):
            self.stages = {}

    def done(self, stage: str, fingerprint: str) -> bool:
        s = self.stages.get(stage, {})
        return bool(s.get("done")) and s.get("meta", {}).get("fingerprint") == fingerprint

    def mark(self, stage: str, fingerprint: str, **meta) -> None:
        self.stages[stage] = {"done": True, "meta": {"fingerprint": fingerprint, "updated_at": _now(), **meta}}
        write_text(self.spark, self.path, json.dumps({"stages": self.stages}, indent=1))


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def keyed(commits: DataFrame) -> DataFrame:
    """Mined commits with sha, and with commit_id as the key of repository and commit; author_id is a number, author the text."""
    key = F.concat_ws("@", "commit_id", "repo_path")
    return commits.withColumns({"sha": F.col("commit_id"), "commit_id": key, "author": F.col("author_id"), "author_id": F.xxhash64("author_id")})


def training_rows(pairs: DataFrame, curves: DataFrame, features: DataFrame, samples: int, seed: int, step: int, prs: DataFrame | None = None) -> DataFrame:
    """id, commit_id, sample, x, y and z of pairs whose author has a curve; pairs carry sha.

    All draws of a pair come from one row, which holds a slice of its author's curve at most;
    x is joined last. z is the delivery label: y without a merged PR, else raised by its
    review friction."""
    j = C.pair_slices(pairs, curves, step)
    draws = F.transform(C.sample_minutes(step, F.col("gap_minutes").cast("double"), samples, seed, "label", F.col("commit_id")), lambda x: S.clipped(x / 60))
    j = j.select("commit_id", "sha", F.posexplode(draws).alias("sample", "y"))
    if prs is None:
        j = j.withColumn("z", F.col("y"))
    else:
        p = files.pr_by_commit(prs)
        cycle = F.greatest(F.lit(0.0), (F.unix_micros("merged_at") - F.unix_micros("opened_at")) / 3.6e9)
        label = S.delivery_label(F.col("y"), cycle, F.col("review_rounds"), F.col("review_comments"), F.col("ci_failures"), 0.02 * normal(seed, "delivery", F.col("commit_id"), F.col("sample")))
        j = j.join(p, "sha", "left").select("commit_id", "sample", "y", F.when(F.col("merged_at").isNull(), F.col("y")).otherwise(label).alias("z"))
    x = features.select(F.col("id").alias("commit_id"), F.col("features").alias("x"))
    return j.join(x, "commit_id").select(F.xxhash64("commit_id", "sample").alias("id"), "commit_id", "sample", "x", "y", "z")


def change_features(changes: DataFrame, config: Config, vocab: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """id and features of changes (commit_id, language, diff_text, before_blobs, after_blobs), and the vocabulary they were counted in."""
    docs = changes.select(F.col("commit_id").alias("id"), F.col("diff_text").alias("text"))
    if vocab is None:
        vocab = X.vocabulary(docs, config.features.tokens_max_features, config.features.tokens_min_df)
    out = X.token_features(docs, vocab)
    if config.features.use_syntax:
        code = X.code_features(changes.select(F.col("commit_id").alias("id"), "language", "before_blobs", "after_blobs"))
        out = X.assembled([out, code.select("id", F.concat("tree", "graph").alias("features"))])
    return out, vocab


def score(rows: DataFrame, model: N.Model) -> DataFrame:
    """id, mean, p50, p90 and payload (JSON) of the effort of rows (id, x)."""
    target, kind = next(iter(model.heads.items()))
    p = N.predict(rows, model)
    d = F.col(f"{target}_{kind}")
    if kind == "mdn":
        return p.select("id", D.clipped_mean(d).alias("mean"), D.mixture_quantile(0.5)(d).alias("p50"), D.mixture_quantile(0.9)(d).alias("p90"), D.encode_mixture(d).alias("payload"))
    return p.select("id", D.quantile_mean(d).alias("mean"), D.quantile_at(d, F.lit(0.5)).alias("p50"), D.quantile_at(d, F.lit(0.9)).alias("p90"), D.encode_quantiles(d).alias("payload"))


def score_changes(changes: DataFrame, vocab: DataFrame, model: N.Model, config: Config) -> DataFrame:
    """id, mean, p50, p90 and payload of changes as change_features takes them."""
    x, _ = change_features(changes, config, vocab)
    return score(x.select("id", F.col("features").alias("x")), model)


def estimates(scored: DataFrame, first_seq: int, model_version: str) -> DataFrame:
    """Scores as effort events (seq, type, item_id, payload, model_version) to publish on the bus, with numbers from first_seq on."""
    # one estimate an item: numbers need to be new and distinct, not dense
    seq = (F.lit(first_seq) + F.monotonically_increasing_id()).cast("bigint")
    return scored.select(seq.alias("seq"), F.lit("effort").alias("type"), F.col("id").alias("item_id"), "payload", F.lit(model_version).alias("model_version"))


class Pipeline:
    """Runs stages over a configuration; tables lie under base/<stage>/<fingerprint>.

    hosting and tracker are transports for REST calls; by default HTTP with the settings' tokens."""

    def __init__(self, spark: SparkSession, config: Config, hosting: rest.Transport | None = None, tracker: rest.Transport | None = None):
        self.spark, self.config = spark, config
        self.base = os.path.abspath(os.path.expanduser(config.outputs.base_dir)) if "://" not in config.outputs.base_dir else config.outputs.base_dir.rstrip("/")
        self.state = RunState(spark, f"{self.base}/checkpoints/state.json")
        self.store = ingest.Store(spark, f"{self.base}/store")
        self._hosting, self._tracker = hosting, tracker

    SECTIONS = {
        "mine": ("repos", "filters"), "infer": ("repos", "filters", "curves"), "train": ("repos", "filters", "curves", "features", "training", "hosting"),
        "forecast": ("forecasting", "tracker", "repos"),
    }

    def path(self, stage: str, table: str) -> str:
        return f"{self.base}/{stage}/{self.config.fingerprint(*self.SECTIONS[stage])[:16]}/{table}"

    def read(self, stage: str, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(stage, table))

    def run(self, stages: tuple[str, ...] = STAGES, again: bool = False) -> list[str]:
        """Runs the stages that aren't done, or all of these again, as after new commits; returns those that ran."""
        steps: dict[str, Callable[[], dict | None]] = {s: getattr(self, f"_{s}") for s in STAGES}
        if unknown := [s for s in stages if s not in steps]:
            raise ValueError(f"unknown stage: {', '.join(unknown)}")
        ran = []
        for s in stages:
            mark = self.config.fingerprint(*self.SECTIONS[s])
            if again or not self.state.done(s, mark):
                self.state.mark(s, mark, **(steps[s]() or {}))
                ran.append(s)
        return ran

    def _service(self, kind: str) -> rest.Transport:
        given, c = (self._hosting, self.config.hosting) if kind == "hosting" else (self._tracker, self.config.tracker)
        if given:
            return given
        token = os.environ.get(c.token_env, "")
        if not token:
            raise RuntimeError(f"no token in ${c.token_env}")
        return rest.Http(f"Bearer {token}") if kind == "hosting" else rest.Http(token, "X-Authentication-Token")

    def repositories(self) -> list[str]:
        """Local folders of the repositories; remote ones are cloned, or fetched if they are there already."""
        c = self.config.repos
        if c.source == "local":
            return git.discover_repos(c.paths(), c.exclude_paths)
        if c.source != "remote":
            raise ValueError(f"unknown repos.source: {c.source}")
        if not c.include_remote:
            raise ValueError("repos.include_remote is empty")
        root = re.sub("^file://", "", self.base)
        if "://" in root:
            raise ValueError("clones need outputs.base_dir on a file system that all machines mount")
        out = []
        for name in c.remotes():
            owner, repo = name.split("/")
            path = f"{root}/repos/{owner}__{repo}" + (".git" if c.mirror else "")
            os.makedirs(os.path.dirname(path), exist_ok=True)
            out.append(git.clone_or_fetch(c.url_template.format(owner=owner, repo=repo), path, c.mirror, c.prune))
        return out

    def _mine(self) -> None:
        c = self.config
        df = git.mined_commits(self.spark, self.repositories(), c.repos.max_commits_per_repo)
        language = {"any": S.language, "first": S.first_file_language}[c.repos.language_by]
        df = df.withColumn("language", language(F.col("changed_files")))
        keep = S.matches(F.col("repo_path"), c.filters.repos.include, c.filters.repos.exclude)
        keep = keep & S.matches(F.col("language"), c.filters.languages.include, c.filters.languages.exclude) & S.matches(F.col("author_id"), c.filters.authors.include, c.filters.authors.exclude)
        df = H.last_write_wins(df.filter(keep), ["repo_path", "commit_id"], ["authored_at"])
        df.write.mode("overwrite").parquet(self.path("mine", "commits"))

    def _commits(self) -> DataFrame:
        return keyed(self.read("mine", "commits"))

    def fits(self) -> AuthorFits:
        """The authors' fits under the settings of their curves, whatever was mined when."""
        c = self.config.curves
        return AuthorFits(self.spark, f"{self.base}/fits/{self.config.fingerprint('curves')[:16]}", c.kind, c.step_minutes, **({"epochs": c.epochs} if c.kind == "hmm" else {}))

    def _infer(self) -> dict:
        """Fits the authors whose history has no fit yet; a run that broke off goes on."""
        c, fits = self.config.curves, self.fits()
        grid = C.grids(self._commits(), c.step_minutes, c.min_commits_per_author, 0 if c.kind == "hmm" else 1)
        grid.write.mode("overwrite").parquet(self.path("infer", "grid"))
        grid = self.read("infer", "grid")
        n = fits.fit(grid)
        fits.curves(grid).write.mode("overwrite").parquet(self.path("infer", "curves"))
        return {"authors": grid.count(), "fitted": n}

    def _pull_requests(self) -> DataFrame | None:
        """The PRs that delivery labels come from: ingested ones, else those of a file."""
        c = self.config
        if c.hosting.enabled:
            names = c.repos.remotes()
            if not names:
                raise ValueError("hosting needs repos.include_remote")
            ingest.ingest_pulls(self.store, names, self._service("hosting"), c.hosting.pulls_since, c.hosting.reviews, c.hosting.base_url)
            return ingest.stored_prs(self.store)
        return files.pull_requests(self.spark, c.training.pull_requests_path) if c.training.pull_requests_path else None

    def _train(self) -> dict:
        c = self.config
        prs = self._pull_requests()
        changes = keyed(git.with_changes(git.in_ranges(self.read("mine", "commits")), c.features.use_syntax))
        seen = Observation()
        changes = changes.observe(seen, F.count_if(~F.col("readable")).alias("rejects"))
        changes.filter("readable").drop("readable").write.mode("overwrite").parquet(self.path("train", "changes"))
        features, vocab = change_features(self.read("train", "changes"), c)
        vocab.write.mode("overwrite").parquet(self.path("train", "vocabulary"))
        features.write.mode("overwrite").parquet(self.path("train", "features"))
        pairs = H.commit_pairs(self._commits(), ("sha",))
        rows = training_rows(pairs, self.read("infer", "curves"), self.read("train", "features"), c.training.label_samples_per_commit, c.training.rng_seed, c.curves.step_minutes, prs)
        rows.write.mode("overwrite").parquet(self.path("train", "rows"))
        rows = self.read("train", "rows")
        heads = {"mdn": {"y": "mdn"}, "quantile": {"y": "quantile"}, "multitask": {"y": "mdn", "z": "quantile"}}[c.training.predictor_kind]
        if c.training.sample:
            model = N.train(rows, heads, c.training.sample, epochs=c.training.epochs, checkpoint=self._checkpoint())
        else:
            model = N.train_all(rows, heads, epochs=c.training.epochs, steps=c.training.steps_per_epoch, checkpoint=self._checkpoint())
        write_text(self.spark, self.path("train", "model.json"), model.to_json())
        meta = {"predictor_kind": c.training.predictor_kind, "heads": heads, "epochs": len(model.losses), "loss": model.losses[-1] if model.losses else None, "rows": rows.count(), "rejects": seen.get["rejects"], "vocabulary": self.read("train", "vocabulary").count(), "created_at": _now()}
        write_text(self.spark, self.path("train", "metadata.json"), json.dumps(meta, indent=1))
        return {"rows": meta["rows"]}

    def _checkpoint(self) -> N.Checkpoint:
        """Epochs' states beside the model, compressed; a run that broke off goes on from the last one."""
        path = self.path("train", "epochs.json.z")

        def load() -> str | None:
            text = read_text(self.spark, path)
            return zlib.decompress(base64.b64decode(text)).decode() if text else None

        return N.Checkpoint(load, lambda text: write_text(self.spark, path, base64.b64encode(zlib.compress(text.encode(), 1)).decode()), self.config.training.save_every_epochs)

    def model(self) -> N.Model:
        return N.Model.from_json(read_text(self.spark, self.path("train", "model.json")))

    def score(self, changes: DataFrame) -> DataFrame:
        """id, mean, p50, p90 and payload of changes by the trained model."""
        return score_changes(changes, self.read("train", "vocabulary"), self.model(), self.config)

    def _forecast(self) -> dict:
        c = self.config.forecasting
        samples = files.throughput_samples(self.spark, c.historical_sprints_path or None, c.historical_outcomes_path or None)
        if c.sprint_inputs_path:
            got = files.sprint_inputs(self.spark, c.sprint_inputs_path, c.story_points_to_hours, c.story_points_cv)
        elif self.config.tracker.enabled:
            got = self._backlog()
        else:
            raise ValueError("forecast needs forecasting.sprint_inputs_path or the tracker")
        if c.throughput == "lognormal":
            samples = M.fitted_throughput(samples)
        out = M.sprint_forecasts(got["items"], got["conf"], got["caps"], samples, c.n_sims, c.rng_seed)
        out.withColumn("file", S.safe_name(F.col("sprint_id"))).write.mode("overwrite").partitionBy("file").json(self.path("forecast", "forecasts"))
        return {"sprints": got["conf"].count()}

    def _backlog(self) -> dict[str, DataFrame]:
        """The current milestones as sprints; their issues are open items of as many hours as their points say."""
        c, t = self.config, self.config.tracker
        b = ingest.ingest_backlog(self.store, c.repos.remotes(), self._service("hosting"), self._service("tracker"), t.title_prefix, t.sprint_days, c.hosting.base_url, t.base_url)
        conf = b.select("sprint_id", F.col("start_date").alias("start_day"), "length_days", F.array(*map(F.lit, t.working_days)).alias("working_days")).distinct()
        issues = rest.issue_estimates(b.filter("issue_number IS NOT NULL"), self.store.issues.read())
        effort = files.points_effort(F.col("estimate_value"), c.forecasting.story_points_to_hours, c.forecasting.story_points_cv)
        items = issues.select("sprint_id", F.concat_ws("#", "repo", "issue_number").alias("item_id"), F.lit("todo").alias("status"), F.lit(1.0).alias("factor"), effort.alias("effort"))
        caps = self.spark.createDataFrame([], "sprint_id string, day date, available double")
        return {"conf": conf, "caps": caps, "items": items}
