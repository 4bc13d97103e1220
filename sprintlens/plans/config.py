"""Settings of the effort pipeline, from TOML."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import tomllib
from dataclasses import dataclass, field
from fnmatch import fnmatch
from pathlib import Path
from typing import get_type_hints


@dataclass(frozen=True)
class Patterns:
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Repos:
    """Repositories by local globs, or (source "remote") by owner/name, cloned below the outputs."""

    source: str = "local"
    include_paths: list[str] = field(default_factory=list)
    exclude_paths: list[str] = field(default_factory=list)
    more_include_paths: list[str] = field(default_factory=list)
    include_remote: list[str] = field(default_factory=list)
    exclude_remote: list[str] = field(default_factory=list)
    url_template: str = "https://github.com/{owner}/{repo}.git"
    mirror: bool = False
    prune: bool = True
    max_commits_per_repo: int = 20_000
    #: Whose suffix gives a change's language: "any" file's, or the "first" one's alone.
    language_by: str = "any"

    def paths(self) -> list[str]:
        """Both lists of globs in order; repeats go where both have any."""
        both = [*self.include_paths, *self.more_include_paths]
        return list(dict.fromkeys(both)) if self.include_paths and self.more_include_paths else both

    def remotes(self) -> list[str]:
        """The owner/name entries that no exclude matches; malformed ones are skipped."""
        return [r for r in self.include_remote if r.count("/") == 1 and not any(fnmatch(r, x) for x in self.exclude_remote)]


@dataclass(frozen=True)
class Hosting:
    """Where pull requests are read from; the token is in the named environment variable."""

    enabled: bool = False
    base_url: str = "https://api.github.com"
    token_env: str = "HOSTING_TOKEN"
    pulls_since: str = ""
    reviews: bool = True


@dataclass(frozen=True)
class Tracker:
    """Where the estimates of the current milestone's issues are read from."""

    enabled: bool = False
    base_url: str = ""
    token_env: str = "TRACKER_TOKEN"
    title_prefix: str = ""
    sprint_days: int = 10
    working_days: list[int] = field(default_factory=lambda: [0, 1, 2, 3, 4])


@dataclass(frozen=True)
class Filters:
    authors: Patterns = Patterns()
    repos: Patterns = Patterns()
    languages: Patterns = Patterns(["python"])


@dataclass(frozen=True)
class Outputs:
    base_dir: str = "effort_outputs"


@dataclass(frozen=True)
class Curves:
    kind: str = "state_space"
    step_minutes: int = 5
    epochs: int = 250
    min_commits_per_author: int = 50


@dataclass(frozen=True)
class Features:
    use_syntax: bool = True
    tokens_max_features: int = 512
    tokens_min_df: int = 2


@dataclass(frozen=True)
class Training:
    label_samples_per_commit: int = 50
    rng_seed: int = 123
    predictor_kind: str = "mdn"
    epochs: int = 60
    save_every_epochs: int = 5
    pull_requests_path: str = ""
    sample: int = 50_000
    steps_per_epoch: int = 16


@dataclass(frozen=True)
class Forecasting:
    n_sims: int = 5000
    rng_seed: int = 123
    sprint_inputs_path: str = ""
    historical_sprints_path: str = ""
    historical_outcomes_path: str = ""
    #: Daily throughput is drawn from the samples ("bootstrap") or from a "lognormal" fitted to them.
    throughput: str = "bootstrap"
    story_points_to_hours: float = 4.0
    story_points_cv: float = 0.6


@dataclass(frozen=True)
class Config:
    repos: Repos = Repos()
    filters: Filters = Filters()
    hosting: Hosting = Hosting()
    tracker: Tracker = Tracker()
    outputs: Outputs = Outputs()
    curves: Curves = Curves()
    features: Features = Features()
    training: Training = Training()
    forecasting: Forecasting = Forecasting()

    @staticmethod
    def load(path: str) -> Config:
        with open(path, "rb") as f:
            return _build(Config, tomllib.load(f), "")

    def fingerprint(self, *sections: str) -> str:
        """SHA-256 of the named sections as canonical JSON."""
        own = {k: v for k, v in dataclasses.asdict(self).items() if k in sections}
        return hashlib.sha256(json.dumps(own, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


#: The languages that changes can have.
LANGUAGES = ("python", "java", "javascript", "unknown")


def _build(kind, values: dict, where: str):
    """A settings object; unknown keys and languages that can't occur are errors."""
    hints = get_type_hints(kind)
    if extra := values.keys() - hints.keys():
        raise ValueError(f"unknown settings: {', '.join(sorted(where + x for x in extra))}")
    if where == "filters.languages." and (bad := [x for x in values.get("include", []) if not x.startswith("re:") and not any(x in y for y in LANGUAGES)]):
        raise ValueError(f"no change has these languages: {', '.join(bad)}")
    return kind(**{k: _build(hints[k], v, f"{where}{k}.") if dataclasses.is_dataclass(hints[k]) else v for k, v in values.items()})


def to_toml(config: Config) -> str:
    out: list[str] = []

    def section(name: str, obj) -> None:
        plain = {f.name: getattr(obj, f.name) for f in dataclasses.fields(obj) if not dataclasses.is_dataclass(getattr(obj, f.name))}
        if plain:
            out.append(f"[{name}]")
            out.extend(f"{k} = {json.dumps(v)}" for k, v in plain.items())
            out.append("")
        for f in dataclasses.fields(obj):
            if dataclasses.is_dataclass(x := getattr(obj, f.name)):
                section(f"{name}.{f.name}" if name else f.name, x)

    section("", config)
    return "\n".join(out)


def write_default(path: str) -> None:
    """Writes the default settings; an existing file is an error."""
    with open(Path(path), "x") as f:
        f.write(to_toml(Config()))
