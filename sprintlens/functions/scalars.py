"""Scalar expressions: time buckets, labels, languages, calendars, story points."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Standard normal quantiles, token pattern, weights of the delivery label, suffixes of languages.
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
#: Standard normal quantiles of 0.5, 0.8 and 0.9.
Z50, Z80, Z90 = 0.0, 0.8416212335729143, 1.2815515655446004
#: Tokens of source text: names, the four two-character comparisons, any other visible character.
TOKEN = r"[A-Za-z_][A-Za-z_0-9]*|==|!=|<=|>=|(?U)[^\s\x1c-\x1f]"
TOKEN_ASCII = r"[A-Za-z_][A-Za-z_0-9]*|==|!=|<=|>=|\S"


def minute(ts: Column) -> Column:
    """Whole minutes since the epoch, whatever the session's zone."""
    return F.floor(F.unix_timestamp(ts) / 60).cast("bigint")


def hours_between(start: Column, end: Column) -> Column:
    """Hours from start to end, at least 0."""
    return F.greatest(F.lit(0.0), F.timestamp_diff("MICROSECOND", start, end) / 3.6e9)


def clipped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def delivery_label(y: Column, cycle_hours: Column, rounds: Column, comments: Column, failures: Column, noise: Column | None = None) -> Column:
    """Delivery effort from coding effort and review friction, in [0, 1]."""
    out = F.least(F.lit(1.0), y + 0.2 * F.least(F.lit(1.0), cycle_hours / 48) + 0.05 * rounds + 0.01 * comments + 0.02 * failures)
    return out if noise is None else clipped(out + noise)


def language(files: Column) -> Column:
    """Language of a change: python before java before javascript by any file's suffix."""

    def some(*ends: str) -> Column:
        return F.exists(files, lambda f: _any([F.lower(f).endswith(e) for e in ends]))

    return F.when(some(".py"), "python").when(some(".java"), "java").when(some(".js", ".ts"), "javascript").otherwise("unknown")


def first_file_language(files: Column) -> Column:
    """Language by the first file alone, case kept, without .ts."""
    f = F.get(files, F.lit(0))
    return F.when(f.endswith(".py"), "python").when(f.endswith(".java"), "java").when(f.endswith(".js"), "javascript").otherwise("unknown")


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def matches(value: Column, include: list[str], exclude: list[str]) -> Column:
    """Include and exclude patterns as a condition: lower-cased substrings, or regexes after ``re:``.

    No include pattern lets all pass; otherwise one has to hit. No exclude pattern may hit."""
    low = F.lower(value)

    def hit(p: str) -> Column:
        p = p.strip()
        return low.rlike("(?i)" + p[3:]) if p.startswith("re:") else low.contains(p.lower())

    inc = _any([hit(p) for p in include]) if include else F.lit(True)
    return inc & ~_any([hit(p) for p in exclude])


def glob_condition(value: Column, globs: list[str]) -> Column:
    """Whether the whole value matches one of the shell patterns (*, ?, [..])."""
    import fnmatch

    return _any([value.rlike("^" + re.sub(r"^\(\?s:(.*)\)\\[zZ]$", r"\1", fnmatch.translate(g)) + "$") for g in globs])


def module_name(path: Column) -> Column:
    """Dotted module of a path: the last suffix goes, slashes become dots."""
    return F.translate(F.regexp_replace(path, r"\.[^./]*$", ""), "/", ".")


def safe_name(x: Column) -> Column:
    return F.translate(x, "/#: ", "____")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def lognormal_quantiles(mean: Column, cv: float) -> tuple[Column, Column, Column]:
    """50, 80 and 90 % quantiles of the lognormal with this mean and coefficient of variation."""
    import math

    s2 = math.log(max(1e-6, cv) ** 2 + 1)
    mu = F.log(F.greatest(mean, F.lit(1e-6))) - s2 / 2
    return tuple(F.exp(mu + math.sqrt(s2) * z) for z in (Z50, Z80, Z90))


def parse_iso(text: Column) -> Column:
    """ISO-8601 text, Z allowed, as a timestamp; null if malformed."""
    return F.try_to_timestamp(text)


def merged_paths(first: Column, second: Column) -> Column:
    """Two lists of paths as one, in order; where both have any, repeats go."""
    a, b = F.coalesce(first, F.array().cast("array<string>")), F.coalesce(second, F.array().cast("array<string>"))
    both = F.concat(a, b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.array_distinct(both)).otherwise(both)
