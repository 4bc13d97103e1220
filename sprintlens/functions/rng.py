"""Counter-based random numbers: a draw is a function of its key, not of the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = float(16**12)


def key(*parts) -> Column:
    return F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def uniform(*parts) -> Column:
    """In [0, 1), from the first 48 bits of an md5 of the key."""
    return F.conv(F.substring(F.md5(key(*parts)), 1, 12), 16, 10).cast("bigint") / F.lit(_SCALE)


def stem(*parts) -> Column:
    """A key's beginning, before its last part."""
    return F.concat(key(*parts), F.lit("|"))


def mark(p: Column) -> Column:
    """What ``below`` compares with for the chance p: the least digits that are too large."""
    digits = F.lpad(F.lower(F.hex(F.ceil(p * F.lit(_SCALE)).cast("bigint"))), 12, "0")
    return F.when(p <= 0, F.lit("")).when(p > 1 - 1 / _SCALE, F.lit("g")).otherwise(F.when(p.isNotNull(), digits))


def below(marked: Column, begun: Column, last: Column) -> Column:
    """uniform of the key of stem and last part < p, by the md5's digits themselves; no digest where p is 0."""
    return (marked != "") & (F.md5(F.concat(begun, last.cast("string"))) < marked)


def normal(*parts) -> Column:
    """Standard normal by Box-Muller on two keyed uniforms."""
    u1, u2 = uniform(*parts, "a"), uniform(*parts, "b")
    return F.sqrt(-2 * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(6.283185307179586) * u2)


def uniform_sql(key_sql: str) -> str:
    """The same draw in DuckDB; key_sql is the joined key."""
    return f"(('0x' || substr(md5({key_sql}), 1, 12))::BIGINT / {_SCALE!r}::DOUBLE)"


def normal_sql(key_sql: str) -> str:
    a, b = uniform_sql(f"{key_sql} || '|a'"), uniform_sql(f"{key_sql} || '|b'")
    return f"(sqrt(-2 * ln(1.0::DOUBLE - {a})) * cos(6.283185307179586::DOUBLE * {b}))"
