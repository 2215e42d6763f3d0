"""Predicates of market events as columns. Nulls in what they judge make them false, so that bad rows can't slip through."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the predicates below: the modes of an envelope and its clock's slack of 60 s; premiums within 0.1, shares that add
# up to 1 within 0.001, funding rates within 0.05.

def holds(*tests: Column) -> Column:
    """All tests, null counting as false."""
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out


def finite(*columns: str) -> Column:
    return holds(*[F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in columns])


def envelope_valid(step: Column, now: Column, schema: int = 1, modes: tuple[str, ...] = ("live", "backfill", "recovery"), slack_ms: int = 60_000) -> Column:
    """A known schema and mode, a start on the grid, an end one step on, and receipt after the end, but not in the future."""
    start, end, got = F.col("period_start_ms"), F.col("period_end_ms"), F.col("received_at_ms")
    return holds(F.col("schema_version") == schema, F.col("mode").isin(*modes), F.pmod(start, step) == 0, end == start + step, end <= got, got <= now + slack_ms)


def candle_valid() -> Column:
    low, high = F.least("open", "close"), F.greatest("open", "close")
    return holds(finite("open", "high", "low", "close", "volume"), F.least("open", "high", "low", "close") > 0, F.col("volume") >= 0, F.col("low") <= low, F.col("high") >= high)


def premium_valid(limit: float = 0.1) -> Column:
    """An index near zero that may be negative."""
    return holds(finite("open", "high", "low", "close"), *[F.abs(c) < limit for c in ("open", "high", "low", "close")], F.col("low") <= F.col("high"))


def shares_valid(long: str, short: str, slack: float = 0.001) -> Column:
    """Two shares of a whole."""
    return holds(F.col(long).between(0, 1), F.col(short).between(0, 1), F.abs(F.col(long) + F.col(short) - 1) <= slack)


def funding_valid(limit: float = 0.05) -> Column:
    return holds(finite("rate"), F.abs("rate") < limit, F.coalesce(F.col("mark"), F.lit(0.0)) >= 0)


def canonical(**fields: Column) -> Column:
    """JSON with sorted keys and no space, of string and whole-number columns; a null is null."""
    parts = []
    for k in sorted(fields):
        kind = fields[k]
        parts += [F.lit(("," if parts else "{") + f'"{k}":'), kind]
    return F.concat(*parts, F.lit("}"))


def quoted(c: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(c.cast("string"), r"\\", r"\\\\"), '"', r'\\"')
    return F.coalesce(F.concat(F.lit('"'), text, F.lit('"')), F.lit("null"))


def number(c: Column) -> Column:
    return F.coalesce(c.cast("long").cast("string"), F.lit("null"))


def cleaned(value: str) -> Column:
    """A measure that is positive by nature: others are missing."""
    return F.when(F.col(value) > 0, F.col(value))
