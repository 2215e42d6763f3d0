"""Division, logarithm and rounding of doubles by IEEE rules, where Spark's own fail or differ: a price of zero is a price."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def over(a: Column, b: Column) -> Column:
    """a / b for doubles; by zero it is an infinity, and NaN for 0 / 0."""
    return F.coalesce(F.try_divide(a, b), a * F.pow(b, F.lit(-1.0)))


def ln(x: Column | str) -> Column:
    """The natural logarithm; of zero it is -Infinity, of less null."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.log(x))


def rounded(x: Column, digits: int) -> Column:
    """x times a power of ten, rounded to the nearest whole number (halves away from zero) and divided again, all in doubles, as
    DuckDB's round. Spark's own rounds the shortest decimal of x, which differs where the product is not exact."""
    scale = F.lit(10.0**digits)
    whole = F.rint(x * scale)  # halves to even
    rest = x * scale - whole
    away = F.when((F.abs(rest) == 0.5) & (F.signum(rest) == F.signum(x)), 2 * rest).otherwise(0.0)
    out = (whole + away) / scale
    return F.when(F.isnan(out) | (F.abs(out) == float("inf")), x).otherwise(out)


_TERM = r"((?:[^()]|\([^()]*\))+)"
#: The same in SQL texts, in Spark's dialect and DuckDB's: @ln(x), in which brackets hold no others, and @over(a, b) of simple terms.
SPARK = ((rf"@ln\({_TERM}\)", r"(CASE WHEN \1 = 0 THEN -double('Infinity') ELSE ln(\1) END)"), (r"@over\(([^(),]+), ([^(),]+)\)", r"coalesce(try_divide(\1, \2), \1 * pow(\2, -1))"))
DUCK = ((r"@ln\(", "ln("), (r"@over\(([^(),]+), ([^(),]+)\)", r"\1 / \2"))
