"""Rows in a drawn order: permutations, rolls and draws without replacement that no task sees whole.

Draws are a function of a row's id and a seed, so a run repeats itself on any number of partitions. Places in a drawn order are
counted by chunks of the draw, of which each has its share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemill.operators.folds import running

#: A prime and two multipliers of Lehmer's generator; products of a draw stay below 2**63.
PRIME, STEP, TURN = 2_147_483_647, 48_271, 69_621
#: Chunks of a drawn order.
CHUNKS = 64


def drawn(number: Column, seed: Column | int) -> Column:
    """A whole number from 0 to PRIME - 1 by a row's id and a seed. Ids that differ by less than PRIME never draw the same."""
    number, seed = number.cast("long"), (F.lit(seed) if isinstance(seed, int) else seed).cast("long")
    mixed = F.pmod((F.pmod(number, F.lit(PRIME)) + F.pmod(seed * 7_919 + 1, F.lit(PRIME))) * STEP, F.lit(PRIME))
    low = F.pmod(mixed, F.lit(46_341))  # the order of neighbours is broken up by a term that is not linear
    return F.pmod(mixed * TURN + low * low * 31, F.lit(PRIME))


def drawn_sql(number: str, seed: str) -> str:
    """The same in SQL."""
    mixed = f"((({number}) % {PRIME} + (({seed}) * 7919 + 1) % {PRIME}) * {STEP} % {PRIME})"
    return f"(({mixed} * {TURN} + ({mixed} % 46341) * ({mixed} % 46341) * 31) % {PRIME})"


def numbered(rows: DataFrame, by: list[str], number: str, seed: Column | int, name: str) -> DataFrame:
    """rows with <name>, their place from 1 on in an order drawn by seed, per by; ids (whole numbers) are unique in by."""
    draw = rows.withColumn("_drawn_by", drawn(F.col(number), seed))
    return running(draw, by, F.floor(F.col("_drawn_by") * CHUNKS / PRIME), ["_drawn_by", number], sums={name: F.lit(1).cast("long")}).drop("_drawn_by")


def permuted(rows: DataFrame, by: list[str], number: str, values: list[str], seed: Column | int) -> DataFrame:
    """rows whose values are those of another row of by: a permutation drawn by seed, which may be a column that does not change
    within by, so that many repetitions are one pass. Each row's values are used once."""
    second = seed + 1_000_003 if isinstance(seed, int) else seed + F.lit(1_000_003)
    to = numbered(rows, by, number, seed, "_drawn_place")
    of = numbered(rows, by, number, second, "_drawn_place").select(*by, "_drawn_place", *values)
    return to.drop(*values).join(of, [*by, "_drawn_place"]).select(rows.columns)


def rolled(rows: DataFrame, by: list[str], order: str, values: list[str], shift: Column, chunk: Column) -> DataFrame:
    """rows whose values are those of the row `shift` places before, per by and round its end. order is unique in by, chunk does
    not decrease in it; shift does not change within by."""
    placed = running(rows, by, chunk, [order], sums={"_drawn_place": F.lit(1).cast("long")})
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    of = placed.join(sizes, by).select(*by, (F.pmod(F.col("_drawn_place") - 1 + shift, F.col("_size")) + 1).alias("_drawn_place"), *values)
    return placed.drop(*values).join(of, [*by, "_drawn_place"]).select(rows.columns)
