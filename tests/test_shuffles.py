"""Permutations, rolls and draws: bijections, the same on any partitioning, and what SQL draws."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemill.operators import shuffles


@pytest.mark.parametrize("parts,seed", [(1, 0), (7, 0), (3, 11), (5, 12)])
def test_permutations_are_bijections(spark, parts, seed):
    rows = spark.range(500).selectExpr("id * 3 AS id", "id % 2 AS k", "id AS v", "'x' AS _place").repartition(parts)
    found = shuffles.permuted(rows, ["k"], "id", ["v"], seed).collect()
    assert sorted(r.id for r in found) == [3 * i for i in range(500)] and sorted(r.v for r in found) == list(range(500))
    assert all(r.v % 2 == r.k for r in found)
    moved = {r.id: r.v for r in found}
    assert sum(moved[3 * i] == i for i in range(500)) < 15
    again = shuffles.permuted(rows.repartition(2), ["k"], "id", ["v"], F.lit(seed)).collect()
    assert {r.id: r.v for r in again} == moved


def test_draws_are_those_of_sql(spark):
    rows = spark.range(2000).selectExpr("id * 104729 AS id")
    mine = sorted((r.id, r.d) for r in rows.select("id", shuffles.drawn(F.col("id"), 5).alias("d")).collect())
    theirs = sorted(duckdb.sql(f"SELECT i * 104729 AS id, {shuffles.drawn_sql('i * 104729', '5')} AS d FROM range(2000) AS r(i)").fetchall())
    assert mine == theirs
    values = sorted(d for _, d in mine)
    assert all(abs(v / shuffles.PRIME - k / 2000) < 0.06 for k, v in enumerate(values))


@pytest.mark.parametrize("shift", [0, 1, 30, 99, 100, 130])
def test_rolls(spark, shift):
    rows = spark.range(150).selectExpr("id * 2 AS t", "IF(id < 100, 'a', 'b') AS k", "id AS v").repartition(4)
    found = {r.t: r.v for r in shuffles.rolled(rows, ["k"], "t", ["v"], F.lit(shift), F.floor(F.col("t") / 16)).collect()}
    want = {2 * i: (i - shift) % 100 if i < 100 else 100 + (i - 100 - shift) % 50 for i in range(150)}
    assert found == want
