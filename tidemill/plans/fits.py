"""Walk-forward fits with early stopping, kept by fold and parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemill.operators.boosting import Params, walk_forward
from tidemill.plans.dual import run
from tidemill.registry import query
from tidemill.streaming.sinks import shared_place

FEATURES, PARAMS = 5, Params(rounds=5, depth=3, bins=16)
#: Labels that a fit may take: open orders, and dear ones.
LABELS = {"open": "CAST(o_orderstatus = 'O' AS INT)", "dear": "CAST(o_totalprice > 150000 AS INT)"}


def samples(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """Orders as samples of yearly folds: train up to half a year before the fold's year, es up to it, test in it."""
    x = "array(CAST(least(o_totalprice / 25000, 15) AS INT), month(o_orderdate) - 1, weekday(o_orderdate), CAST(left(o_orderpriority, 1) AS INT), CAST(o_custkey % 13 AS INT))"
    x = x if label == "open" else x.replace("CAST(least(o_totalprice / 25000, 15) AS INT)", "CAST(o_orderkey % 16 AS INT)")
    rows = run(spark, sf_dir, f"SELECT o_orderkey, o_orderdate AS d, {LABELS[label]} AS y, {x} AS x FROM {{orders}}")
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(1998), F.lit(2000))))
    first = F.make_date("fold", F.lit(1), F.lit(1))
    part = F.when(F.col("d") < F.add_months(first, -6), "train").when(F.col("d") < first, "es").when(F.year("d") == F.col("fold"), "test")
    return rows.withColumn("part", part).where("part IS NOT NULL")


@query("j12_walk_forward")
def walk_forward_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the test year of each fold."""
    found = walk_forward(samples(spark, sf_dir, "open"), "o_orderkey", FEATURES, PARAMS, shared_place(spark, "fits"))
    return found.where("part = 'test'").select("fold", "o_orderkey", F.round("p", 8).alias("p"))


@query("o09_fold_quantiles")
def fold_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of each fold, from its early-stopping rows, and how many test rows reach them; another label than j12's."""
    found = walk_forward(samples(spark, sf_dir, "dear"), "o_orderkey", FEATURES, PARAMS, shared_place(spark, "fits"))
    cuts = found.where("part = 'es'").groupBy("fold").agg(F.percentile("p", F.lit(0.8)).alias("cut"))
    return found.where("part = 'test'").join(F.broadcast(cuts), "fold").groupBy("fold").agg(F.round(F.first("cut"), 8).alias("cut"), F.count_if(F.col("p") >= F.col("cut")).alias("above"), F.count(F.lit(1)).alias("n"))
