"""Running totals, ranks and orders over whole tables.

The check states each with windows over the whole table; here a day or a range of values is a window of its own, and a table of
a row a day carries on from one to the next (operators/folds.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidemill.operators.folds import average_rank, running
from tidemill.plans.dual import duck, run
from tidemill.plans.reports import AUC, CURVE, RANKED, SCORED, TRADES
from tidemill.registry import query


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with total, the sum of r up to each, and peak, the greatest total so far, 0 at least."""
    trades = run(spark, sf_dir, f"WITH {TRADES} SELECT * FROM trades")
    day = F.unix_date(F.col("d").cast("date"))
    summed = running(trades, [], day, ["d", "id"], {"total": F.col("r")})
    return running(summed, [], day, ["d", "id"], maxes={"peak": F.col("total")}).withColumn("peak", F.greatest("peak", F.lit(0.0)))


@query("e06_trade_summary", duck(f"""WITH {TRADES}, {CURVE}, quarters AS (SELECT q, sum(r) AS r FROM trades GROUP BY q)
    SELECT count(*) AS n, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg(r), 6) AS mean_r, round(sum(r), 3) AS sum_r, round(max(peak - total), 3) AS max_drawdown,
           round(avg(CASE WHEN kind = 'O' THEN 1.0 ELSE 0.0 END), 6) AS open_share, (SELECT count(*) FROM quarters WHERE r < 0) AS negative_quarters FROM peaks"""))
def trade_summary(spark, sf_dir):
    curve = _curve(spark, sf_dir)
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    quarters = curve.groupBy("q").agg(F.sum("r").alias("r")).agg(F.count_if(F.col("r") < 0).alias("negative_quarters"))
    whole = curve.agg(F.count(F.lit(1)).alias("n"), share(F.col("r") > 0).alias("win_rate"), F.round(F.avg("r"), 6).alias("mean_r"), F.round(F.sum("r"), 3).alias("sum_r"),
                      F.round(F.max(F.col("peak") - F.col("total")), 3).alias("max_drawdown"), share(F.col("kind") == "O").alias("open_share"))
    return whole.crossJoin(F.broadcast(quarters))  # one row each


@query("e09_monthly_carry", duck(f"""WITH {TRADES}, months AS (SELECT unnest(generate_series((SELECT date_trunc('month', min(d)) FROM trades), (SELECT max(d) FROM trades), INTERVAL 1 MONTH)) AS m),
    sums AS (SELECT m, coalesce((SELECT sum(r) FROM trades WHERE date_trunc('month', d) = m), 0) AS g FROM months)
    SELECT year(m) AS y, month(m) AS mo, round(sum(g) OVER (ORDER BY m), 4) AS carried, round(g, 4) AS gained FROM sums"""))
def monthly_carry(spark, sf_dir):
    """Each month's gain and the total carried on to the next, months without a trade included."""
    trades = run(spark, sf_dir, f"WITH {TRADES} SELECT d, r FROM trades")
    months = trades.groupBy(F.trunc("d", "month").alias("m")).agg(F.sum("r").alias("gained"))
    every = months.agg(F.min("m").alias("a"), F.max("m").alias("b")).select(F.explode(F.expr("sequence(a, b, INTERVAL 1 MONTH)")).alias("m"))
    whole = every.join(months, "m", "left").select("m", F.coalesce("gained", F.lit(0.0)).alias("gained"))  # a row a month
    return whole.select(F.year("m").alias("y"), F.month("m").alias("mo"), F.round(F.sum("gained").over(W.orderBy("m")), 4).alias("carried"), F.round("gained", 4).alias("gained"))


@query("f11_drawdown", duck(f"WITH {TRADES}, {CURVE} SELECT id, round(total, 4) AS total, round(peak - total, 4) AS drawdown FROM peaks"))
def drawdown(spark, sf_dir):
    return _curve(spark, sf_dir).select("id", F.round("total", 4).alias("total"), F.round(F.col("peak") - F.col("total"), 4).alias("drawdown"))


@query("g06_thin_curve", duck(f"WITH {TRADES}, {CURVE}, n AS (SELECT d, id, total, row_number() OVER (ORDER BY d, id) AS k, count(*) OVER () AS n FROM curve) SELECT id, round(total, 4) AS total FROM n WHERE (k - 1) % 50 = 0 OR k = n"))
def thin_curve(spark, sf_dir):
    curve = _curve(spark, sf_dir)
    numbered = running(curve, [], F.unix_date(F.col("d").cast("date")), ["d", "id"], {"k": F.lit(1)})
    return numbered.crossJoin(F.broadcast(curve.agg(F.count(F.lit(1)).alias("n")))).where("(k - 1) % 50 = 0 OR k = n").select("id", F.round("total", 4).alias("total"))


@query("n14_equity_series", duck(f"WITH {TRADES}, {CURVE} SELECT id, round(100 + total, 4) AS equity FROM curve WHERE kind <> 'P'"))
def equity_series(spark, sf_dir):
    return _curve(spark, sf_dir).where("kind <> 'P'").select("id", F.round(F.col("total") + 100, 4).alias("equity"))


@query("o23_trade_percent", duck(f"WITH {TRADES}, {CURVE} SELECT id, round(100 * r / (10000 + total - r), 8) AS pct FROM curve"))
def trade_percent(spark, sf_dir):
    return _curve(spark, sf_dir).select("id", F.round(100 * F.col("r") / (10000 + F.col("total") - F.col("r")), 8).alias("pct"))


@query("n15_cumulative_then_filter", duck(f"WITH {TRADES}, c AS (SELECT id, d, sum(r) OVER (ORDER BY d) AS total FROM trades) SELECT id, round(total, 4) AS total FROM c WHERE year(d) >= 1998"))
def cumulative_then_filter(spark, sf_dir):
    """Trades of one day share the total at its end; the total is taken before the filter."""
    trades = run(spark, sf_dir, f"WITH {TRADES} SELECT id, d, r FROM trades")
    days = trades.groupBy("d").agg(F.sum("r").alias("r"))  # a row a day
    totals = days.select("d", F.sum("r").over(W.orderBy("d")).alias("total"))
    return trades.join(totals, "d").where(F.year("d") >= 1998).select("id", F.round("total", 4).alias("total"))


@query("g07_event_order", duck("SELECT o_orderkey, kind, row_number() OVER (ORDER BY d, kind, o_orderkey) AS k FROM (SELECT o_orderkey, o_orderdate AS d, 1 AS kind FROM {orders} UNION ALL SELECT l_orderkey, min(l_shipdate), 0 FROM {lineitem} GROUP BY l_orderkey) AS e"))
def event_order(spark, sf_dir):
    """Exits (kind 0) before entries of the same time."""
    events = run(spark, sf_dir, "SELECT o_orderkey, o_orderdate AS d, 1 AS kind FROM {orders} UNION ALL SELECT l_orderkey, min(l_shipdate), 0 FROM {lineitem} GROUP BY l_orderkey")
    return running(events, [], F.unix_date(F.col("d").cast("date")), ["d", "kind", "o_orderkey"], {"k": F.lit(1)}).select("o_orderkey", "kind", "k")


_THOUSAND = lambda c: F.floor(F.col(c) / 1000)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, f"WITH {SCORED} SELECT * FROM scored")


@query("e13_roc_auc", duck(f"WITH {SCORED}, {RANKED} SELECT {AUC} AS auc, count(*) AS n FROM ranked"))
def roc_auc(spark, sf_dir):
    good, bad = F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)
    ranked = average_rank(_scored(spark, sf_dir), [], "score", _THOUSAND("score"))
    return ranked.agg(F.round((F.sum(F.when(F.col("y") == 1, F.col("rank")).otherwise(0.0)) - good * (good + 1) / 2) / (good * bad), 6).alias("auc"), F.count(F.lit(1)).alias("n"))


@query("e16_deciles", duck(f"""WITH {SCORED}, r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY lang) AS n FROM scored)
    SELECT CAST(least(floor(rk / n * 10), 9) + 1 AS BIGINT) AS decile, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(CAST(y AS DOUBLE)), 6) AS rate FROM r GROUP BY CAST(least(floor(rk / n * 10), 9) + 1 AS BIGINT)"""))
def deciles(spark, sf_dir):
    """Deciles of the rank within a group (here the language, there the year), ties at their mean rank."""
    ranked = average_rank(_scored(spark, sf_dir), ["lang"], "score", _THOUSAND("score"))
    decile = (F.least(F.floor(F.col("rank") / F.col("n") * 10), F.lit(9)) + 1).cast("long").alias("decile")
    return ranked.groupBy(decile).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg(F.col("y").cast("double")), 6).alias("rate"))


@query("f10_rank_percent", duck(f"WITH {SCORED} SELECT doc_id, round((rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0) / count(*) OVER (PARTITION BY lang), 8) AS pct FROM scored"))
def rank_percent(spark, sf_dir):
    return average_rank(_scored(spark, sf_dir), ["lang"], "score", _THOUSAND("score")).select("doc_id", F.round(F.col("rank") / F.col("n"), 8).alias("pct"))


@query("e25_spearman", duck(f"WITH {SCORED}, two AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS b FROM scored) SELECT round(corr(a, b), 6) AS rho FROM two"))
def spearman(spark, sf_dir):
    first = average_rank(_scored(spark, sf_dir), [], "score", _THOUSAND("score")).select("score", "y", F.col("rank").alias("a"))
    return average_rank(first, [], "y", F.col("y")).agg(F.round(F.corr("a", "rank"), 6).alias("rho"))
