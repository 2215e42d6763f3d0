"""Robust rolling statistics, carries, gates and path statistics per instrument."""

from __future__ import annotations

from pyspark.sql import Column, Window as W, functions as F

from tidemill.functions.ieee import ln
from tidemill.operators.folds import ewm_volatility
from tidemill.operators.pivots import confirmed_pivots
from tidemill.plans import market  # noqa: F401  registers J01
from tidemill.plans.dual import BARS, duck, dual, run
from tidemill.registry import SQL, query

def _of():
    return W.partitionBy("instrument").orderBy("t")


def _bars(spark, sf_dir):
    return run(spark, sf_dir, f"WITH {BARS} SELECT instrument, t, open, high, low, close, volume, ticks FROM bars")


def _rows(k: int) -> W:
    return _of().rowsBetween(1 - k, 0)


def _median(c: str, k: int) -> Column:
    return F.percentile(c, F.lit(0.5)).over(_rows(k))


_ROBUST = """l AS (SELECT instrument, t, ln(1 + volume) AS lv FROM bars), m AS (SELECT *, quantile_cont(lv, 0.5) OVER (PARTITION BY instrument ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS med FROM l)"""


@query("f04_robust_z", duck(f"""WITH {BARS}, {_ROBUST}, d AS (SELECT *, quantile_cont(abs(lv - med), 0.5) OVER (PARTITION BY instrument ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS mad FROM m)
  SELECT instrument, t, round(greatest(-5.0, least(5.0, (lv - med) / greatest(1.4826 * mad, 0.0001))), 6) AS z FROM d"""))
def robust_z(spark, sf_dir):
    """Distance from the rolling median in robust deviations; the deviation of each row is from its own row's median."""
    rows = _bars(spark, sf_dir).withColumn("lv", F.log1p("volume")).withColumn("med", _median("lv", 24)).withColumn("off", F.abs(F.col("lv") - F.col("med")))
    z = (F.col("lv") - F.col("med")) / F.greatest(1.4826 * _median("off", 24), F.lit(1e-4))
    return rows.select("instrument", "t", F.round(F.greatest(F.least(z, F.lit(5.0)), F.lit(-5.0)), 6).alias("z"))


@query("f05_detrended", duck(f"""WITH {BARS}, d AS (SELECT instrument, t, volume - quantile_cont(volume, 0.5) OVER (PARTITION BY instrument ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS x FROM bars)
  SELECT instrument, t, CASE WHEN count(*) OVER w = 6 THEN round(avg(x) OVER w, 6) END AS y FROM d WINDOW w AS (PARTITION BY instrument ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"""))
def detrended(spark, sf_dir):
    rows = _bars(spark, sf_dir).withColumn("x", F.col("volume") - _median("volume", 24))
    return rows.select("instrument", "t", F.round(F.when(F.count("x").over(_rows(6)) == 6, F.avg("x").over(_rows(6))), 6).alias("y"))


_EWM = """r AS (SELECT instrument, t, ln(close) AS lc, coalesce(ln(close) - lag(ln(close)) OVER (PARTITION BY instrument ORDER BY t), 0) AS r, row_number() OVER (PARTITION BY instrument ORDER BY t) AS i FROM bars),
  v AS (SELECT instrument, t, i, r * r AS v FROM r WHERE i = 1 UNION ALL SELECT r.instrument, r.t, r.i, v.v * (1 - 2.0 / 25) + 2.0 / 25 * r.r * r.r FROM v JOIN r ON r.instrument = v.instrument AND r.i = v.i + 1),
  s AS (SELECT r.instrument, r.t, r.lc, r.r, r.i, CASE WHEN r.i >= 24 THEN greatest(sqrt(v), 1e-6) END AS sigma FROM r JOIN v ON v.instrument = r.instrument AND v.i = r.i)"""


def _with_sigma(spark, sf_dir):
    bars = _bars(spark, sf_dir)
    return bars.join(ewm_volatility(bars, "instrument", "t", "close", 24, 400 * 3600), ["instrument", "t"]).withColumn("lc", ln("close"))


@query("f07_trend", duck(f"WITH RECURSIVE {BARS}, {_EWM} SELECT instrument, t, round((lc - lag(lc, 24) OVER w) / (sigma * sqrt(24)), 6) AS trend24, round((lc - lag(lc, 120) OVER w) / (sigma * sqrt(120)), 6) AS trend120 FROM s WINDOW w AS (PARTITION BY instrument ORDER BY t)"))
def trend(spark, sf_dir):
    """Displacement over some bars in units of the volatility expected over as many."""
    z = lambda k: F.round((F.col("lc") - F.lag("lc", k).over(_of())) / (F.col("sigma") * F.sqrt(F.lit(float(k)))), 6).alias(f"trend{k}")
    return _with_sigma(spark, sf_dir).select("instrument", "t", z(24), z(120))


@query("f08_path_statistics", duck(f"""WITH {BARS}, r AS (SELECT instrument, t, ln(close) AS lc, ln(close) - lag(ln(close)) OVER (PARTITION BY instrument ORDER BY t) AS r, row_number() OVER (PARTITION BY instrument ORDER BY t) AS i FROM bars),
  p AS (SELECT b.instrument, b.t, any_value(b.lc) - any_value(a.lc) AS disp, sum(abs(m.r)) AS plen, sum(m.r * m.r) AS sq FROM r AS b JOIN r AS a ON a.instrument = b.instrument AND a.i = b.i - 8 JOIN r AS m ON m.instrument = b.instrument AND m.i > a.i AND m.i <= b.i GROUP BY b.instrument, b.t)
  SELECT instrument, t, round(disp, 6) AS disp, round(plen, 6) AS plen, round(abs(disp) / greatest(plen, 1e-12), 6) AS er, round(sqrt(sq / 8), 6) AS rv FROM p"""))
def path_statistics(spark, sf_dir):
    """Displacement, length, efficiency and realised volatility of the path over the last 8 moves."""
    rows = _bars(spark, sf_dir).withColumn("lc", ln("close")).withColumn("r", F.col("lc") - F.lag("lc").over(_of()))
    moves = _rows(8)
    rows = rows.select("instrument", "t", (F.col("lc") - F.lag("lc", 8).over(_of())).alias("disp"), F.sum(F.abs("r")).over(moves).alias("plen"), F.sum(F.col("r") * F.col("r")).over(moves).alias("sq")).where("disp IS NOT NULL")
    return rows.select("instrument", "t", F.round("disp", 6).alias("disp"), F.round("plen", 6).alias("plen"), F.round(F.abs("disp") / F.greatest("plen", F.lit(1e-12)), 6).alias("er"), F.round(F.sqrt(F.col("sq") / 8), 6).alias("rv"))


@query("f14_guarded_carry", duck(f"""WITH {BARS}, z AS (SELECT instrument, t, row_number() OVER (PARTITION BY instrument ORDER BY t) AS i, CASE WHEN ticks % 4 <> 0 THEN volume END AS v FROM bars),
  s AS (SELECT a.*, (SELECT max(b.i) FROM z AS b WHERE b.instrument = a.instrument AND b.i <= a.i AND b.i >= a.i - 3 AND b.v IS NOT NULL) AS src FROM z AS a)
  SELECT s.instrument, s.t, round(z.v, 6) AS v, s.i - s.src AS age FROM s LEFT JOIN z ON z.instrument = s.instrument AND z.i = s.src"""))
def guarded_carry(spark, sf_dir):
    """Zeros are missing; a missing value is the last one, of three bars before at most."""
    known = F.when(F.col("ticks") % 4 != 0, F.struct("i", F.col("volume").alias("v")))
    rows = _bars(spark, sf_dir).withColumn("i", F.row_number().over(_of())).withColumn("x", F.last(known, ignorenulls=True).over(_of().rowsBetween(-3, 0)))
    return rows.select("instrument", "t", F.round("x.v", 6).alias("v"), (F.col("i") - F.col("x.i")).cast("long").alias("age"))


@query("f15_gap_free", duck(f"""WITH {BARS}, x AS (SELECT instrument, t, row_number() OVER (PARTITION BY instrument ORDER BY t) AS i, t - lag(t) OVER (PARTITION BY instrument ORDER BY t) AS step FROM bars),
  n AS (SELECT instrument, max(i) AS n FROM x GROUP BY instrument)
  SELECT a.instrument, a.t, CAST(a.i > 4 AND NOT EXISTS (SELECT 1 FROM x AS b WHERE b.instrument = a.instrument AND b.i > a.i - 4 AND b.i <= a.i AND b.step > 3600) AS INTEGER) AS clean_before,
    CAST(a.i + 2 <= n.n AND NOT EXISTS (SELECT 1 FROM x AS b WHERE b.instrument = a.instrument AND b.i > a.i AND b.i <= a.i + 2 AND b.step > 3600) AS INTEGER) AS clean_after FROM x AS a JOIN n USING (instrument)"""))
def gap_free(spark, sf_dir):
    """No gap in the last four steps; none in the next two."""
    before, after = F.lag("t", 4).over(_of()), F.lead("t", 2).over(_of())
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return _bars(spark, sf_dir).select("instrument", "t", flag(F.col("t") - before == 4 * 3600).alias("clean_before"), flag(after - F.col("t") == 2 * 3600).alias("clean_after"))


@query("f21_time_z", duck(f"""WITH {BARS} SELECT a.instrument, a.t, CASE WHEN count(b.t) >= 20 THEN round((a.close - avg(b.close)) / greatest(stddev_samp(b.close), 1e-9), 6) END AS z
  FROM bars AS a LEFT JOIN bars AS b ON b.instrument = a.instrument AND b.t >= a.t - 259200 AND b.t < a.t GROUP BY a.instrument, a.t, a.close"""))
def time_z(spark, sf_dir):
    """Deviation from the mean of the last three days, the row itself left out."""
    past = _of().rangeBetween(-259200, -1)
    z = (F.col("close") - F.avg("close").over(past)) / F.greatest(F.stddev_samp("close").over(past), F.lit(1e-9))
    return _bars(spark, sf_dir).select("instrument", "t", F.round(F.when(F.count("close").over(past) >= 20, z), 6).alias("z"))


@query("f23_fold_quantile", duck(f"WITH {BARS}, f AS (SELECT instrument, t, volume, t // 604800 AS fold FROM bars) SELECT f.instrument, f.t, CAST(f.volume >= q.x AS INTEGER) AS top FROM f JOIN (SELECT instrument, fold, quantile_cont(volume, 0.8) AS x FROM f GROUP BY ALL) AS q USING (instrument, fold)"))
def fold_quantile(spark, sf_dir):
    """Rows at or above their fold's 80th percentile."""
    rows = _bars(spark, sf_dir).withColumn("fold", F.floor(F.col("t") / 604800))
    cut = rows.groupBy("instrument", "fold").agg(F.percentile("volume", F.lit(0.8)).alias("x"))
    return rows.join(cut, ["instrument", "fold"]).select("instrument", "t", (F.col("volume") >= F.col("x")).cast("int").alias("top"))


@query("g01_keep_first_last", duck("WITH e AS (SELECT user_id, event_type, event_id, ts FROM {events}) SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS first, arg_max(event_id, (ts, event_id)) AS last FROM e GROUP BY ALL"))
def keep_first_last(spark, sf_dir):
    """Of rows with one key the first and the last by time, ties by id."""
    order = F.struct("ts", "event_id")
    return run(spark, sf_dir, "SELECT user_id, event_type, event_id, ts FROM {events}").groupBy("user_id", "event_type").agg(F.min_by("event_id", order).alias("first"), F.max_by("event_id", order).alias("last"))


@query("g03_top_share", duck(f"WITH {BARS}, q AS (SELECT instrument, quantile_cont(volume, 0.9) AS x FROM bars GROUP BY instrument) SELECT instrument, t, round(volume, 6) AS volume FROM bars JOIN q USING (instrument) WHERE volume >= x"))
def top_share(spark, sf_dir):
    rows = _bars(spark, sf_dir)
    return rows.join(rows.groupBy("instrument").agg(F.percentile("volume", F.lit(0.9)).alias("x")), "instrument").where("volume >= x").select("instrument", "t", F.round("volume", 6).alias("volume"))


dual("g04_first_hit", f"WITH {BARS}, x AS (SELECT instrument, t, close, max(close) OVER (PARTITION BY instrument) AS top, min(close) OVER (PARTITION BY instrument) AS bottom FROM bars) SELECT instrument, min(CASE WHEN close = top THEN t END) AS argmax, min(CASE WHEN close = bottom THEN t END) AS argmin FROM x GROUP BY instrument")


def _pivots(spark, sf_dir):
    bars = _bars(spark, sf_dir)
    return bars, confirmed_pivots(bars, "instrument", "t", "high", "low", 0.3)


#: Pivots as the check of J01 states them.
_PIVOTS = SQL["j01_confirmed_pivots"]


@query("j02_developing_extreme", f"""WITH piv AS (SELECT * FROM ({_PIVOTS})), {duck(BARS)},
  l AS (SELECT b.instrument, b.t, (SELECT max(confirmed) FROM piv AS p WHERE p.instrument = b.instrument AND p.confirmed <= b.t) AS c FROM bars AS b),
  k AS (SELECT l.*, p.kind FROM l JOIN piv AS p ON p.instrument = l.instrument AND p.confirmed = l.c)
  SELECT k.instrument, k.t, CASE WHEN k.kind < 0 THEN max(b.high) ELSE min(b.low) END AS extreme,
    CASE WHEN k.kind < 0 THEN arg_max(b.t, (b.high, b.t)) ELSE arg_min(b.t, (b.low, -b.t)) END AS at
  FROM k JOIN bars AS b ON b.instrument = k.instrument AND b.t >= k.c AND b.t <= k.t GROUP BY k.instrument, k.t, k.kind""")
def developing_extreme(spark, sf_dir):
    """The extreme reached since the last confirmed pivot, the later bar of equal ones: a running maximum in each segment."""
    bars, pivots = _pivots(spark, sf_dir)
    marks = pivots.select("instrument", F.col("confirmed").alias("t"), "kind")
    rows = bars.select("instrument", "t", "high", "low").join(marks, ["instrument", "t"], "left").withColumn("c", F.last(F.when(F.col("kind").isNotNull(), F.struct("t", "kind")), ignorenulls=True).over(_of()))
    rows = rows.where("c IS NOT NULL").select("instrument", "t", F.col("c.t").alias("segment"), (-F.col("c.kind")).alias("sign"), "high", "low")
    value = F.when(F.col("sign") > 0, F.col("high")).otherwise(-F.col("low"))
    best = F.max(F.struct(value.alias("v"), "t")).over(W.partitionBy("instrument", "segment").orderBy("t"))
    return rows.withColumn("b", best).select("instrument", "t", (F.col("b.v") * F.col("sign")).alias("extreme"), F.col("b.t").alias("at"))


@query("f09_leg_maximum", f"""WITH piv AS (SELECT * FROM ({_PIVOTS})), {duck(BARS)}, r AS (SELECT instrument, t, abs(ln(close) - lag(ln(close)) OVER (PARTITION BY instrument ORDER BY t)) AS r FROM bars),
  l AS (SELECT instrument, "pivot" AS a, lead("pivot") OVER (PARTITION BY instrument ORDER BY "pivot") AS b FROM piv)
  SELECT l.instrument, a, b, round(max(r), 6) AS most, count(*) AS bars FROM l JOIN r ON r.instrument = l.instrument AND r.t >= a AND r.t < b GROUP BY l.instrument, a, b""")
def leg_maximum(spark, sf_dir):
    """The largest move of each leg, from its pivot up to the bar before the next."""
    bars, pivots = _pivots(spark, sf_dir)
    starts = pivots.select("instrument", F.col("pivot").alias("t"), F.lit(1).alias("starts"))
    rows = bars.withColumn("r", F.abs(ln("close") - F.lag(ln("close")).over(_of()))).join(starts, ["instrument", "t"], "left")
    rows = rows.withColumn("a", F.last(F.when(F.col("starts") == 1, F.col("t")), ignorenulls=True).over(_of())).where("a IS NOT NULL")
    legs = pivots.select("instrument", F.col("pivot").alias("a"), F.lead("pivot").over(W.partitionBy("instrument").orderBy("pivot")).alias("b")).where("b IS NOT NULL")
    return rows.groupBy("instrument", "a").agg(F.round(F.max("r"), 6).alias("most"), F.count(F.lit(1)).alias("bars")).join(legs, ["instrument", "a"]).select("instrument", "a", "b", "most", "bars")


dual("j11_direction_labels", f"WITH {BARS}, r AS (SELECT instrument, t, lead(close, 8) OVER (PARTITION BY instrument ORDER BY t) / lead(open, 1) OVER (PARTITION BY instrument ORDER BY t) - 1 AS r, high / open - 1 AS up, 1 - low / open AS dn FROM bars) SELECT instrument, t, CASE WHEN r > 0.5 THEN 1 WHEN r < -0.5 THEN -1 ELSE 0 END AS three, CASE WHEN r > 0 THEN 1 ELSE 0 END AS up8, CASE WHEN up > dn THEN 1 WHEN up < dn THEN -1 ELSE 0 END AS tb_sign FROM r WHERE r IS NOT NULL")
