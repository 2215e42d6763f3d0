"""Validation, bars, joins, windows, gates, labels and simulation as queries."""

from pyspark.sql import functions as F

from tidemill.functions import ieee
from tidemill.operators import books, folds, joins
from tidemill.operators.pivots import confirmed_pivots
from tidemill.plans.dual import BARS, SERIES, dual, duck, run
from tidemill.registry import SQL, query

INJECTED = "raw AS (SELECT event_id, event_type AS instrument, @epoch(ts) AS t, value AS open, value * 1.01 AS high, value * 0.99 AS low, value AS close, 1.0 AS volume FROM {events} UNION ALL SELECT -1, 'x', 0, 5.0, 4.0, 6.0, 5.0, 1.0 UNION ALL SELECT -2, 'x', 0, -5.0, 6.0, -6.0, 5.0, 1.0 UNION ALL SELECT -3, 'x', 0, 5.0, 6.0, 4.0, 5.0, -1.0)"
GOOD = "least(open, high, low, close) > 0 AND volume >= 0 AND low <= least(open, close) AND high >= greatest(open, close)"
dual("c03_candle_predicate", f"WITH {INJECTED} SELECT event_id, CASE WHEN {GOOD} THEN 1 ELSE 0 END AS valid FROM raw")
dual("b05_dead_letters", f"WITH {INJECTED} SELECT event_id, instrument FROM raw WHERE NOT ({GOOD})")
dual("d01_self_join", f"WITH {BARS} SELECT a.t, round(a.close, 6) AS click, round(b.close, 6) AS bought, round(c.close, 6) AS seen FROM bars AS a JOIN bars AS b ON a.t = b.t JOIN bars AS c ON a.t = c.t WHERE a.instrument = 'click' AND b.instrument = 'purchase' AND c.instrument = 'view'")
dual("d11_not_exists", "SELECT o_orderkey FROM {orders} AS o WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM {lineitem} AS l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 30)")
dual("d12_equi_join", "SELECT c_nationkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} AS o JOIN {customer} AS c ON o.o_custkey = c.c_custkey GROUP BY c_nationkey")
dual("e01_resample_complete", f"WITH {SERIES}, h AS (SELECT floor(t / 14400) * 14400 AS t4, min_by(open, t) AS open, max(high) AS high, min(low) AS low, max_by(close, t) AS close, sum(volume) AS volume, count(*) AS n FROM series GROUP BY floor(t / 14400) * 14400) SELECT CAST(t4 AS BIGINT) AS t, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 4) AS volume FROM h WHERE n = 4")
W24, W48 = (f"OVER (PARTITION BY instrument ORDER BY t ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in (24, 48))
dual("f01_lag_diff", f"WITH {BARS} SELECT instrument, t, round(close - lag(close, 3) OVER (PARTITION BY instrument ORDER BY t), 6) AS diff3 FROM bars")
dual("f02_rolling_guarded", f"WITH {BARS} SELECT instrument, t, CASE WHEN count(close) {W24} = 24 THEN round(avg(close) {W24}, 6) END AS mean24, CASE WHEN count(close) {W24} = 24 THEN max(high) {W24} END AS max24 FROM bars")
dual("f03_rolling_z", f"WITH {BARS} SELECT instrument, t, CASE WHEN count(close) {W48} >= 20 THEN round((close - avg(close) {W48}) / greatest(stddev_samp(close) {W48}, 1e-9), 6) END AS z FROM bars")
dual("f16_contiguous_windows", f"WITH {BARS} SELECT instrument, t, CASE WHEN t - lag(t, 5) OVER (PARTITION BY instrument ORDER BY t) = 5 * 3600 THEN 1 ELSE 0 END AS whole FROM bars")
dual("f24_sessions", "WITH e AS (SELECT event_id, user_id, @epoch(ts) AS t FROM {events}), n AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 86400 THEN 0 ELSE 1 END AS fresh FROM e) SELECT event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM n")
dual("f25_sliding_dedup", "WITH e AS (SELECT event_id, user_id, event_type, @epoch(ts) AS t FROM {events}) SELECT event_id, CASE WHEN t - lag(t) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) <= 21600 THEN 1 ELSE 0 END AS repeated FROM e")
dual("j17_blend", f"WITH {BARS} SELECT t, round(0.5 + sum((CASE WHEN instrument = 'click' THEN 0.7 ELSE 0.3 END) * (1 / (1 + exp(-close / 100)) - 0.5)), 8) AS p FROM bars WHERE instrument IN ('click', 'view') GROUP BY t")
GRID = "cells AS (SELECT o_custkey % 5 AS a, o_orderkey % 4 AS b, year(o_orderdate) AS y, avg(o_totalprice) AS m, count(*) AS n FROM {orders} GROUP BY o_custkey % 5, o_orderkey % 4, year(o_orderdate)), scored AS (SELECT a, b, 0.7 * avg(m) + 0.3 * min(m) AS score, min(n) AS least FROM cells GROUP BY a, b)"
dual("e28_cell_scores", f"WITH {GRID} SELECT a, b, round(score, 4) AS score, CASE WHEN least >= 1 THEN 1 ELSE 0 END AS valid FROM scored")
dual("e29_region_score", f"WITH {GRID} SELECT x.a, x.b, round(avg(z.score), 4) AS region FROM scored AS x JOIN scored AS z ON abs(x.a - z.a) + abs(x.b - z.b) <= 1 GROUP BY x.a, x.b")
dual("e30_plateau", f"WITH {GRID} SELECT x.a, x.b, round(avg(z.score), 4) AS plateau, round(avg(CASE WHEN z.score > 0 THEN 1.0 ELSE 0.0 END), 6) AS good FROM scored AS x JOIN scored AS z ON abs(x.a - z.a) <= 1 AND abs(x.b - z.b) <= 1 GROUP BY x.a, x.b")
dual("e31_argmax", f"WITH {GRID} SELECT a, b FROM scored ORDER BY score DESC, a, b LIMIT 1")
dual("f13_whole_row_carry", f"WITH {SERIES}, s AS (SELECT (t - min(t) OVER ()) / 3600 AS pos, CASE WHEN ticks > 5 THEN volume END AS v FROM series), c AS (SELECT pos, v, max(CASE WHEN v IS NOT NULL THEN pos END) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS src FROM s) SELECT CAST(c.pos AS BIGINT) AS pos, round(CASE WHEN c.pos - c.src <= 3 THEN s.v END, 6) AS carried, CAST(c.pos - c.src AS BIGINT) AS age FROM c LEFT JOIN s ON s.pos = c.src")
dual("a21_latest_price", "SELECT event_type, max_by(value, ts) AS mark FROM {events} GROUP BY event_type")
dual("a12_half_open_scan", "WITH e AS (SELECT event_id, value, @epoch(ts) AS t FROM {events}) SELECT event_id, value FROM e WHERE t >= 1704153600 AND t < 1704240000")


@query("i01_scalar_functions", duck("SELECT event_id, round(@ln(value), 8) AS l, round(sqrt(value), 8) AS r, round(sin(2 * pi() * hour(ts) / 24), 8) AS s, round(1 / (1 + exp(-greatest(least(value / 100, 30.0), -30.0))), 8) AS sigmoid FROM {events}"))
def i01(spark, sf_dir):
    rows = run(spark, sf_dir, "SELECT event_id, @ln(value) AS l, sqrt(value) AS r, sin(2 * pi() * hour(ts) / 24) AS s, 1 / (1 + exp(-greatest(least(value / 100, 30.0), -30.0))) AS sigmoid FROM {events}")
    return rows.select("event_id", *[ieee.rounded(F.col(c), 8).alias(c) for c in ("l", "r", "s", "sigmoid")])


_CLICKS = "WITH e AS (SELECT event_id, user_id, event_type, value, @epoch(ts) AS t FROM {events}) SELECT event_id, user_id, value, t FROM e WHERE event_type = '%s'"


def _asof_sql(direction: str) -> str:
    e = duck("(SELECT event_id, user_id, event_type, value, @epoch(ts) AS t FROM events)")
    return f"SELECT l.event_id, l.t, r.value AS asof_value FROM {e} AS l ASOF LEFT JOIN (SELECT * FROM {e} AS z WHERE event_type = 'view') AS r ON l.user_id = r.user_id AND l.t {direction} r.t WHERE l.event_type = 'click'"


@query("d02_asof_backward", _asof_sql(">="))
def d02(spark, sf_dir):
    left, right = (run(spark, sf_dir, _CLICKS % kind) for kind in ("click", "view"))
    return joins.asof_join(left, right, "t", ["user_id"], ["value"], width=86400).select("event_id", "t", "asof_value")


@query("d08_asof_forward", _asof_sql("<="))
def d08(spark, sf_dir):
    """The first value at or after each row, however late it comes."""
    left, right = (run(spark, sf_dir, _CLICKS % kind) for kind in ("click", "view"))
    return joins.asof_join(left, right, "t", ["user_id"], ["value"], "forward", width=86400).select("event_id", "t", "asof_value")


@query("d09_range_join", duck("WITH e AS (SELECT event_id, user_id, event_type, value, @epoch(ts) AS t FROM {events}) SELECT a.event_id, count(*) AS n, round(sum(b.value), 6) AS total FROM e AS a JOIN e AS b ON a.user_id = b.user_id AND b.t >= a.t AND b.t < a.t + 86400 WHERE a.event_type = 'click' AND b.event_type = 'view' GROUP BY a.event_id"))
def d09(spark, sf_dir):
    clicks, views = (run(spark, sf_dir, _CLICKS % kind) for kind in ("click", "view"))
    ranges = clicks.select("event_id", "user_id", F.col("t").alias("start"), (F.col("t") + 86400).alias("end"))
    found = joins.range_join(views.select("user_id", "t", "value"), ranges, "t", "start", "end", ["user_id"], 86400)
    return found.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


_BAR_ROWS = f"WITH {BARS} SELECT instrument, t, high, low, close FROM bars"


@query("f06_ewm_volatility", duck(f"""WITH RECURSIVE {BARS}, r AS (SELECT instrument, t, coalesce(ln(close) - lag(ln(close)) OVER (PARTITION BY instrument ORDER BY t), 0) AS r, row_number() OVER (PARTITION BY instrument ORDER BY t) AS i FROM bars),
  v AS (SELECT instrument, t, i, r * r AS v FROM r WHERE i = 1 UNION ALL SELECT r.instrument, r.t, r.i, v.v * (1 - 2.0 / 25) + 2.0 / 25 * r.r * r.r FROM v JOIN r ON r.instrument = v.instrument AND r.i = v.i + 1)
  SELECT instrument, t, CASE WHEN i >= 24 THEN round(greatest(sqrt(v), 1e-6), 8) END AS sigma FROM v"""))
def f06(spark, sf_dir):
    return folds.ewm_volatility(run(spark, sf_dir, _BAR_ROWS), "instrument", "t", "close", 24, 400 * 3600).withColumn("sigma", F.round("sigma", 8))


#: The state machine of A.5, a bar a step: s is the direction, hi and lo the running extremes, ht and lt their times.
_PIVOT_STEP = """
  SELECT b.instrument, b.i, b.t,
    CASE WHEN c.s = 0 THEN CASE WHEN up >= 0.3 AND up >= down AND nlt < b.t THEN 1 WHEN down >= 0.3 AND nht < b.t THEN -1 ELSE 0 END
         WHEN c.s = 1 THEN CASE WHEN b.high < c.hi AND b.low <= c.hi * (1 - 0.3) THEN -1 ELSE 1 END
         ELSE CASE WHEN b.low > c.lo AND b.high >= c.lo * (1 + 0.3) THEN 1 ELSE -1 END END AS ns, c.s AS os, c.hi AS ohi, c.ht AS oht, c.lo AS olo, c.lt AS olt, nhi, nht, nlo, nlt, b.high, b.low
  FROM c JOIN bars AS b ON b.instrument = c.instrument AND b.i = c.i + 1,
  LATERAL (SELECT CASE WHEN b.high > c.hi THEN b.high ELSE c.hi END AS nhi, CASE WHEN b.high > c.hi THEN b.t ELSE c.ht END AS nht, CASE WHEN b.low < c.lo THEN b.low ELSE c.lo END AS nlo, CASE WHEN b.low < c.lo THEN b.t ELSE c.lt END AS nlt) AS e,
  LATERAL (SELECT b.high / nlo - 1 AS up, 1 - b.low / nhi AS down) AS f"""


@query("j01_confirmed_pivots", duck(f"""WITH RECURSIVE {BARS.replace("bars AS", "raw AS", 1)}, bars AS (SELECT instrument, t, high, low, row_number() OVER (PARTITION BY instrument ORDER BY t) AS i FROM raw),
  c AS (SELECT instrument, i, t, 0 AS s, 0 AS os, high AS hi, t AS ht, low AS lo, t AS lt, high AS ohi, t AS oht, low AS olo, t AS olt FROM bars WHERE i = 1 UNION ALL
    SELECT instrument, i, t, ns, os,
      CASE WHEN ns = 0 THEN nhi WHEN ns = 1 AND os = 1 THEN greatest(high, ohi) WHEN ns = 1 THEN high ELSE ohi END, CASE WHEN ns = 0 THEN nht WHEN ns = 1 AND os = 1 THEN CASE WHEN high >= ohi THEN t ELSE oht END WHEN ns = 1 THEN t ELSE oht END,
      CASE WHEN ns = 0 THEN nlo WHEN ns = -1 AND os = -1 THEN least(low, olo) WHEN ns = -1 THEN low ELSE olo END, CASE WHEN ns = 0 THEN nlt WHEN ns = -1 AND os = -1 THEN CASE WHEN low <= olo THEN t ELSE olt END WHEN ns = -1 THEN t ELSE olt END,
      CASE WHEN os = 0 THEN nhi ELSE ohi END, CASE WHEN os = 0 THEN nht ELSE oht END, CASE WHEN os = 0 THEN nlo ELSE olo END, CASE WHEN os = 0 THEN nlt ELSE olt END FROM ({_PIVOT_STEP}) AS x)
  SELECT instrument, CASE WHEN s = 1 THEN olt ELSE oht END AS pivot, t AS confirmed, CASE WHEN s = 1 THEN olo ELSE ohi END AS price, CASE WHEN s = 1 THEN -1 ELSE 1 END AS kind FROM c WHERE s <> os"""))
def j01(spark, sf_dir):
    return confirmed_pivots(run(spark, sf_dir, _BAR_ROWS), "instrument", "t", "high", "low", 0.3)


_HELD = "WITH e AS (SELECT event_id AS id, event_type AS book, @epoch(ts) AS t, value FROM {events}) SELECT id, book, t AS signal, t + id % 4 * 900 AS entry, t + id % 4 * 900 + CAST(floor(value) AS BIGINT) * 600 AS leave, value / 250 - 0.9 AS r FROM e"


@query("j06_admission", duck(f"""WITH RECURSIVE h AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY signal, id) AS i FROM ({_HELD}) AS z),
  s AS (SELECT book, id, i, true AS admitted, [leave] AS held, signal AS last FROM h WHERE i = 1 UNION ALL
    SELECT book, id, i, good, CASE WHEN good THEN list_append(held, leave) ELSE held END, CASE WHEN good THEN signal ELSE last END FROM (
      SELECT book, id, i, leave, signal, last, held, len(held) < 3 AND signal - last >= 3600 AS good FROM (
        SELECT h.book, h.id, h.i, h.leave, h.signal, s.last, list_filter(s.held, lambda x: x >= h.signal) AS held FROM s JOIN h ON h.book = s.book AND h.i = s.i + 1) AS a) AS b)
  SELECT book, id, admitted FROM s"""))
def j06(spark, sf_dir):
    """A trade is pending from its signal to its entry, and counts all the while."""
    return books.admit(run(spark, sf_dir, _HELD), "book", "signal", "leave", 3, 3600, 604800)


@query("j07_equity", duck(f"""WITH RECURSIVE h AS (SELECT z.*, row_number() OVER (PARTITION BY z.book ORDER BY leave, entry, z.id) AS i FROM ({_HELD}) AS z JOIN ({SQL["j06_admission"]}) AS j ON j.book = z.book AND j.id = z.id AND admitted),
  a AS (SELECT h.book, h.id, h.i, h.r, count(o.id) AS n FROM h LEFT JOIN h AS o ON o.book = h.book AND o.i < h.i AND o.leave <= h.entry GROUP BY h.book, h.id, h.i, h.r),
  s AS (SELECT book, id, i, [1.0, 1.0 + 0.01 * r] AS v FROM a WHERE i = 1 UNION ALL
    SELECT a.book, a.id, a.i, list_append(s.v, s.v[len(s.v)] + 0.01 * a.r * s.v[a.n + 1]) FROM s JOIN a ON a.book = s.book AND a.i = s.i + 1)
  SELECT book, id, round(v[len(v)], 8) AS equity_after FROM s"""))
def j07(spark, sf_dir):
    """Account value after each admitted trade, at one part in a hundred of the value at its entry."""
    trades = run(spark, sf_dir, _HELD)
    admitted = books.admit(trades, "book", "signal", "leave", 3, 3600, 604800).where("admitted").select("book", "id")
    return books.equity(trades.join(admitted, ["book", "id"]), "book", "entry", "leave", "r", 0.01, 604800).select("book", "id", F.round("equity_after", 8).alias("equity_after"))
