"""Grids of trading rules in one pass over the bars (D16, E27), and what label and gate order do to signals."""

from __future__ import annotations

import itertools

from pyspark.sql import Window as W, functions as F

from tidemill.operators.grid import cell_table, simulate_grid
from tidemill.operators.simulate import Rules
from tidemill.plans.dual import duck, run
from tidemill.plans.gates import FIVE, _gates_sql, gate_orders
from tidemill.plans.trading import _NUMBERED, _SIGNALS
from tidemill.registry import query

WAIT, THROUGH, MAKER, TAKER = 3, 0.0001, 0.0002, 0.0005
#: The cells: target and stop as shares of b, bars held, and the pull-back of the entry (none: the next open).
CELLS = [Rules(tp=tp, sl=sl, hold=hold, pullback=p, wait=WAIT, through=THROUGH, maker=MAKER, taker=TAKER) for tp, sl, hold, p in itertools.product((0.6, 1.0, 1.4, 1.8), (0.7, 1.0, 1.3), (4, 9), (None, 0.2, 0.4, 0.6))]
_VALUES = ", ".join(f"({k}, {c.tp}, {c.sl}, {c.hold}, {'NULL' if c.pullback is None else c.pullback})" for k, c in enumerate(CELLS))

#: Every trade of every cell, by conditions on pairs of a trade and a bar.
_GRID_SQL = duck(f"""WITH {_NUMBERED}, cells(cell, tp, sl, hold, back) AS (VALUES {_VALUES}),
  g AS (SELECT s.*, x.open AS o, p.back, x.open * exp(-s.side * p.back * s.b) AS lim FROM ({_SIGNALS}) AS s JOIN x ON x.instrument = s.instrument AND x.i = s.start, (SELECT DISTINCT back FROM cells) AS p),
  h AS (SELECT g.instrument, g.id, g.back, min(x.i) AS k FROM g JOIN x ON x.instrument = g.instrument AND x.i >= g.start AND x.i < g.start + {WAIT}
        WHERE CASE WHEN side > 0 THEN x.open <= lim OR x.low <= lim * (1 - {THROUGH}) ELSE x.open >= lim OR x.high >= lim * (1 + {THROUGH}) END GROUP BY ALL),
  f AS (SELECT g.instrument, g.id, g.side, g.b, g.back, x.i AS ent, k IS NOT NULL AS maker, k IS NOT NULL AND x.open * side > lim * side AS part, CASE WHEN k IS NOT NULL AND x.open * side > lim * side THEN lim ELSE x.open END AS e
        FROM g LEFT JOIN h ON h.instrument = g.instrument AND h.id = g.id AND h.back = g.back JOIN x ON x.instrument = g.instrument AND x.i = CASE WHEN g.back IS NULL THEN g.start ELSE coalesce(k, g.start + {WAIT}) END),
  l AS (SELECT f.*, c.cell, c.hold, c.sl AS share, e * exp(side * c.tp * b) AS tp, e * exp(-side * c.sl * b) AS sl FROM f JOIN cells AS c ON c.back IS NOT DISTINCT FROM f.back),
  p AS (SELECT l.*, x.i, x.open, x.close, CASE WHEN side > 0 THEN x.low <= sl ELSE x.high >= sl END AS hs, CASE WHEN side > 0 THEN x.high >= tp ELSE x.low <= tp END AND NOT (part AND x.i = ent) AS ht FROM l JOIN x ON x.instrument = l.instrument AND x.i >= ent AND x.i < ent + l.hold),
  q AS (SELECT cell, instrument, id, side, b, share, maker, e, tp, sl, hold, min(i) FILTER (WHERE hs) AS s, min(i) FILTER (WHERE ht) AS t, arg_min(open, i) FILTER (WHERE hs) AS so, count(*) AS n, arg_max(close, i) AS last FROM p GROUP BY ALL),
  z AS (SELECT *, CASE WHEN s IS NOT NULL AND (t IS NULL OR s <= t) THEN CASE WHEN side > 0 THEN least(so, sl) ELSE greatest(so, sl) END WHEN t IS NOT NULL THEN tp ELSE last END AS px,
        CASE WHEN s IS NOT NULL AND (t IS NULL OR s <= t) THEN 'SL' WHEN t IS NOT NULL THEN 'TP' WHEN n < hold THEN 'CUT' ELSE 'TIMEOUT' END AS kind FROM q),
  trades AS (SELECT *, side * ln(px / e) / (share * b) - (CASE WHEN maker THEN {MAKER} ELSE {TAKER} END + {TAKER}) / (share * b) AS r FROM z)""")


def grid_trades(spark, sf_dir):
    """The trades of all cells, simulated in one pass."""
    bars = run(spark, sf_dir, f"WITH {_NUMBERED} SELECT instrument, i, open, high, low, close FROM x")
    return simulate_grid(bars, run(spark, sf_dir, f"WITH {_NUMBERED} {_SIGNALS}"), "instrument", CELLS)


@query("e27_grid_metrics", f"""{_GRID_SQL} SELECT c.tp, c.sl, c.hold, coalesce(c.back, 0) AS pullback, count(*) AS n, round(avg(r), 6) AS mean, round(sum(r), 4) AS total, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS win,
  count(*) FILTER (WHERE kind = 'SL') AS stopped, count(*) FILTER (WHERE kind = 'TIMEOUT') AS timeouts, round(avg(CASE WHEN maker THEN 1.0 ELSE 0.0 END), 6) AS makers, round(min(r), 6) AS worst FROM trades JOIN cells AS c USING (cell) GROUP BY ALL""")
def grid_metrics(spark, sf_dir):
    """96 cells of target, stop, holding time and way of entry: every trade simulated under each."""
    trades = grid_trades(spark, sf_dir)
    cells = spark.createDataFrame([(k, c["tp"], c["sl"], c["hold"], c["pullback"] or 0.0) for k, c in cell_table(CELLS)], "cell int, tp double, sl double, hold int, pullback double")
    r = F.col("r_net")
    found = trades.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(r), 6).alias("mean"), F.round(F.sum(r), 4).alias("total"), F.round(F.avg(F.when(r > 0, 1.0).otherwise(0.0)), 6).alias("win"), F.count_if(F.col("kind") == "SL").alias("stopped"),
        F.count_if(F.col("kind") == "TIMEOUT").alias("timeouts"), F.round(F.avg(F.when(F.col("maker"), 1.0).otherwise(0.0)), 6).alias("makers"), F.round(F.min(r), 6).alias("worst"),
    )
    return cells.join(found, "cell").drop("cell")


#: Rows ahead that a label looks at, and the distance of its barriers.
AHEAD, BARRIER = 12, 60
_LABELS = f"""w AS (SELECT a.instrument, a.t, a.p, a.d, min(b.t) FILTER (WHERE b.p >= a.d + 100 + {BARRIER}) AS up, min(b.t) FILTER (WHERE b.d <= a.d - {BARRIER}) AS dn, arg_max(b.d, b.t) - a.d AS move, count(*) AS n
    FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY t) AS i FROM five) AS a JOIN (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY t) AS i FROM five) AS b ON b.instrument = a.instrument AND b.i > a.i AND b.i <= a.i + {AHEAD} GROUP BY a.instrument, a.t, a.p, a.d),
  labelled AS (SELECT instrument, t, p, d, 'end' AS label, sign(move) AS y FROM w WHERE n = {AHEAD} UNION ALL
    SELECT instrument, t, p, d, 'touch', CASE WHEN up IS NULL AND dn IS NULL OR up = dn THEN 0 WHEN dn IS NULL OR up < dn THEN 1 ELSE -1 END FROM w WHERE n = {AHEAD})"""


@query("o16_label_gate_sweep", f"""{duck(f"WITH {FIVE}")}, {_LABELS}, gates AS ({_gates_sql()})
  SELECT label, gate_order, touch_top, dir_top, count(*) AS signals, count(*) FILTER (WHERE d >= long_gate) AS longs, round(avg(CASE WHEN (CASE WHEN d >= long_gate THEN 1 ELSE -1 END) * y > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit, round(avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END), 6) AS none
  FROM labelled AS l JOIN gates AS g ON g.instrument = l.instrument AND g.t = l.t WHERE p >= thr AND (d >= long_gate OR -d >= short_gate) GROUP BY ALL""")
def label_gate_sweep(spark, sf_dir):
    """Signals that pass both gates, for both orders and all shares, measured on two labels: the sign of the move over the next
    twelve rows, and which barrier they touch first. Labels and gates are made once and meet once."""
    ahead = W.partitionBy("instrument").orderBy("t").rowsBetween(1, AHEAD)
    rows = run(spark, sf_dir, f"WITH {FIVE} SELECT * FROM five")
    rows = rows.select("*", F.collect_list(F.struct("t", "p", "d")).over(ahead).alias("_next")).where(F.size("_next") == AHEAD)
    first = lambda test: F.array_min(F.transform(F.filter("_next", test), lambda x: x["t"]))
    rows = rows.withColumn("up", first(lambda x: x["p"] >= F.col("d") + 100 + BARRIER)).withColumn("dn", first(lambda x: x["d"] <= F.col("d") - BARRIER))
    touch = F.when(F.col("up").eqNullSafe(F.col("dn")), 0).when(F.col("dn").isNull() | (F.col("up") < F.col("dn")), 1).otherwise(-1)
    labels = F.array(F.struct(F.lit("end").alias("label"), F.signum(F.col("_next")[AHEAD - 1]["d"] - F.col("d")).cast("int").alias("y")), F.struct(F.lit("touch").alias("label"), touch.cast("int").alias("y")))
    met = rows.select("instrument", "t", "p", "d", F.explode(labels).alias("l")).join(gate_orders(spark, sf_dir), ["instrument", "t"])
    long = F.col("d") >= F.col("long_gate")
    passed = met.where((F.col("p") >= F.col("thr")) & (long | (-F.col("d") >= F.col("short_gate"))))
    share = lambda test: F.round(F.avg(F.when(test, 1.0).otherwise(0.0)), 6)
    hit = F.when(long, 1).otherwise(-1) * F.col("l.y") > 0
    return passed.groupBy(F.col("l.label").alias("label"), "gate_order", "touch_top", "dir_top").agg(F.count(F.lit(1)).alias("signals"), F.count_if(long).alias("longs"), share(hit).alias("hit"), share(F.col("l.y") == 0).alias("none"))
