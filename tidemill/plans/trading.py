"""Labels, gates, folds and simulated trades on hourly bars."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from tidemill.functions.text import trade_message
from tidemill.operators.simulate import Rules, simulate
from tidemill.plans.dual import BARS, SERIES, duck, run
from tidemill.registry import query

_NUMBERED = f"{BARS}, x AS (SELECT instrument, t, open, high, low, close, row_number() OVER (PARTITION BY instrument ORDER BY t) AS i FROM bars)"
#: A signal an hour on each instrument: long after a rise, short after a fall; b between 0.2 and 0.7.
_SIGNALS = "SELECT instrument, i * 10 + CASE WHEN close > open THEN 1 ELSE 0 END AS id, i + 1 AS start, CASE WHEN close > open THEN 1 ELSE -1 END AS side, 0.2 + t / 3600 % 6 / 10.0 AS b FROM x"


def _simulation_sql(rules: Rules, signals: str = _SIGNALS, digits: int = 6) -> str:
    """The same by nested conditions on every pair of a trade and a bar."""
    fill = f"""SELECT g.instrument, g.id, g.side, g.b, g.start AS ent, g.o AS e, false AS maker, false AS part FROM g""" if rules.pullback is None else f"""
      SELECT instrument, id, side, b, CASE WHEN k IS NULL THEN start + {rules.wait} ELSE k END AS ent, CASE WHEN k IS NULL THEN later WHEN opened THEN ko ELSE lim END AS e, k IS NOT NULL AS maker, coalesce(NOT opened, false) AS part FROM (
        SELECT g.*, n.open AS later, f.i AS k, f.open AS ko, CASE WHEN g.side > 0 THEN f.open <= g.lim ELSE f.open >= g.lim END AS opened
        FROM (SELECT *, o * exp(-side * {rules.pullback} * b) AS lim FROM g) AS g LEFT JOIN x AS n ON n.instrument = g.instrument AND n.i = g.start + {rules.wait}
        LEFT JOIN LATERAL (SELECT i, open FROM x WHERE x.instrument = g.instrument AND x.i >= g.start AND x.i < g.start + {rules.wait}
          AND (CASE WHEN g.side > 0 THEN x.open <= g.lim OR x.low <= g.lim * (1 - {rules.through}) ELSE x.open >= g.lim OR x.high >= g.lim * (1 + {rules.through}) END) ORDER BY i LIMIT 1) AS f ON true)"""
    return duck(f"""WITH {_NUMBERED}, g AS (SELECT s.*, x.open AS o FROM ({signals}) AS s JOIN x ON x.instrument = s.instrument AND x.i = s.start),
      f AS ({fill}), l AS (SELECT *, e * exp(side * {rules.tp} * b) AS tp, e * exp(-side * {rules.sl} * b) AS sl FROM f WHERE e IS NOT NULL),
      p AS (SELECT l.*, x.i, x.open, x.close, CASE WHEN side > 0 THEN x.low <= sl ELSE x.high >= sl END AS hs, CASE WHEN side > 0 THEN x.high >= tp ELSE x.low <= tp END AND NOT (part AND x.i = ent) AS ht
            FROM l JOIN x ON x.instrument = l.instrument AND x.i BETWEEN l.ent AND l.ent + {rules.hold - 1}),
      q AS (SELECT *, row_number() OVER (PARTITION BY instrument, id ORDER BY CASE WHEN hs OR ht THEN 0 ELSE 1 END, CASE WHEN hs OR ht THEN i ELSE -i END) AS k, count(*) OVER (PARTITION BY instrument, id) AS n FROM p),
      z AS (SELECT *, CASE WHEN hs THEN 'SL' WHEN ht THEN 'TP' WHEN n < {rules.hold} THEN 'CUT' ELSE 'TIMEOUT' END AS kind,
              CASE WHEN hs THEN CASE WHEN side > 0 AND open < sl OR side < 0 AND open > sl THEN open ELSE sl END WHEN ht THEN tp ELSE close END AS px FROM q WHERE k = 1)
      SELECT instrument, id, ent AS entry_at, round(e, {digits}) AS entry, maker, i AS exit_at, round(px, {digits}) AS exit, kind, round(side * ln(px / e) / ({rules.sl} * b), {digits}) AS r,
        round(side * ln(px / e) / ({rules.sl} * b) - (CASE WHEN maker THEN {rules.maker} ELSE {rules.taker} END + {rules.taker}) / ({rules.sl} * b), {digits}) AS r_net FROM z""")


def _simulation(name: str, rules: Rules) -> None:
    def build(spark, sf_dir):
        bars = run(spark, sf_dir, f"WITH {_NUMBERED} SELECT instrument, i, open, high, low, close FROM x")
        trades = run(spark, sf_dir, f"WITH {_NUMBERED} {_SIGNALS}")
        found = simulate(bars, trades, "instrument", rules)
        return found.select("instrument", "id", "entry_at", *[F.round(c, 6).alias(c) for c in ("entry", "exit", "r", "r_net")], "maker", "exit_at", "kind")

    query(name, _simulation_sql(rules))(build)


def _cents(c: str, signed: bool = False) -> str:
    whole = f"CAST(floor(abs({c}) * 100 + 0.5) AS BIGINT)"
    return f"""(CASE WHEN {c} < 0 AND {whole} > 0 THEN '-' ELSE '{"+" if signed else ""}' END || {whole} // 100 || '.' || lpad(CAST({whole} % 100 AS VARCHAR), 2, '0'))"""


_SAID = Rules(hold=9, maker=0.0002, taker=0.0005)


@query("o33_trade_messages", f"""SELECT instrument, id, CASE kind WHEN 'CUT' THEN 'OPEN' ELSE kind END || CASE WHEN id % 10 = 1 THEN ' LONG #' ELSE ' SHORT #' END || id || ' ' || {_cents("entry")} || ' -> ' || {_cents("exit")} || ' ' || {_cents("r", True)} || ' R'
  || CASE WHEN kind = 'CUT' THEN '' ELSE ' (net ' || {_cents("r_net", True)} || ' R)' END AS text FROM ({_simulation_sql(_SAID, digits=9)})""")
def trade_messages(spark, sf_dir):
    """The message of each trade, closed or marked to the last close."""
    bars = run(spark, sf_dir, f"WITH {_NUMBERED} SELECT instrument, i, open, high, low, close FROM x")
    found = simulate(bars, run(spark, sf_dir, f"WITH {_NUMBERED} {_SIGNALS}"), "instrument", _SAID)
    entry, price, gain, net = (F.round(c, 9) for c in ("entry", "exit", "r", "r_net"))
    said = trade_message(F.col("kind"), F.when(F.col("id") % 10 == 1, 1).otherwise(-1), F.col("id"), entry, price, gain, net)
    return found.select("instrument", "id", said.alias("text"))


_simulation("j04_simulate_exits", Rules(hold=9, maker=0.0002, taker=0.0005))
_simulation("j05_limit_pullback", Rules(tp=1.2, hold=9, pullback=0.3, wait=3, through=0.0001, maker=0.0002, taker=0.0005))


@query("d10_j03_barrier_labels", duck(f"""WITH {SERIES}, s AS (SELECT *, row_number() OVER (ORDER BY t) AS i FROM series),
  w AS (SELECT a.i, a.t, b.i - a.i AS k, c.open AS base, b.high, b.low, b.close, a.i + 8 = b.i AS final FROM s AS a JOIN s AS c ON c.i = a.i + 1 JOIN s AS b ON b.i BETWEEN a.i + 1 AND a.i + 8),
  h AS (SELECT i, t, count(*) AS n, min(CASE WHEN high >= base * 1.5 THEN k END) AS up, min(CASE WHEN low <= base * 0.5 THEN k END) AS dn, max(CASE WHEN final THEN (close / base - 1) / 0.5 END) AS r_end FROM w GROUP BY i, t)
  SELECT t, CASE WHEN up IS NULL AND dn IS NULL THEN 0 ELSE 1 END AS touched, CASE WHEN up IS NULL AND dn IS NULL OR up = dn THEN 0 WHEN dn IS NULL OR up < dn THEN 1 ELSE -1 END AS first, coalesce(least(up, dn), 9) AS t_first, round(r_end, 6) AS r_end FROM h WHERE n = 8"""))
def barrier_labels(spark, sf_dir):
    """First touch of either barrier within 8 bars of the next open, by the 8 bars ahead of each."""
    series, w = run(spark, sf_dir, f"WITH {SERIES} SELECT * FROM series"), W.orderBy("t")  # a row an hour
    ahead = lambda c: F.array(*[F.lead(c, k).over(w) for k in range(1, 9)])
    rows = series.select("t", F.lead("open").over(w).alias("base"), ahead("high").alias("h"), ahead("low").alias("l"), F.lead("close", 8).over(w).alias("end")).where("end IS NOT NULL")
    place = lambda c, test: F.nullif(F.array_position(F.transform(c, test), True), F.lit(0).cast("long"))
    up, dn = place("h", lambda x: x >= F.col("base") * 1.5), place("l", lambda x: x <= F.col("base") * 0.5)
    rows = rows.withColumn("up", up).withColumn("dn", dn)
    first = F.when(F.col("up").eqNullSafe(F.col("dn")), 0).when(F.col("dn").isNull() | (F.col("up") < F.col("dn")), 1).otherwise(-1)
    touched = F.col("up").isNotNull() | F.col("dn").isNotNull()
    return rows.select("t", touched.cast("int").alias("touched"), first.alias("first"), F.coalesce(F.least("up", "dn"), F.lit(9)).alias("t_first"), F.round((F.col("end") / F.col("base") - 1) / 0.5, 6).alias("r_end"))


@query("d16_parameter_grid", duck("WITH g AS (SELECT DISTINCT user_id % 4 AS a FROM {events}), e AS (SELECT event_type, value FROM {events}) SELECT a, event_type, count(*) FILTER (WHERE value > a * 50) AS n FROM e CROSS JOIN g GROUP BY a, event_type"))
def parameter_grid(spark, sf_dir):
    """Parameters are columns of one pass over the rows, turned into rows of the few results."""
    events = run(spark, sf_dir, "SELECT event_type, value FROM {events}")
    grid = sorted(r[0] for r in run(spark, sf_dir, "SELECT DISTINCT user_id % 4 AS a FROM {events}").collect())  # four at most
    counts = events.groupBy("event_type").agg(*[F.count_if(F.col("value") > a * 50).alias(f"n{a}") for a in grid])
    cells = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.col(f"n{a}").alias("n")) for a in grid])
    return counts.select("event_type", F.explode(cells).alias("x")).select("x.a", "event_type", "x.n") if grid else counts.select(F.lit(0).cast("long").alias("a"), "event_type", F.lit(0).cast("long").alias("n"))


@query("j10_folds", duck("""WITH q AS (SELECT DISTINCT date_trunc('quarter', o_orderdate) AS q FROM {orders}), o AS (SELECT o_orderkey, o_orderdate AS d, o_orderdate + INTERVAL 10 DAY AS e FROM {orders}),
  p AS (SELECT q, d, e, CASE WHEN e < q - INTERVAL 6 MONTH THEN 'train' WHEN d >= q - INTERVAL 6 MONTH AND e < q THEN 'val' WHEN d >= q AND d < q + INTERVAL 3 MONTH THEN 'test' END AS part FROM o CROSS JOIN q),
  m AS (SELECT q, min(d) + (max(d) - min(d)) / 2 AS half FROM p WHERE part = 'val' GROUP BY q),
  v AS (SELECT p.q, CASE WHEN part <> 'val' THEN part WHEN d > half THEN 'cal' WHEN e < (SELECT min(x.d) FROM p AS x WHERE x.q = p.q AND x.part = 'val' AND x.d > half) THEN 'es' ELSE 'purged' END AS part FROM p LEFT JOIN m ON m.q = p.q WHERE part IS NOT NULL)
  SELECT @epoch(q) AS fold, part, count(*) AS n FROM v GROUP BY q, @epoch(q), part"""))
def folds_of(spark, sf_dir):
    """Walk-forward folds of a quarter: train ends before, validation in the two quarters before, split in an early-stopping
    half (es), purged of samples whose label reaches into the other (cal), and the quarter itself. Samples are days here: an
    order's label ends ten days on. Counts per day come first, so folds meet some thousand days, whatever the orders."""
    days = run(spark, sf_dir, "SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS c FROM {orders} GROUP BY CAST(o_orderdate AS DATE)")
    quarters = days.select(F.trunc("d", "quarter").alias("q")).distinct()
    pairs = days.withColumn("e", F.date_add("d", 10)).crossJoin(F.broadcast(quarters)).withColumn("from", F.add_months("q", -6))
    part = F.when(F.col("e") < F.col("from"), "train").when((F.col("d") >= F.col("from")) & (F.col("e") < F.col("q")), "val").when((F.col("d") >= F.col("q")) & (F.col("d") < F.add_months("q", 3)), "test")
    pairs = pairs.withColumn("part", part).where("part IS NOT NULL")
    val = pairs.where("part = 'val'").groupBy("q").agg(F.min("d").alias("a"), F.max("d").alias("b")).select("q", (F.unix_date("a") * 2 + F.datediff("b", "a")).alias("half2"))
    later = F.unix_date("d") * 2 > F.col("half2")
    marked = pairs.join(val, "q", "left")
    cal = marked.where((F.col("part") == "val") & later).groupBy("q").agg(F.min("d").alias("cal"))
    marked = marked.join(cal, "q", "left")
    name = F.when(F.col("part") != "val", F.col("part")).when(later, "cal").when(F.col("e") < F.col("cal"), "es").otherwise("purged")
    return marked.groupBy(F.unix_timestamp(F.col("q").cast("timestamp")).alias("fold"), name.alias("part")).agg(F.sum("c").alias("n"))
