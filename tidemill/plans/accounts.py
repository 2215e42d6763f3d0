"""Futures accounts (D19, E40, I27, J09, J18, O22) and a few scalar rows."""

from __future__ import annotations

import hashlib
import json
import uuid

import pandas as pd
from pyspark.sql import Window as W, functions as F

from tidemill.functions import futures
from tidemill.operators import books, folds
from tidemill.operators.joins import range_join
from tidemill.plans.dual import BARS, duck, dual, run
from tidemill.registry import query

#: Account: share of the value that is a trade's margin, leverage, fees, funding every eight hours.
MARGIN, LEVERAGE, MAKER, TAKER, CAPITAL, EVERY = 0.01, 50.0, 0.0002, 0.0005, 100_000.0, 28_800
#: Trades open at once, and seconds between their entries.
CAP, GAP = 4, 1800

_TRADES = "SELECT event_id AS id, event_type AS book, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS side, @epoch(ts) AS entry, @epoch(ts) + 300 + CAST(floor(value) AS BIGINT) * 600 AS leave, 100 + value AS e, (100 + value) * (1 + (event_id * 37 % 21 - 10) / 1000.0) AS x, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS maker FROM {events}"
_FUNDED = f"""tr AS ({_TRADES}), b AS (SELECT min(entry) AS a, max(leave) AS z FROM tr), g AS (SELECT unnest(generate_series(a - a % {EVERY}, z + {EVERY}, {EVERY})) AS t FROM b), r AS (SELECT t, (t // {EVERY} % 5 - 2) / 10000.0 AS rate FROM g),
  fu AS (SELECT tr.id, coalesce(sum(rate), 0) AS paid, count(rate) AS times FROM tr LEFT JOIN r ON r.t > tr.entry AND r.t < tr.leave + 300 GROUP BY tr.id)"""


def _funded(spark, sf_dir):
    """Trades with the sum of rates paid while they were open, settlement at entry left out and up to five minutes after the exit."""
    trades = run(spark, sf_dir, _TRADES)
    grid = trades.agg(F.min("entry").alias("a"), F.max("leave").alias("z")).select(F.explode(F.expr(f"sequence(a - a % {EVERY}, z + {EVERY}, {EVERY}L)")).alias("t"))
    rates = grid.withColumn("rate", (F.pmod(F.floor(F.col("t") / EVERY), F.lit(5)) - 2) / 10000.0).withColumn("all", F.lit(1))
    spans = trades.select("id", (F.col("entry") + 1).alias("from"), (F.col("leave") + 300).alias("to"), F.lit(1).alias("all"))
    paid = range_join(rates, spans, "t", "from", "to", ["all"], EVERY).groupBy("id").agg(F.sum("rate").alias("paid"), F.count(F.lit(1)).alias("times"))
    return trades.join(paid, "id", "left").na.fill(0, ["paid", "times"])


@query("d19_funding_paid", duck(f"WITH {_FUNDED} SELECT id, round(paid, 8) AS paid, times FROM fu"))
def funding_paid(spark, sf_dir):
    return _funded(spark, sf_dir).select("id", F.round("paid", 8).alias("paid"), "times")


@query("i27_liquidation", f"""WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS side, 250.0 AS e, o_totalprice * CASE o_orderkey % 4 WHEN 0 THEN 0.1 WHEN 1 THEN 3 WHEN 2 THEN 40 ELSE 400 END AS n FROM orders),
  m AS (SELECT *, CASE {' '.join(f"WHEN n <= {t[0]} THEN {t[1]}" for t in futures.TIERS[:-1])} ELSE {futures.TIERS[-1][1]} END AS rate, CASE {' '.join(f"WHEN n <= {t[0]} THEN {t[2]}" for t in futures.TIERS[:-1])} ELSE {futures.TIERS[-1][2]} END AS cum FROM p)
  SELECT o_orderkey, rate, round(CASE WHEN side > 0 THEN (n - n / 20 - cum) / (n / e * (1 - rate)) ELSE (n + n / 20 + cum) / (n / e * (1 + rate)) END, 6) AS price FROM m""")
def liquidation(spark, sf_dir):
    rows = run(spark, sf_dir, "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS side, 250.0 AS e, o_totalprice * CASE o_orderkey % 4 WHEN 0 THEN 0.1 WHEN 1 THEN 3.0 WHEN 2 THEN 40.0 ELSE 400.0 END AS n FROM {orders}")
    n = F.col("n")
    return rows.select("o_orderkey", futures.tier(n)["rate"].alias("rate"), F.round(futures.liquidation(F.col("side"), F.col("e"), n / F.col("e"), n / 20), 6).alias("price"))


#: What a trade adds for each unit of value at its entry: price, fees on both sides, funding on the notional.
_GAIN = f"{MARGIN * LEVERAGE} * (side * (x / e - 1) - CASE WHEN maker = 1 THEN {MAKER} ELSE {TAKER} END - x / e * {TAKER} - side * paid)"
_ADMITTED = f"""q AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY entry, id) AS i FROM tr),
  w AS (SELECT book, id, i, true AS admitted, [leave] AS held, entry AS last FROM q WHERE i = 1 UNION ALL
    SELECT book, id, i, good, CASE WHEN good THEN list_append(held, leave) ELSE held END, CASE WHEN good THEN entry ELSE last END FROM (
      SELECT book, id, i, leave, entry, last, held, len(held) < {CAP} AND entry - last >= {GAP} AS good FROM (
        SELECT q.book, q.id, q.i, q.leave, q.entry, w.last, list_filter(w.held, lambda x: x >= q.entry) AS held FROM w JOIN q ON q.book = w.book AND q.i = w.i + 1) AS a) AS b),
  adm AS (SELECT book, id, admitted FROM w)"""
_ACCOUNT_SQL = f"""RECURSIVE {_FUNDED}, {_ADMITTED}, h AS (SELECT tr.*, fu.paid, {_GAIN} AS gain, row_number() OVER (PARTITION BY book ORDER BY leave, entry, id) AS i FROM tr JOIN fu USING (id) JOIN adm USING (book, id) WHERE admitted),
  n AS (SELECT h.book, h.id, h.i, h.gain, count(o.id) AS n FROM h LEFT JOIN h AS o ON o.book = h.book AND o.i < h.i AND o.leave <= h.entry GROUP BY h.book, h.id, h.i, h.gain),
  s AS (SELECT book, id, i, CAST(1 AS DOUBLE) AS base, [1.0, 1.0 + gain] AS v FROM n WHERE i = 1 UNION ALL
    SELECT n.book, n.id, n.i, s.v[n.n + 1], list_append(s.v, s.v[len(s.v)] + n.gain * s.v[n.n + 1]) FROM s JOIN n ON n.book = s.book AND n.i = s.i + 1),
  acc AS (SELECT h.*, {CAPITAL} * s.base AS base, {CAPITAL} * s.v[len(s.v)] AS after FROM s JOIN h USING (book, id, i))"""


def _account(spark, sf_dir):
    trades = _funded(spark, sf_dir)
    admitted = books.admit(run(spark, sf_dir, _TRADES), "book", "entry", "leave", CAP, GAP, 604800).where("admitted").select("book", "id")
    trades = trades.join(admitted, ["book", "id"]).withColumn("gain", F.expr(_GAIN.replace("0.5 *", "0.5D *")))
    value = books.equity(trades, "book", "entry", "leave", "gain", 1.0, 604800, CAPITAL)
    return trades.join(value.withColumnRenamed("equity_after", "after"), ["book", "id"])


@query("j09_futures_account", duck(f"WITH {_ACCOUNT_SQL} SELECT book, id, round(base, 4) AS base, round(base * {MARGIN * LEVERAGE} / e, 6) AS qty, round(base * gain, 4) AS net, round(after, 4) AS equity_after, round(100 * gain / {MARGIN}, 6) AS roe_pct FROM acc"))
def futures_account(spark, sf_dir):
    """Size, net result and value of each trade of a cross-margin account that stakes a share of its value at entry."""
    rows = _account(spark, sf_dir)
    r = lambda c, n: F.round(c, n)
    return rows.select("book", "id", r(F.col("base"), 4).alias("base"), r(F.col("base") * MARGIN * LEVERAGE / F.col("e"), 6).alias("qty"), r(F.col("base") * F.col("gain"), 4).alias("net"), r(F.col("after"), 4).alias("equity_after"), r(100 * F.col("gain") / MARGIN, 6).alias("roe_pct"))


@query("e40_account_summary", duck(f"""WITH {_ACCOUNT_SQL}, c AS (SELECT *, greatest(max(after) OVER (PARTITION BY book ORDER BY i), {CAPITAL}) AS peak FROM acc)
  SELECT book, count(*) AS n, round(arg_max(after, i), 3) AS final, round(100 * max((peak - after) / peak), 5) AS drawdown_pct, round(avg(CASE WHEN gain > 0 THEN 1.0 ELSE 0.0 END), 6) AS win, round(sum(base * {MARGIN * LEVERAGE} * -side * paid), 3) AS funding,
    round((pow(greatest(arg_max(after, i), 0) / {CAPITAL}, 365.0 / greatest((max(leave) - min(entry)) // 86400, 1)) - 1) * 100, 3) AS cagr_pct FROM c GROUP BY book"""))
def account_summary(spark, sf_dir):
    rows = folds.running(_account(spark, sf_dir), ["book"], F.floor(F.col("leave") / 86400), ["leave", "entry", "id"], maxes={"peak": F.col("after")}).withColumn("peak", F.greatest("peak", F.lit(CAPITAL)))
    last = F.max_by("after", F.struct("leave", "entry", "id"))
    days = F.greatest(F.floor((F.max("leave") - F.min("entry")) / 86400), F.lit(1))
    return rows.groupBy("book").agg(
        F.count(F.lit(1)).alias("n"), F.round(last, 3).alias("final"), F.round(100 * F.max((F.col("peak") - F.col("after")) / F.col("peak")), 5).alias("drawdown_pct"), F.round(F.avg(F.when(F.col("gain") > 0, 1.0).otherwise(0.0)), 6).alias("win"),
        F.round(F.sum(F.col("base") * MARGIN * LEVERAGE * -F.col("side") * F.col("paid")), 3).alias("funding"), F.round((F.pow(F.greatest(last, F.lit(0.0)) / CAPITAL, F.lit(365.0) / days) - 1) * 100, 3).alias("cagr_pct"),
    )


@query("o22_account_periods", duck(f"WITH {_ACCOUNT_SQL} SELECT book, leave // 604800 AS week, count(*) AS n, round(sum(base * gain), 3) AS net, count(*) FILTER (WHERE gain <= -0.05) AS large_losses, round(sum(base * {MARGIN * LEVERAGE} * (CASE WHEN maker = 1 THEN {MAKER} ELSE {TAKER} END + x / e * {TAKER})), 3) AS fees FROM acc GROUP BY ALL"))
def account_periods(spark, sf_dir):
    rows = _account(spark, sf_dir)
    fee = F.when(F.col("maker") == 1, MAKER).otherwise(TAKER) + F.col("x") / F.col("e") * TAKER
    return rows.groupBy("book", F.floor(F.col("leave") / 604800).alias("week")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("base") * F.col("gain")), 3).alias("net"), F.count_if(F.col("gain") <= -0.05).alias("large_losses"), F.round(F.sum(F.col("base") * MARGIN * LEVERAGE * fee), 3).alias("fees"))


@query("j18_provenance", duck(f"""WITH {BARS}, x AS (SELECT instrument, t, t // 3600 % 11 = 0 AS back, t // 3600 % 17 = 0 AS rec, t + 3600 + ticks AS got, row_number() OVER (PARTITION BY instrument ORDER BY t) AS i FROM bars)
  SELECT a.instrument, a.t, bool_or(b.back) AS contains_backfill, bool_or(b.rec) AS contains_recovery, max(b.got) AS latest FROM x AS a JOIN x AS b ON b.instrument = a.instrument AND b.i > a.i - 12 AND b.i <= a.i WHERE a.i >= 12 GROUP BY a.instrument, a.t"""))
def provenance(spark, sf_dir):
    """What went into each window of twelve bars: whether any was filled in later, and when the last became known."""
    order = W.partitionBy("instrument").orderBy("t")
    over = order.rowsBetween(-11, 0)
    rows = run(spark, sf_dir, f"WITH {BARS} SELECT instrument, t, t DIV 3600 % 11 = 0 AS back, t DIV 3600 % 17 = 0 AS rec, t + 3600 + ticks AS got FROM bars")
    return rows.select("instrument", "t", F.bool_or("back").over(over).alias("contains_backfill"), F.bool_or("rec").over(over).alias("contains_recovery"), F.max("got").over(over).alias("latest"), F.count(F.lit(1)).over(over).alias("n")).where("n = 12").drop("n")


@query("j15_refresh", duck(f"""WITH {BARS}, have AS (SELECT instrument, t, close FROM bars WHERE t < (SELECT max(t) FROM bars) - 172800), new AS (SELECT instrument, t, close + CASE WHEN t // 3600 % 97 = 0 THEN 1.0 ELSE 0.0 END AS close FROM bars)
  SELECT n.instrument, count(*) FILTER (WHERE h.t IS NULL) AS appended, count(*) FILTER (WHERE abs(h.close - n.close) > 1e-4) AS disagree FROM new AS n LEFT JOIN have AS h ON h.instrument = n.instrument AND h.t = n.t GROUP BY n.instrument"""))
def refresh(spark, sf_dir):
    """New hours appended to a history, and hours on which the two sources disagree."""
    bars = run(spark, sf_dir, f"WITH {BARS} SELECT instrument, t, close, t < (SELECT max(t) FROM bars) - 172800 AS old FROM bars")
    new = bars.withColumn("close", F.col("close") + F.when(F.floor(F.col("t") / 3600) % 97 == 0, 1.0).otherwise(0.0)).drop("old")
    both = new.join(bars.where("old").select("instrument", "t", F.col("close").alias("was")), ["instrument", "t"], "left")
    return both.groupBy("instrument").agg(F.count_if(F.col("was").isNull()).alias("appended"), F.count_if(F.abs(F.col("was") - F.col("close")) > 1e-4).alias("disagree"))


def config_key(parameters: dict) -> str:
    """A short name of a set of parameters, the same for any order of theirs."""
    return hashlib.sha1(json.dumps(parameters, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


@query("j16_config_lock", "SELECT sha1('{\"b\":[1,2],\"horizon\":8,\"name\":\"touch\"}') AS key, 1 AS same")
def config_lock(spark, sf_dir):
    one, two = config_key({"horizon": 8, "b": [1, 2], "name": "touch"}), config_key({"name": "touch", "b": [1, 2], "horizon": 8})
    return spark.createDataFrame([(one, int(one == two))], "key string, same int")


_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


@query("i25_uuid5")
def window_uuids(spark, sf_dir):
    """Version 5 ids of windows in Arrow batches; no SQL function makes them (tests hold them against the library's)."""

    @F.pandas_udf("string")
    def ids(names: pd.Series) -> pd.Series:
        return names.map(lambda n: str(uuid.uuid5(_SPACE, n)))

    return run(spark, sf_dir, "SELECT event_id, concat('window:', CAST(event_id AS STRING)) AS name FROM {events}").select("event_id", ids("name").alias("id"))


dual("i02_clip_where", "SELECT event_id, least(greatest(value, 10.0), 100.0) AS clipped, CASE WHEN value > 50 THEN value ELSE 0.0 END AS kept, CASE WHEN value IS NULL THEN NULL ELSE greatest(value, 20.0) END AS floored FROM {events}")
