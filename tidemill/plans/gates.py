"""Rolling thresholds of two signals on five-minute rows, and the two orders of gates."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from tidemill.operators.ranks import gated_quantiles, rolling_quantiles
from tidemill.plans.dual import duck, run
from tidemill.registry import query

#: Days of the touch frame, days of the direction frame, rows that pass the first gate at least.
TOUCH_DAYS, DIR_DAYS, DIR_HITS, TOUCH_HITS = 14, 90, 20, 5
TOUCH, DIR = TOUCH_DAYS * 86400, DIR_DAYS * 86400
#: Rows of a frame at least: few, so that short tables have results too.
LEAST = 24
TOUCH_TOPS, DIR_TOPS = (0.3, 0.5), (0.2, 0.4)
#: Five-minute rows of each kind of event: p stands for the touch score, d for the signed direction score.
FIVE = """five AS (SELECT event_type AS instrument, @epoch(ts) - @epoch(ts) % 300 AS t, max(value) AS p, max_by(value, ts) - 100 AS d
  FROM {events} GROUP BY event_type, @epoch(ts) - @epoch(ts) % 300)"""
_DUCK = duck(f"WITH {FIVE}")


def _frame(width: int) -> str:
    return f"OVER (PARTITION BY instrument ORDER BY t RANGE BETWEEN {width} PRECEDING AND 1 PRECEDING)"


def _five(spark, sf_dir):
    return run(spark, sf_dir, f"WITH {FIVE} SELECT * FROM five")


def _at(name: str, i: int):
    return F.round(F.element_at(name, i + 1), 6)


@query("f17_rolling_quantile", f"{_DUCK} SELECT instrument, t, CASE WHEN count(*) {_frame(TOUCH)} >= {LEAST} THEN round(quantile_cont(p, 0.8) {_frame(TOUCH)}, 6) END AS threshold, CASE WHEN count(*) {_frame(DIR)} >= {LEAST} THEN round(quantile_cont(p, 0.5) {_frame(DIR)}, 6) END AS middle FROM five")
def rolling_threshold(spark, sf_dir):
    """The top fifth of the last 14 days and the median of the last 90, each row's own left out."""
    rows = rolling_quantiles(_five(spark, sf_dir), ["instrument"], "t", "p", TOUCH, [0.8], LEAST, "a")
    rows = rolling_quantiles(rows, ["instrument"], "t", "p", DIR, [0.5], LEAST, "b")
    return rows.select("instrument", "t", _at("a", 0).alias("threshold"), _at("b", 0).alias("middle"))


@query("f18_masked_quantile", f"{_DUCK}, m AS (SELECT *, CASE WHEN d > 0 THEN p END AS v FROM five) SELECT instrument, t, CASE WHEN count(*) {_frame(TOUCH)} >= {LEAST} AND count(v) {_frame(TOUCH)} >= {TOUCH_HITS} THEN round(quantile_cont(v, 0.5) {_frame(TOUCH)}, 6) END AS threshold FROM m")
def masked_threshold(spark, sf_dir):
    """The median of those rows of the last 14 days that a mask lets through."""
    rows = _five(spark, sf_dir).withColumn("ok", F.col("d") > 0)
    return rolling_quantiles(rows, ["instrument"], "t", "p", TOUCH, [0.5], TOUCH_HITS, "a", LEAST, "ok").select("instrument", "t", _at("a", 0).alias("threshold"))


def _touch_first(tt: float) -> str:
    """(instrument, t, thr, hits, ds): the direction scores of the past rows that reach the row's own touch threshold."""
    return f"""q{int(tt * 100)} AS (SELECT a.instrument, a.t, a.thr, count(*) AS hits, list_sort(list(b.d)) AS ds FROM
      (SELECT *, CASE WHEN count(*) {_frame(TOUCH)} >= {LEAST} THEN quantile_cont(p, 1 - {tt}) {_frame(TOUCH)} END AS thr, count(*) {_frame(DIR)} AS m FROM five) AS a
      JOIN five AS b ON b.instrument = a.instrument AND b.t >= a.t - {DIR} AND b.t < a.t AND b.p >= a.thr WHERE a.m >= {LEAST} GROUP BY a.instrument, a.t, a.thr HAVING count(*) >= {DIR_HITS})"""


def _of_list(values: str, q: float) -> str:
    place = f"({q} * (len({values}) - 1))"
    low = f"CAST(floor{place} AS BIGINT)"
    return f"({values}[{low} + 1] + ({values}[least({low} + 2, len({values}))] - {values}[{low} + 1]) * ({place} - {low}))"


@query("f19_own_threshold_gate", f"{_DUCK}, {_touch_first(0.4)} SELECT instrument, t, hits, round({_of_list('ds', 0.9)}, 6) AS long_gate, round(-{_of_list('ds', 0.1)}, 6) AS short_gate FROM q40")
def own_threshold_gate(spark, sf_dir):
    """Both sides' gates: quantiles among the rows of the last 90 days that reach the current row's own threshold."""
    rows = rolling_quantiles(_five(spark, sf_dir), ["instrument"], "t", "p", TOUCH, [1 - 0.4], LEAST, "a").withColumn("thr", F.element_at("a", 1))
    rows = gated_quantiles(rows, ["instrument"], "t", "p", "d", "thr", DIR, [0.9, 0.1], LEAST, DIR_HITS, "g").where("g IS NOT NULL")
    return rows.select("instrument", "t", F.col("g_n").alias("hits"), _at("g", 0).alias("long_gate"), (-_at("g", 1)).alias("short_gate"))


def _gates_sql() -> str:
    sides = ", ".join(f"CASE WHEN count(*) {_frame(DIR)} >= {LEAST} THEN quantile_cont(d, {1 - dt / 2}) {_frame(DIR)} END AS l{i}, CASE WHEN count(*) {_frame(DIR)} >= {LEAST} THEN -quantile_cont(d, {dt / 2}) {_frame(DIR)} END AS s{i}" for i, dt in enumerate(DIR_TOPS))
    cells = [f"SELECT 'touch_first' AS gate_order, {tt} AS touch_top, {dt} AS dir_top, instrument, t, thr, {_of_list('ds', 1 - dt / 2)} AS l, -{_of_list('ds', dt / 2)} AS s FROM q{int(tt * 100)}" for tt, dt in itertools.product(TOUCH_TOPS, DIR_TOPS)]
    for tt, (i, dt) in itertools.product(TOUCH_TOPS, enumerate(DIR_TOPS)):
        passing = f"CASE WHEN d > 0 AND d >= l{i} OR d < 0 AND -d >= s{i} THEN p END"
        cells.append(f"SELECT 'dir_first', {tt}, {dt}, instrument, t, CASE WHEN count(*) {_frame(TOUCH)} >= {LEAST} AND count({passing}) {_frame(TOUCH)} >= {TOUCH_HITS} THEN quantile_cont({passing}, {1 - tt}) {_frame(TOUCH)} END, l{i}, s{i} FROM sides")
    return f"{_DUCK}, {', '.join(map(_touch_first, TOUCH_TOPS))}, sides AS (SELECT *, {sides} FROM five) SELECT gate_order, touch_top, dir_top, instrument, t, round(thr, 6) AS thr, round(l, 6) AS long_gate, round(s, 6) AS short_gate FROM ({' UNION ALL '.join(cells)}) WHERE thr IS NOT NULL AND l IS NOT NULL"


@query("f20_gate_orders", _gates_sql())
def gate_orders(spark, sf_dir):
    """Thresholds of each pair of shares in both orders. touch_first: the direction's quantiles are taken among the rows of 90 days
    that reach the current row's touch threshold of 14 days. dir_first: the touch quantile is taken among the rows of 14 days
    that passed the direction gates of 90 days, each by its own."""
    by, sides = ["instrument"], [q for dt in DIR_TOPS for q in (1 - dt / 2, dt / 2)]
    rows = rolling_quantiles(_five(spark, sf_dir), by, "t", "p", TOUCH, [1 - tt for tt in TOUCH_TOPS], LEAST, "a")
    rows = rolling_quantiles(rows, by, "t", "d", DIR, sides, max(LEAST, DIR_HITS), "b")
    cells = []
    for i, tt in enumerate(TOUCH_TOPS):
        rows = gated_quantiles(rows.withColumn(f"thr{i}", F.element_at("a", i + 1)), by, "t", "p", "d", f"thr{i}", DIR, sides, LEAST, DIR_HITS, f"g{i}")
    for j, dt in enumerate(DIR_TOPS):
        long, short = F.element_at("b", 2 * j + 1), -F.element_at("b", 2 * j + 2)
        rows = rows.withColumn(f"ok{j}", F.coalesce((F.col("d") > 0) & (F.col("d") >= long) | (F.col("d") < 0) & (-F.col("d") >= short), F.lit(False)))
        rows = rolling_quantiles(rows, by, "t", "p", TOUCH, [1 - tt for tt in TOUCH_TOPS], TOUCH_HITS, f"h{j}", LEAST, f"ok{j}")
    for (i, tt), (j, dt) in itertools.product(enumerate(TOUCH_TOPS), enumerate(DIR_TOPS)):
        for kind, thr, gates in (("touch_first", F.col(f"thr{i}"), f"g{i}"), ("dir_first", F.element_at(f"h{j}", i + 1), "b")):
            cells.append(F.struct(F.lit(kind).alias("gate_order"), F.lit(tt).alias("touch_top"), F.lit(dt).alias("dir_top"), F.round(thr, 6).alias("thr"), _at(gates, 2 * j).alias("long_gate"), (-_at(gates, 2 * j + 1)).alias("short_gate")))
    found = rows.select("instrument", "t", F.explode(F.array(*cells)).alias("c")).select("c.gate_order", "c.touch_top", "c.dir_top", "instrument", "t", "c.thr", "c.long_gate", "c.short_gate")
    return found.where("thr IS NOT NULL AND long_gate IS NOT NULL")
