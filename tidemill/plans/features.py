"""Feature queries (2.11) over hourly bars of each instrument: 28 window features and 12 directional ones.

Shifts and frames count bars, not hours. A feature is null until its whole frame and the volatility are there.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemill.functions import ieee
from tidemill.operators.folds import ewm_volatility
from tidemill.plans.dual import BARS, duck, rewritten, run
from tidemill.registry import query

#: Bars of the volatility's span and of the horizon that scales distances.
SPAN, HORIZON = 24, 8

_BASE = """x AS (SELECT instrument, t, high, low, close, @ln(close) AS lc, abs(@ln(close) - lag(@ln(close)) OVER w) AS step, row_number() OVER w AS i
  FROM {bars} AS b WINDOW w AS (PARTITION BY instrument ORDER BY t)),
j AS (SELECT x.instrument, x.t, high, low, close, lc, step, i, sigma FROM x JOIN {vol} AS v ON v.instrument = x.instrument AND v.t = x.t)"""


def _over(k: int) -> str:
    return f"OVER (PARTITION BY instrument ORDER BY t ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def _lag(k: int) -> str:
    return f"lag(lc, {k}) OVER (PARTITION BY instrument ORDER BY t)"


def _window_features(sizes=(4, 8, 12, 24)) -> str:
    """Path of the last k moves: displacement, efficiency, volatility, largest move, distances to the extremes, range."""
    frames = ", ".join(f"lc - {_lag(k)} AS disp{k}, sum(step) {_over(k)} AS path{k}, sum(step * step) {_over(k)} AS square{k}, max(step) {_over(k)} AS most{k}, max(high) {_over(k)} AS top{k}, min(low) {_over(k)} AS bottom{k}" for k in sizes)
    scale = f"(sigma * sqrt({HORIZON}))"
    features = {}
    for k in sizes:
        path = f"greatest(path{k}, 1e-12)"
        features |= {
            f"w{k}_adisp": f"abs(disp{k}) / {scale}", f"w{k}_er": f"abs(disp{k}) / {path}", f"w{k}_rv": f"sqrt(square{k} / {k}) / sigma", f"w{k}_jump": f"most{k} / {path}",
            f"w{k}_up": f"(@ln(top{k}) - lc) / {scale}", f"w{k}_dn": f"(lc - @ln(bottom{k})) / {scale}", f"w{k}_rng": f"(@ln(top{k}) - @ln(bottom{k})) / {scale}",
        }
    shown = ", ".join(f"CASE WHEN i > {re.match(r'w(\d+)', name)[1]} THEN round({of}, 6) END AS {name}" for name, of in features.items())
    return f"WITH {_BASE}, f AS (SELECT instrument, t, i, lc, sigma, {frames} FROM j) SELECT instrument, t, {shown} FROM f"


def _direction_features(moves=(1, 3, 6, 12, 24), days=(1, 3, 7)) -> str:
    """Momentum over some bars, where the bar closed in its range, and distances to the extremes of some days."""
    features = [f"round((lc - {_lag(k)}) / (sigma * sqrt({k})), 6) AS d_ret_{k}" for k in moves]
    features.append("round(((close - low) / greatest(high - low, 1e-12) - 0.5) * 2, 6) AS d_close_loc")
    for d in days:
        features.append(f"CASE WHEN i >= {24 * d} THEN round((@ln(max(high) {_over(24 * d)}) - lc) / sigma, 6) END AS x{d}d_up")
        features.append(f"CASE WHEN i >= {24 * d} THEN round((lc - @ln(min(low) {_over(24 * d)})) / sigma, 6) END AS x{d}d_dn")
    return f"WITH {_BASE} SELECT instrument, t, {', '.join(features)} FROM j"


#: The volatility of the kernel as a recursion, for the check.
_CHECK = duck(f"""WITH RECURSIVE {BARS}, moves AS (SELECT instrument, t, coalesce(ln(close) - lag(ln(close)) OVER (PARTITION BY instrument ORDER BY t), 0) AS r, row_number() OVER (PARTITION BY instrument ORDER BY t) AS i FROM bars),
steps AS (SELECT instrument, t, i, r * r AS v FROM moves WHERE i = 1 UNION ALL SELECT m.instrument, m.t, m.i, s.v * (1 - 2.0 / {SPAN + 1}) + 2.0 / {SPAN + 1} * m.r * m.r FROM steps AS s JOIN moves AS m ON m.instrument = s.instrument AND m.i = s.i + 1),
vol AS (SELECT instrument, t, CASE WHEN i >= {SPAN} THEN greatest(sqrt(v), 1e-6) END AS sigma FROM steps), """)


def _add(name: str, text: str) -> None:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = run(spark, sf_dir, f"WITH {BARS} SELECT instrument, t, high, low, close FROM bars")
        return spark.sql(rewritten(text, ieee.SPARK).replace("0.5", "0.5D"), bars=bars, vol=ewm_volatility(bars, "instrument", "t", "close", SPAN, 400 * 3600))

    query(name, _CHECK + re.sub(r"\{(\w+)\}", r"\1", rewritten(text, ieee.DUCK)).removeprefix("WITH "))(build)


_add("p01_window_features", _window_features())
_add("p02_direction_features", _direction_features())
