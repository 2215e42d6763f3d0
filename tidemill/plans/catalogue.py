"""The rest of the features (2.11) over hourly bars of each instrument: context, positions, legs, relations, channel, levels of
confirmed pivots, positioning, and the remaining directional ones.

A bar sees the last EIGHT pivots confirmed by its time; they come to it by an as-of carry, as one array a bar. Path statistics
between two bars are differences of running sums at both. Undefined values are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidemill.functions.ieee import ln, over as divided
from tidemill.operators.folds import ewm_volatility
from tidemill.operators.pivots import confirmed_pivots
from tidemill.plans import market  # noqa: F401  registers J01
from tidemill.plans.dual import BARS, duck, run
from tidemill.registry import SQL, query

SPAN, HORIZON, REVERSAL, EIGHT, LEGS = 24, 8, 0.3, 8, 5
#: Half-width of a barrier in units of the expected move, for channel and levels.
LEAST, MOST = 0.1, 2.0
RELATIONS = (("c1", "l1"), ("l1", "l2"), ("l2", "l3"))

_RECURSION = f"""moves AS (SELECT instrument, t, open, high, low, close, volume, ticks, ln(close) AS lc, coalesce(ln(close) - lag(ln(close)) OVER w, 0) AS r, row_number() OVER w AS i FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY t)),
steps AS (SELECT instrument, i, r * r AS v FROM moves WHERE i = 1 UNION ALL SELECT m.instrument, m.i, s.v * (1 - 2.0 / {SPAN + 1}) + 2.0 / {SPAN + 1} * m.r * m.r FROM steps AS s JOIN moves AS m ON m.instrument = s.instrument AND m.i = s.i + 1),
x AS (SELECT m.*, CASE WHEN m.i >= {SPAN} THEN greatest(sqrt(v), 1e-6) END AS sigma, sum(abs(r)) OVER (PARTITION BY instrument ORDER BY i) AS cs, sum(r * r) OVER (PARTITION BY instrument ORDER BY i) AS cq FROM moves AS m JOIN steps USING (instrument, i))"""
_WITH = duck(f"WITH RECURSIVE {BARS}, {_RECURSION}")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with number, log price, move, volatility and running sums of the moves' sizes and squares."""
    bars = run(spark, sf_dir, f"WITH {BARS} SELECT instrument, t, open, high, low, close, volume, ticks FROM bars")
    over = W.partitionBy("instrument").orderBy("t")
    rows = bars.withColumn("lc", ln("close")).withColumn("r", F.coalesce(F.col("lc") - F.lag("lc").over(over), F.lit(0.0)))
    rows = rows.select("*", F.row_number().over(over).alias("i"), F.sum(F.abs("r")).over(over).alias("cs"), F.sum(F.col("r") * F.col("r")).over(over).alias("cq"))
    return rows.join(ewm_volatility(bars, "instrument", "t", "close", SPAN, 400 * 3600), ["instrument", "t"])


def with_pivots(rows: DataFrame) -> DataFrame:
    """rows with p, the last EIGHT pivots known at each (oldest first), and dev, the extreme since the last confirmation; only
    bars that know as many. A pivot is (i, lc, cs, cq, kind, jump): jump is the largest move from it to before the next."""
    over = W.partitionBy("instrument").orderBy("t")
    pivots = confirmed_pivots(rows, "instrument", "t", "high", "low", REVERSAL)
    at = rows.select("instrument", F.col("t").alias("pivot"), "i", "cs", "cq")
    pivots = pivots.join(at, ["instrument", "pivot"])
    starts = pivots.select("instrument", F.col("pivot").alias("t"), F.lit(True).alias("turn"))
    legs = rows.join(starts, ["instrument", "t"], "left").withColumn("pivot", F.last(F.when(F.col("turn"), F.col("t")), ignorenulls=True).over(over))
    legs = legs.groupBy("instrument", "pivot").agg(F.max(F.abs("r")).alias("jump"))
    order = W.partitionBy("instrument").orderBy("confirmed")
    known = pivots.join(legs, ["instrument", "pivot"]).withColumn("p", F.collect_list(F.struct("i", ln("price").alias("lc"), "cs", "cq", "kind", "jump")).over(order.rowsBetween(1 - EIGHT, 0)))
    seen = rows.join(known.select("instrument", F.col("confirmed").alias("t"), "p", F.col("confirmed").alias("since")), ["instrument", "t"], "left")
    seen = seen.withColumn("known", F.last(F.when(F.col("since").isNotNull(), F.struct("p", "since")), ignorenulls=True).over(over)).where("known IS NOT NULL").drop("p", "since").select("*", "known.*").drop("known")
    rising = F.element_at("p", -1)["kind"] < 0
    value = F.when(rising, ln("high")).otherwise(-ln("low"))
    best = F.max(F.struct(value.alias("v"), "i", "cs", "cq")).over(W.partitionBy("instrument", "since").orderBy("t"))
    seen = seen.withColumn("b", best).withColumn("dev", F.struct(F.col("b.i").alias("i"), F.when(rising, F.col("b.v")).otherwise(-F.col("b.v")).alias("lc"), F.col("b.cs").alias("cs"), F.col("b.cq").alias("cq")))
    return seen.where(F.size("p") == EIGHT).drop("b")


def _pivot_sql() -> str:
    """The same by joins: each bar with its eight last pivots as columns p1 (newest) to p8, and the developing extreme."""
    picks = ", ".join(f"max(CASE WHEN k = {j} THEN p{c} END) AS p{j}_{c}" for j in range(1, EIGHT + 1) for c in ("i", "lc", "cs", "cq", "kind", "jump"))
    return f"""{_WITH}, piv AS (SELECT instrument, "pivot" AS at, confirmed, price, kind, row_number() OVER (PARTITION BY instrument ORDER BY confirmed) AS n FROM ({SQL["j01_confirmed_pivots"]})),
    pp AS (SELECT p.instrument, p.confirmed, p.n, x.i AS pi, ln(p.price) AS plc, x.cs AS pcs, x.cq AS pcq, p.kind AS pkind, (SELECT max(abs(y.r)) FROM x AS y WHERE y.instrument = p.instrument AND y.t >= p.at AND y.t < coalesce(q.at, 9e18)) AS pjump
           FROM piv AS p JOIN x ON x.instrument = p.instrument AND x.t = p.at LEFT JOIN piv AS q ON q.instrument = p.instrument AND q.n = p.n + 1),
    c AS (SELECT x.instrument, x.i, max(p.n) AS n, max(p.confirmed) AS since FROM x JOIN pp AS p ON p.instrument = x.instrument AND p.confirmed <= x.t GROUP BY x.instrument, x.i HAVING max(p.n) >= {EIGHT}),
    e AS (SELECT c.instrument, c.i, c.since, {picks} FROM c JOIN (SELECT *, pi AS z FROM pp) AS p ON p.instrument = c.instrument AND p.n > c.n - {EIGHT} AND p.n <= c.n, LATERAL (SELECT c.n - p.n + 1 AS k) AS kk GROUP BY c.instrument, c.i, c.since),
    dv AS (SELECT e.instrument, e.i, CASE WHEN e.p1_kind < 0 THEN arg_max(y.i, (y.high, y.i)) ELSE arg_min(y.i, (y.low, -y.i)) END AS di, CASE WHEN e.p1_kind < 0 THEN ln(max(y.high)) ELSE ln(min(y.low)) END AS dlc
           FROM e JOIN x AS y ON y.instrument = e.instrument AND y.t >= e.since AND y.i <= e.i GROUP BY e.instrument, e.i, e.p1_kind),
    f AS (SELECT x.instrument, x.t, x.i, x.lc, x.cs, x.cq, x.sigma, x.sigma * sqrt({HORIZON}.0) AS s, least(greatest(x.sigma * sqrt({HORIZON}.0), {LEAST}), {MOST}) / (x.sigma * sqrt({HORIZON}.0)) AS rb, e.* EXCLUDE (instrument, i), d.di, d.dlc, y.cs AS dcs, y.cq AS dcq
          FROM e JOIN x ON x.instrument = e.instrument AND x.i = e.i JOIN dv AS d ON d.instrument = e.instrument AND d.i = e.i JOIN x AS y ON y.instrument = e.instrument AND y.i = d.di)"""


def _spark_path(prefix: str, a: Column, b: Column, jump: Column | None) -> tuple[list[Column], Column, Column]:
    dur, disp, plen, square = b["i"] - a["i"], b["lc"] - a["lc"], b["cs"] - a["cs"], b["cq"] - a["cq"]
    there = lambda c: F.round(F.when(dur > 0, c), 5)
    rv = F.sqrt(F.greatest(square, F.lit(0.0)) / F.greatest(dur, F.lit(1)))
    out = [F.round(F.abs(disp / F.col("s")), 5).alias(f"{prefix}_adisp"), there(F.abs(disp) / F.greatest(plen, F.lit(1e-12))).alias(f"{prefix}_er"), there(rv / F.col("sigma")).alias(f"{prefix}_rv"), there(dur / HORIZON).alias(f"{prefix}_dur")]
    if jump is not None:
        out.append(F.round(F.greatest(F.least(jump / F.greatest(plen, F.lit(1e-12)), F.lit(1.0)), F.lit(0.0)), 5).alias(f"{prefix}_jump"))
    return out, disp, dur


def _sql_path(prefix: str, a: str, b: str, jump: str | None) -> tuple[list[str], str, str]:
    dur, disp, plen, square = f"({b}i - {a}i)", f"({b}lc - {a}lc)", f"({b}cs - {a}cs)", f"({b}cq - {a}cq)"
    out = [f"round(abs({disp} / s), 5) AS {prefix}_adisp", f"CASE WHEN {dur} > 0 THEN round(abs({disp}) / greatest({plen}, 1e-12), 5) END AS {prefix}_er",
           f"CASE WHEN {dur} > 0 THEN round(sqrt(greatest({square}, 0) / {dur}) / sigma, 5) END AS {prefix}_rv", f"CASE WHEN {dur} > 0 THEN round({dur} / {HORIZON}.0, 5) END AS {prefix}_dur"]
    if jump:
        out.append(f"round(least({jump} / greatest({plen}, 1e-12), 1.0), 5) AS {prefix}_jump")
    return out, disp, dur


def _seen(spark, sf_dir) -> DataFrame:
    s = F.col("sigma") * F.sqrt(F.lit(float(HORIZON)))
    rows = with_pivots(base(spark, sf_dir)).withColumn("s", s)
    return rows.withColumn("rb", F.least(F.greatest(s, F.lit(LEAST)), F.lit(MOST)) / F.col("s")).withColumn("now", F.struct("i", "lc", "cs", "cq"))


def _p(j: int) -> Column:
    """The j-th newest pivot."""
    return F.element_at("p", -j)


def _text(what: list[str]) -> str:
    return f"{_pivot_sql()} SELECT instrument, t, {', '.join(what)} FROM f"


def _sql_only() -> tuple[list[str], dict]:
    texts, sizes = [], {}
    for prefix, a, b, jump in [*((f"l{j}", f"p{j + 1}_", f"p{j}_", f"p{j + 1}_jump") for j in range(1, LEGS + 1)), ("c1", "p1_", "d", None), ("c2", "d", "", None)]:
        out, disp, dur = _sql_path(prefix, a, b, jump)
        texts, sizes[prefix] = texts + out, (disp, dur)
    return [*texts, f"round(-{sizes['c2'][0]} / nullif({sizes['c1'][0]}, 0), 5) AS retrace_now"], sizes


@query("p03_leg_features", _text(_sql_only()[0]))
def leg_features(spark, sf_dir):
    """34 features: five completed legs, the one from the last pivot to the extreme since, and the one from there to now."""
    columns, sizes = [], {}
    for prefix, a, b, jump in [*((f"l{j}", _p(j + 1), _p(j), _p(j + 1)["jump"]) for j in range(1, LEGS + 1)), ("c1", _p(1), F.col("dev"), None), ("c2", F.col("dev"), F.col("now"), None)]:
        out, disp, _ = _spark_path(prefix, a, b, jump)
        columns, sizes[prefix] = columns + out, disp
    back = F.round(-sizes["c2"] / F.nullif(sizes["c1"], F.lit(0.0)), 5).alias("retrace_now")
    return _seen(spark, sf_dir).select("instrument", "t", *columns, back)


def _relations_sql() -> str:
    _, sizes = _sql_only()
    out = []
    for a, b in RELATIONS:
        out.append(f"round(ln(greatest(abs({sizes[a][0]}), 1e-9) / greatest(abs({sizes[b][0]}), 1e-9)), 5) AS rel_{a}_{b}_size")
        out.append(f"CASE WHEN {sizes[a][1]} > 0 AND {sizes[b][1]} > 0 THEN round(ln({sizes[a][1]} * 1.0 / {sizes[b][1]}), 5) END AS rel_{a}_{b}_time")
    return _text(out)


@query("p04_relation_features", _relations_sql())
def relation_features(spark, sf_dir):
    """How much larger and longer one leg is than another."""
    ends = {"c1": (_p(1), F.col("dev")), **{f"l{j}": (_p(j + 1), _p(j)) for j in range(1, 4)}}
    out = []
    for x, y in RELATIONS:
        (a, b), (c, d) = ends[x], ends[y]
        size = lambda p, q: F.greatest(F.abs(q["lc"] - p["lc"]), F.lit(1e-9))
        first, second = b["i"] - a["i"], d["i"] - c["i"]
        out += [F.round(ln(size(a, b) / size(c, d)), 5).alias(f"rel_{x}_{y}_size"), F.round(F.when((first > 0) & (second > 0), F.log(first / second)), 5).alias(f"rel_{x}_{y}_time")]
    return _seen(spark, sf_dir).select("instrument", "t", *out)


@query("p05_position_features", _text([f"round(sqrt(pow((p{j}_i - i) / {HORIZON}.0, 2) + pow((p{j}_lc - lc) / s, 2)), 5) AS pos{j}_r" for j in (1, 2)]))
def position_features(spark, sf_dir):
    """Distance of the last two pivots in time and price."""
    far = lambda j: F.round(F.hypot((_p(j)["i"] - F.col("i")) / HORIZON, (_p(j)["lc"] - F.col("lc")) / F.col("s")), 5).alias(f"pos{j}_r")
    return _seen(spark, sf_dir).select("instrument", "t", far(1), far(2))


def _channel_sql() -> str:
    point = lambda j: f"(p{j}_i - i) / {HORIZON}.0 AS x{j}, (p{j}_lc - lc) / s AS y{j}"
    swap = lambda c, a, b: f"CASE WHEN p1_kind = 1 THEN {c}{a} ELSE {c}{b} END"
    older = lambda c, a, b: f"CASE WHEN p3_kind = 1 THEN {c}{a} ELSE {c}{b} END"
    return f"""{_pivot_sql()}, q AS (SELECT instrument, t, rb, p1_kind, p3_kind, {', '.join(point(j) for j in (1, 2, 3, 4))} FROM f),
    u AS (SELECT instrument, t, rb, {swap("x", 1, 2)} AS xh1, {swap("y", 1, 2)} AS yh1, {swap("x", 2, 1)} AS xl1, {swap("y", 2, 1)} AS yl1, {older("x", 3, 4)} AS xh2, {older("y", 3, 4)} AS yh2, {older("x", 4, 3)} AS xl2, {older("y", 4, 3)} AS yl2 FROM q),
    v AS (SELECT *, (yh1 - yh2) / greatest(xh1 - xh2, 1e-6) AS su, (yl1 - yl2) / greatest(xl1 - xl2, 1e-6) AS sl, greatest(xh2, xl2) AS xr FROM u),
    w AS (SELECT *, (yh1 - su * xh1) - (yl1 - sl * xl1) AS w0, (yh1 + su * (xr - xh1)) - (yl1 + sl * (xr - xl1)) AS wr FROM v)
    SELECT instrument, t, round(least(greatest(w0 / rb, -20.0), 20.0), 4) AS ch_width, round(least(greatest((w0 - wr) / greatest(-xr, 1e-6), -20.0), 20.0), 4) AS ch_conv FROM w WHERE rb IS NOT NULL"""


@query("p06_channel_features", _channel_sql())
def channel_features(spark, sf_dir):
    """Lines through the last two highs and the last two lows of four pivots: their distance now, and how fast it closes."""
    rows = _seen(spark, sf_dir).where("rb IS NOT NULL")
    point = lambda j: F.struct(((_p(j)["i"] - F.col("i")) / HORIZON).alias("x"), ((_p(j)["lc"] - F.col("lc")) / F.col("s")).alias("y"))
    newest, older = _p(1)["kind"] == 1, _p(3)["kind"] == 1
    pick = lambda high, a, b: F.when(high, point(a)).otherwise(point(b))
    rows = rows.select("instrument", "t", "rb", pick(newest, 1, 2).alias("h1"), pick(newest, 2, 1).alias("l1"), pick(older, 3, 4).alias("h2"), pick(older, 4, 3).alias("l2"))
    slope = lambda a, b: (F.col(f"{a}.y") - F.col(f"{b}.y")) / F.greatest(F.col(f"{a}.x") - F.col(f"{b}.x"), F.lit(1e-6))
    rows = rows.withColumn("su", slope("h1", "h2")).withColumn("sl", slope("l1", "l2")).withColumn("ref", F.greatest("h2.x", "l2.x"))
    width = lambda x: (F.col("h1.y") + F.col("su") * (x - F.col("h1.x"))) - (F.col("l1.y") + F.col("sl") * (x - F.col("l1.x")))
    clip = lambda c: F.round(F.least(F.greatest(c, F.lit(-20.0)), F.lit(20.0)), 4)
    now = width(F.lit(0.0))
    return rows.select("instrument", "t", clip(divided(now, F.col("rb"))).alias("ch_width"), clip((now - width(F.col("ref"))) / F.greatest(-F.col("ref"), F.lit(1e-6))).alias("ch_conv"))


def _levels_sql() -> str:
    ys = [*(f"(p{j}_lc - lc) / s" for j in range(1, 6)), "(dlc - lc) / s"]
    return f"""{_pivot_sql()}, y AS (SELECT instrument, t, rb, unnest([{', '.join(ys)}]) AS y FROM f WHERE rb IS NOT NULL)
    SELECT instrument, t, round(min(CASE WHEN y > 0 THEN y END) / any_value(rb), 5) AS lvl_above, round(min(CASE WHEN y < 0 THEN -y END) / any_value(rb), 5) AS lvl_below, count(*) FILTER (WHERE abs(y) <= rb) AS lvl_count FROM y GROUP BY instrument, t"""


@query("p07_level_features", _levels_sql())
def level_features(spark, sf_dir):
    """The nearest level above and below among five pivots and the developing one, and how many are within reach."""
    y = lambda c: (c["lc"] - F.col("lc")) / F.col("s")
    rows = _seen(spark, sf_dir).where("rb IS NOT NULL").withColumn("ys", F.array(*[y(_p(j)) for j in range(1, 6)], y(F.col("dev"))))
    nearest = lambda sign: F.round(divided(F.array_min(F.transform(F.filter("ys", lambda v: v > 0 if sign > 0 else v < 0), lambda v: v * sign)), F.col("rb")), 5)
    return rows.select("instrument", "t", nearest(1).alias("lvl_above"), nearest(-1).alias("lvl_below"), F.size(F.filter("ys", lambda v: F.abs(v) <= F.col("rb"))).cast("long").alias("lvl_count"))


_CONTEXT_SQL = f"""{_WITH}, s2 AS (SELECT x.*, ln(1 + volume) AS lv, ln(1 + ticks) AS lt, (t // 3600) % 24 AS hr, (t // 86400 + 3) % 7 AS dow FROM x),
  m AS (SELECT *, quantile_cont(lv, 0.5) OVER w AS mv, quantile_cont(lt, 0.5) OVER w AS mt, quantile_cont(lv - lt, 0.5) OVER w AS ms, count(*) OVER w AS n FROM s2 WINDOW w AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
  d AS (SELECT *, quantile_cont(abs(lv - mv), 0.5) OVER (PARTITION BY instrument ORDER BY i ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS mad, CASE WHEN n >= 6 THEN lt - mt END AS tz, CASE WHEN n >= 6 THEN lv - lt - ms END AS sz FROM m)
  SELECT instrument, t, round(ln(sigma), 6) AS log_sigma, round(ln(sigma / avg(sigma) OVER (PARTITION BY instrument ORDER BY i ROWS BETWEEN 71 PRECEDING AND CURRENT ROW)), 6) AS sigma_ratio,
    round((lc - lag(lc, 24) OVER o) / (sigma * sqrt(24.0)), 6) AS trend_1d_z, round((lc - lag(lc, 120) OVER o) / (sigma * sqrt(120.0)), 6) AS trend_5d_z, round(abs(lc - lag(lc, 24) OVER o) / (sigma * sqrt(24.0)), 6) AS abs_trend_1d_z, round(abs(lc - lag(lc, 120) OVER o) / (sigma * sqrt(120.0)), 6) AS abs_trend_5d_z,
    round(sin(2 * pi() * hr / 24), 6) AS hour_sin, round(cos(2 * pi() * hr / 24), 6) AS hour_cos, round(sin(2 * pi() * dow / 7), 6) AS dow_sin, round(cos(2 * pi() * dow / 7), 6) AS dow_cos,
    CASE WHEN sigma IS NOT NULL THEN round(least(greatest(sigma * sqrt({HORIZON}.0), {LEAST}), {MOST}), 6) END AS barrier_pct, round(least(greatest(sigma * sqrt({HORIZON}.0), {LEAST}), {MOST}) / (sigma * sqrt({HORIZON}.0)), 6) AS barrier_ratio,
    round(greatest(-5.0, least(5.0, (lv - mv) / greatest(1.4826 * mad, 1e-4))), 6) AS rvol, CASE WHEN count(tz) OVER r6 = 6 THEN round(avg(tz) OVER r6, 6) END AS trades_rz_6, CASE WHEN count(tz) OVER r48 = 48 THEN round(avg(tz) OVER r48, 6) END AS trades_rz_48, CASE WHEN count(sz) OVER r12 = 12 THEN round(avg(sz) OVER r12, 6) END AS trade_size_rz_12,
    round(abs(close - 60) / 100, 6) AS funding_abs
  FROM d WINDOW o AS (PARTITION BY instrument ORDER BY i), r6 AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), r48 AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN 47 PRECEDING AND CURRENT ROW), r12 AS (PARTITION BY instrument ORDER BY i ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"""


@query("p08_context_features", _CONTEXT_SQL)
def context_features(spark, sf_dir):
    """17 features of when and how busy it is; the slow volatility is a mean of 72 bars here, and a rate is made from the price."""
    over = W.partitionBy("instrument").orderBy("i")
    last = lambda k: over.rowsBetween(1 - k, 0)
    rows = base(spark, sf_dir).withColumn("lv", F.log1p("volume")).withColumn("lt", F.log1p("ticks")).withColumn("n", F.count(F.lit(1)).over(last(24)))
    med = lambda c: F.percentile(c, F.lit(0.5)).over(last(24))
    rows = rows.withColumn("size", F.col("lv") - F.col("lt")).withColumn("off", F.col("lv") - med("lv")).withColumn("tz", F.when(F.col("n") >= 6, F.col("lt") - med("lt"))).withColumn("sz", F.when(F.col("n") >= 6, F.col("size") - med("size")))
    rows = rows.withColumn("dist", F.abs("off"))
    z = lambda k: (F.col("lc") - F.lag("lc", k).over(over)) / (F.col("sigma") * F.sqrt(F.lit(float(k))))
    s = F.col("sigma") * F.sqrt(F.lit(float(HORIZON)))
    barrier = F.when(s.isNotNull(), F.least(F.greatest(s, F.lit(LEAST)), F.lit(MOST)))
    whole = lambda c, k: F.when(F.count(c).over(last(k)) == k, F.avg(c).over(last(k)))
    angle = lambda v, n: 2 * F.pi() * v / n
    hour, day = F.hour(F.timestamp_seconds("t")), F.weekday(F.timestamp_seconds("t"))
    named = {
        "log_sigma": F.log("sigma"), "sigma_ratio": F.log(F.col("sigma") / F.avg("sigma").over(last(72))), "trend_1d_z": z(24), "trend_5d_z": z(120), "abs_trend_1d_z": F.abs(z(24)), "abs_trend_5d_z": F.abs(z(120)),
        "hour_sin": F.sin(angle(hour, 24)), "hour_cos": F.cos(angle(hour, 24)), "dow_sin": F.sin(angle(day, 7)), "dow_cos": F.cos(angle(day, 7)), "barrier_pct": barrier, "barrier_ratio": barrier / s,
        "rvol": F.greatest(F.least(F.col("off") / F.greatest(1.4826 * F.percentile("dist", F.lit(0.5)).over(last(24)), F.lit(1e-4)), F.lit(5.0)), F.lit(-5.0)),
        "trades_rz_6": whole("tz", 6), "trades_rz_48": whole("tz", 48), "trade_size_rz_12": whole("sz", 12), "funding_abs": F.abs(F.col("close") - 60) / 100,
    }
    return rows.select("instrument", "t", *[F.round(c, 6).alias(n) for n, c in named.items()])


_KINDS = (("acct_ls", "open"), ("top_pos_ls", "high"), ("top_acct_ls", "low"))


def _positioning_sql() -> str:
    z = lambda c: f"CASE WHEN count({c}) OVER w48 >= 20 THEN ({c} - avg({c}) OVER w48) / stddev_samp({c}) OVER w48 END"
    out = [f"round(oi - lag(oi, {k}) OVER o, 6) AS p_oi_{k}h" for k in (1, 4, 24)] + ["round((oi - lag(oi, 4) OVER o) * sign(lc - lag(lc, 4) OVER o), 6) AS p_oi4_x_ret4"]
    for name, _ in _KINDS:
        out += [f"round({name}, 6) AS p_{name}", f"round({z(name)}, 6) AS p_{name}_z7d", f"round({name} - lag({name}, 4) OVER o, 6) AS p_{name}_d4"]
    out += [f"round({z('top_pos_ls')} - {z('acct_ls')}, 6) AS p_top_minus_crowd", "round(prem, 6) AS p_prem", "CASE WHEN count(prem) OVER w24 >= 12 THEN round(avg(prem) OVER w24, 6) END AS p_prem_24", f"round({z('prem')}, 6) AS p_prem_z7d"]
    logs = ", ".join(f"CASE WHEN {c} > 3 THEN ln({c} - 3) END AS {n}" for n, c in _KINDS)
    return duck(f"""WITH {BARS}, q AS (SELECT instrument, t, ln(close) AS lc, CASE WHEN volume > 5 THEN ln(volume - 5) END AS oi, {logs}, (close / open - 1) * 10 AS prem FROM bars)
    SELECT instrument, t, {', '.join(out)} FROM q WINDOW o AS (PARTITION BY instrument ORDER BY t), w24 AS (PARTITION BY instrument ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), w48 AS (PARTITION BY instrument ORDER BY t ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)""")


@query("p09_positioning_features", _positioning_sql())
def positioning_features(spark, sf_dir):
    """17 features of open interest, long to short ratios and premium; z-scores over 48 bars with 20 at least here."""
    over = W.partitionBy("instrument").orderBy("t")
    last = lambda k: over.rowsBetween(1 - k, 0)
    positive = lambda c: F.when(c > 0, F.log(c))
    rows = run(spark, sf_dir, f"WITH {BARS} SELECT instrument, t, open, high, low, close, volume FROM bars")
    rows = rows.select("instrument", "t", ln("close").alias("lc"), positive(F.col("volume") - 5).alias("oi"), *[positive(F.col(c) - 3).alias(n) for n, c in _KINDS], ((divided(F.col("close"), F.col("open")) - 1) * 10).alias("prem"))
    change = lambda c, k: F.col(c) - F.lag(c, k).over(over)
    z = lambda c: F.when(F.count(c).over(last(48)) >= 20, divided(F.col(c) - F.avg(c).over(last(48)), F.stddev_samp(c).over(last(48))))
    named = {f"p_oi_{k}h": change("oi", k) for k in (1, 4, 24)} | {"p_oi4_x_ret4": change("oi", 4) * F.signum(change("lc", 4))}
    for n, _ in _KINDS:
        named |= {f"p_{n}": F.col(n), f"p_{n}_z7d": z(n), f"p_{n}_d4": change(n, 4)}
    named |= {"p_top_minus_crowd": z("top_pos_ls") - z("acct_ls"), "p_prem": F.col("prem"), "p_prem_24": F.when(F.count("prem").over(last(24)) >= 12, F.avg("prem").over(last(24))), "p_prem_z7d": z("prem")}
    return rows.select("instrument", "t", *[F.round(c, 6).alias(n) for n, c in named.items()])


_DIRECTION_SQL = f"""{_WITH}, piv AS (SELECT instrument, confirmed, price, kind, row_number() OVER (PARTITION BY instrument ORDER BY confirmed) AS n FROM ({SQL["j01_confirmed_pivots"]})),
  k AS (SELECT x.instrument, x.t, max(p.n) AS n FROM x JOIN piv AS p ON p.instrument = x.instrument AND p.confirmed <= x.t GROUP BY x.instrument, x.t),
  im AS (SELECT instrument, t, i, sigma, close, 2 * (high - low) / greatest(high, 1e-12) - 1 AS imb FROM x)
  SELECT im.instrument, im.t, {', '.join(f"CASE WHEN count(imb) OVER w{j} = {j} THEN round(avg(imb) OVER w{j}, 6) END AS d_taker_{j}" for j in (3, 6, 12, 24))}, round((close - 60) / 100, 6) AS d_funding,
    CASE WHEN count(close) OVER z >= 30 THEN round((close - avg(close) OVER z) / greatest(stddev_samp(close) OVER z, 1e-9), 6) END AS d_funding_z, -a.kind AS d_last_pivot_kind, round(ln(a.price / b.price) / sigma, 6) AS d_pivot_hhll
  FROM im LEFT JOIN k ON k.instrument = im.instrument AND k.t = im.t LEFT JOIN piv AS a ON a.instrument = k.instrument AND a.n = k.n LEFT JOIN piv AS b ON b.instrument = k.instrument AND b.n = greatest(k.n - 2, 1)
  WINDOW {', '.join(f"w{j} AS (PARTITION BY im.instrument ORDER BY im.i ROWS BETWEEN {j - 1} PRECEDING AND CURRENT ROW)" for j in (3, 6, 12, 24))}, z AS (PARTITION BY im.instrument ORDER BY im.i ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)"""


@query("p10_more_direction_features", _DIRECTION_SQL)
def more_direction_features(spark, sf_dir):
    """The directional features that need takers, a rate or pivots: a bar's range and price stand for the first two."""
    over = W.partitionBy("instrument").orderBy("t")
    last = lambda k: over.rowsBetween(1 - k, 0)
    rows = base(spark, sf_dir).withColumn("imb", 2 * (F.col("high") - F.col("low")) / F.greatest("high", F.lit(1e-12)) - 1)
    order = W.partitionBy("instrument").orderBy("confirmed")
    pivots = confirmed_pivots(rows, "instrument", "t", "high", "low", REVERSAL)
    known = pivots.select("instrument", F.col("confirmed").alias("t"), F.struct("kind", "price", F.coalesce(F.lag("price", 2).over(order), F.first("price").over(order)).alias("before")).alias("p"))
    rows = rows.join(known, ["instrument", "t"], "left").withColumn("p", F.last("p", ignorenulls=True).over(over))
    mean = lambda k: F.round(F.when(F.count("imb").over(last(k)) == k, F.avg("imb").over(last(k))), 6).alias(f"d_taker_{k}")
    z = F.when(F.count("close").over(last(90)) >= 30, (F.col("close") - F.avg("close").over(last(90))) / F.greatest(F.stddev_samp("close").over(last(90)), F.lit(1e-9)))
    return rows.select("instrument", "t", *map(mean, (3, 6, 12, 24)), F.round((F.col("close") - 60) / 100, 6).alias("d_funding"), F.round(z, 6).alias("d_funding_z"), (-F.col("p.kind")).alias("d_last_pivot_kind"), F.round(ln(divided(F.col("p.price"), F.col("p.before"))) / F.col("sigma"), 6).alias("d_pivot_hhll"))
