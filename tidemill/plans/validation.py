"""Envelopes, predicates, hashes, revisions and contiguity of events, with bad rows put in."""

from __future__ import annotations

from pyspark.sql import Column, Window as W, functions as F

from tidemill.functions import validation as v
from tidemill.operators.joins import asof_sources
from tidemill.plans.dual import BARS, duck, dual, run
from tidemill.registry import query
from tidemill.sources.candles import fill, fill_bars, known_ms, prepare
from tidemill.sources.envelopes import envelopes as enveloped
from tidemill.sources.positioning import MEASURES, PREMIUM, positioning, reply_measures, reply_premium

#: Events as envelopes of an hour; some by their number with a wrong step, start, time of receipt, mode or schema.
_PUT = """SELECT event_id, event_type, value, CASE WHEN bad = 1 THEN 2 ELSE 1 END AS schema_version, CASE WHEN bad = 2 THEN 'test' WHEN bad = 3 THEN NULL WHEN bad = 4 THEN 'backfill' ELSE 'live' END AS mode,
  start_ms + CASE WHEN bad = 5 THEN 1 ELSE 0 END AS period_start_ms, start_ms + CASE WHEN bad = 6 THEN 7200000 ELSE 3600000 END + CASE WHEN bad = 5 THEN 1 ELSE 0 END AS period_end_ms,
  start_ms + CASE WHEN bad = 7 THEN 1000 WHEN bad = 8 THEN 900000000000 ELSE 3600500 END AS received_at_ms
  FROM (SELECT *, ms - ms % 3600000 AS start_ms FROM (SELECT event_id, event_type, value, @epoch(ts) * 1000 AS ms, event_id % 40 AS bad FROM {events}) AS a) AS b"""
_NOW = 1_900_000_000_000


@query("c02_envelopes", duck(f"""SELECT event_id, CAST(coalesce(schema_version = 1 AND mode IN ('live', 'backfill', 'recovery') AND period_start_ms % 3600000 = 0 AND period_end_ms - period_start_ms = 3600000
    AND received_at_ms >= period_end_ms AND received_at_ms - 60000 <= {_NOW}, false) AS INTEGER) AS valid FROM ({_PUT}) AS e"""))
def envelopes(spark, sf_dir):
    rows = run(spark, sf_dir, _PUT)
    return rows.select("event_id", v.envelope_valid(F.lit(3_600_000), F.lit(_NOW)).cast("int").alias("valid"))


@query("c07_content_hash", duck(f"""WITH e AS (SELECT *, '{{{{"kind":"' || event_type || '","period_start_ms":' || CAST(period_start_ms AS VARCHAR) || ',"value":"' || CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) || '"}}}}' AS j FROM ({_PUT}) AS p)
    SELECT event_id, sha256(j) AS hash, CASE WHEN event_id % 9 = 0 THEN 0 ELSE 1 END AS same FROM e""".replace("{{", "{").replace("}}", "}")))
def content_hash(spark, sf_dir):
    """The id of an event is the hash of what it says; a ninth of the given ids here are of something else."""
    rows = run(spark, sf_dir, _PUT)
    text = v.canonical(value=v.quoted(F.floor(F.col("value") * 100).cast("long")), kind=v.quoted(F.col("event_type")), period_start_ms=v.number(F.col("period_start_ms")))
    rows = rows.withColumn("hash", F.sha2(text, 256)).withColumn("given", F.when(F.col("event_id") % 9 == 0, F.sha2(F.concat(text, F.lit(" ")), 256)).otherwise(F.col("hash")))
    return rows.select("event_id", "hash", (F.col("given") == F.col("hash")).cast("int").alias("same"))


_PREMIUM = "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE (value - 60) / 800 END AS open, (value - 40) / 800 AS high, (value - 80) / 800 * CASE WHEN event_id % 13 = 0 THEN -1 ELSE 1 END AS low, (value - 50) / 800 AS close FROM {events}"


@query("c04_premium", duck(f"SELECT event_id, CASE WHEN open > -0.1 AND open < 0.1 AND high > -0.1 AND high < 0.1 AND low > -0.1 AND low < 0.1 AND close > -0.1 AND close < 0.1 AND NOT low > high THEN 1 ELSE 0 END AS valid FROM ({_PREMIUM}) AS p"))
def premium(spark, sf_dir):
    return run(spark, sf_dir, _PREMIUM).select("event_id", v.premium_valid().cast("int").alias("valid"))


_SHARES = "SELECT event_id, value / 100 AS l, 1 - value / 100 + CASE WHEN event_id % 7 = 0 THEN 0.002 WHEN event_id % 7 = 1 THEN 0.0005 ELSE 0.0 END AS s FROM {events}"


@query("c05_shares", duck(f"SELECT event_id, CASE WHEN l >= 0 AND l <= 1 AND s >= 0 AND s <= 1 AND l + s <= 1.001 AND l + s >= 0.999 THEN 1 ELSE 0 END AS valid FROM ({_SHARES}) AS p"))
def shares(spark, sf_dir):
    return run(spark, sf_dir, _SHARES).select("event_id", v.shares_valid("l", "s").cast("int").alias("valid"))


_FUNDING = "SELECT event_id, (value - 30) / 1000 AS rate, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN -value ELSE value END AS mark FROM {events}"


@query("c06_funding", duck(f"SELECT event_id, CASE WHEN rate < 0.05 AND rate > -0.05 AND (mark IS NULL OR mark >= 0) THEN 1 ELSE 0 END AS valid FROM ({_FUNDING}) AS p"))
def funding(spark, sf_dir):
    return run(spark, sf_dir, _FUNDING).select("event_id", v.funding_valid().cast("int").alias("valid"))


#: Hourly rows with some left out, some twice, some shifted off the grid, and takers of more than the volume.
_HOURS = f"""WITH {BARS}, r AS (SELECT instrument, t, volume, volume * 0.5 AS taker, 0 AS copy FROM bars WHERE t / 3600 % 10 <> 3),
  u AS (SELECT * FROM r UNION ALL SELECT instrument, t, volume, taker, 1 FROM r WHERE t % 25200 = 0 UNION ALL SELECT instrument, t + 60, volume, volume * 2, 0 FROM r WHERE t % 39600 = 0)"""


@query("c08_contiguity", duck(f"""{_HOURS}, s AS (SELECT instrument, min(t) - min(t) % 3600 AS a, max(t) AS b FROM u GROUP BY instrument),
  g AS (SELECT instrument, unnest(generate_series(a, b, 3600)) AS t FROM s)
  SELECT instrument, t, 'missing' AS issue, 1 AS n FROM g WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.instrument = g.instrument AND u.t = g.t)
  UNION ALL SELECT instrument, t, 'repeated', CAST(count(*) AS INTEGER) FROM u GROUP BY instrument, t HAVING count(*) > 1
  UNION ALL SELECT instrument, t, 'off the grid', CAST(count(*) AS INTEGER) FROM u WHERE t % 3600 <> 0 GROUP BY instrument, t
  UNION ALL SELECT instrument, t, 'taker over volume', CAST(count(*) AS INTEGER) FROM u WHERE taker > volume GROUP BY instrument, t"""))
def contiguity(spark, sf_dir):
    """What keeps a series from being exactly one row a step: holes, repetitions, times off the grid, more taken than traded."""
    rows = run(spark, sf_dir, f"{_HOURS} SELECT * FROM u")
    times = rows.groupBy("instrument", "t").agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_if(F.col("taker") > F.col("volume")).cast("int").alias("over"))
    grid = rows.groupBy("instrument").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    grid = grid.select("instrument", F.explode(F.expr("sequence(a - a % 3600, b, 3600L)")).alias("t"))
    missing = grid.join(times, ["instrument", "t"], "left_anti").select("instrument", "t", F.lit("missing").alias("issue"), F.lit(1).alias("n"))
    found = F.array(*[F.struct(F.lit(name).alias("issue"), n.alias("n"), test.alias("bad")) for name, n, test in (
        ("repeated", F.col("n"), F.col("n") > 1), ("off the grid", F.col("n"), F.col("t") % 3600 != 0), ("taker over volume", F.col("over"), F.col("over") > 0))])
    return missing.unionByName(times.select("instrument", "t", F.explode(found).alias("x")).where("x.bad").select("instrument", "t", "x.issue", "x.n"))


@query("c10_clean_metrics", duck("""WITH m AS (SELECT event_id, value - 20 AS oi, value * 2 * CASE WHEN event_id % 4 = 0 THEN 1.05 ELSE 1.01 END AS usd, 2.0 AS px FROM {events})
  SELECT event_id, CASE WHEN NOT oi <= 0 THEN round(oi, 6) END AS oi, CASE WHEN NOT usd <= 0 AND (NOT oi > 0 OR usd / (oi * px) BETWEEN 0.98 AND 1.02) THEN round(usd, 6) END AS usd FROM m"""))
def clean_metrics(spark, sf_dir):
    """Measures that can't be zero are missing then, and a value in money that disagrees with amount times price by over 2 %."""
    rows = run(spark, sf_dir, "SELECT event_id, value - 20 AS oi, value * 2 * CASE WHEN event_id % 4 = 0 THEN 1.05 ELSE 1.01 END AS usd, 2.0 AS px FROM {events}")
    rows = rows.withColumn("oi", v.cleaned("oi")).withColumn("usd", v.cleaned("usd"))
    off = F.abs(F.col("usd") / (F.col("oi") * F.col("px")) - 1) > 0.02
    return rows.select("event_id", F.round("oi", 6).alias("oi"), F.round(F.when(~F.coalesce(off, F.lit(False)), F.col("usd")), 6).alias("usd"))


dual("c11_decisions", "WITH e AS (SELECT event_id, @json(props, 'k') AS k, CASE WHEN event_id % 3 = 0 THEN 'true' WHEN event_id % 3 = 1 THEN 'false' END AS admitted FROM {events}) SELECT event_id FROM e WHERE CAST(k AS BIGINT) > 4 AND NOT coalesce(CAST(admitted AS BOOLEAN), false)")


@query("a02_normalise", duck("""WITH raw AS (SELECT user_id AS series, CASE WHEN event_id % 3 = 0 THEN NULL ELSE @epoch(ts) * 1000 END AS open_time, CASE WHEN event_id % 3 = 0 THEN CAST(@epoch(ts) * 1000 AS VARCHAR) END AS timestamp, CASE WHEN event_id % 17 = 0 THEN 'x' WHEN event_id % 19 = 0 THEN '-1' ELSE CAST(CAST(floor(value) AS BIGINT) + 1 AS VARCHAR) END AS close, event_id FROM {events}),
  c AS (SELECT series, coalesce(open_time, CAST(timestamp AS BIGINT)) AS t, TRY_CAST(close AS DOUBLE) AS close, event_id FROM raw),
  k AS (SELECT * FROM c WHERE close > 0 QUALIFY row_number() OVER (PARTITION BY series, t ORDER BY event_id) = 1)
  SELECT series, t, close, CAST(t - lag(t) OVER (PARTITION BY series ORDER BY t) > 86400000 AS INTEGER) AS after_gap FROM k"""))
def normalise(spark, sf_dir):
    """Times under either name, text cast to numbers, prices that aren't positive dropped, the first of equal times kept, gaps flagged."""
    rows = run(spark, sf_dir, "SELECT user_id AS series, CASE WHEN event_id % 3 = 0 THEN NULL ELSE @epoch(ts) * 1000 END AS open_time, CASE WHEN event_id % 3 = 0 THEN CAST(@epoch(ts) * 1000 AS STRING) END AS timestamp, CASE WHEN event_id % 17 = 0 THEN 'x' WHEN event_id % 19 = 0 THEN '-1' ELSE CAST(CAST(floor(value) AS BIGINT) + 1 AS STRING) END AS close, event_id FROM {events}")
    return prepare(rows, "series", 86_400_000, tie="event_id").select("series", F.col("open_time_ms").alias("t"), "close", F.col("after_gap").cast("int").alias("after_gap"))


@query("b02_first_accepted", duck("""WITH o AS (SELECT event_id, user_id, event_type, ts, floor(value / 100) AS said FROM {events}),
  f AS (SELECT *, first_value(event_id) OVER w AS kept, first_value(said) OVER w AS said0 FROM o WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
  SELECT event_id, CASE WHEN event_id = kept THEN 'observation' WHEN said <> said0 THEN 'source_revision' ELSE 'repetition' END AS part, kept FROM f"""))
def first_accepted(spark, sf_dir):
    """The first event of a key is its observation; a later one that says something else is written as an issue, with the
    observation it would revise. The first of each key is an aggregate, so that no task holds a key's rows in order."""
    rows = run(spark, sf_dir, "SELECT event_id, user_id, event_type, ts, floor(value / 100) AS said FROM {events}")
    first = rows.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id", "said")).alias("f"))
    part = F.when(F.col("event_id") == F.col("f.event_id"), "observation").when(F.col("said") != F.col("f.said"), "source_revision").otherwise("repetition")
    return rows.join(first, ["user_id", "event_type"]).select("event_id", part.alias("part"), F.col("f.event_id").alias("kept"))


@query("d06_full_outer", duck("""WITH k AS (SELECT DISTINCT user_id FROM {events} WHERE event_type IN ('click', 'purchase', 'view', 'signup')),
  c AS (SELECT user_id, event_type, count(*) AS n FROM {events} GROUP BY ALL)
  SELECT user_id, (SELECT n FROM c WHERE c.user_id = k.user_id AND event_type = 'click') AS click, (SELECT n FROM c WHERE c.user_id = k.user_id AND event_type = 'purchase') AS purchase,
    (SELECT n FROM c WHERE c.user_id = k.user_id AND event_type = 'view') AS view, (SELECT n FROM c WHERE c.user_id = k.user_id AND event_type = 'signup') AS signup FROM k"""))
def full_outer(spark, sf_dir):
    """Four sources by one key, each of which may lack it; co-partitioned by the key, so one shuffle a side."""
    events = run(spark, sf_dir, "SELECT user_id, event_type FROM {events}")
    sides = [events.where(F.col("event_type") == kind).groupBy("user_id").agg(F.count(F.lit(1)).alias(kind)) for kind in ("click", "purchase", "view", "signup")]
    out = sides[0]
    for side in sides[1:]:
        out = out.join(side, "user_id", "full")
    return out


_LAGGED = "(SELECT event_id, user_id, event_type, value, @epoch(ts) AS t FROM {events})"


#: Kinds of events as sources: seconds after which a row is known.
_SOURCES = {"view": 300, "purchase": 600, "signup": 0, "error": 900}


@query("d03_asof_lag", duck(f"""WITH e AS {_LAGGED}, l AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'click')
  SELECT l.event_id, {", ".join(f"{k}.value AS {k}_value" for k in _SOURCES)} FROM l {" ".join(f"ASOF LEFT JOIN (SELECT user_id, t + {lag} AS known, value FROM e WHERE event_type = '{k}') AS {k} ON {k}.user_id = l.user_id AND {k}.known <= l.t" for k, lag in _SOURCES.items())}"""))
def asof_lag(spark, sf_dir):
    """Four sources, each as it was known with its own delay, carried side by side through one union."""
    events = run(spark, sf_dir, f"SELECT * FROM {_LAGGED} AS e")
    sources = {k: (events.where(F.col("event_type") == k).select("user_id", "t", "value"), "t", ["value"], lag) for k, lag in _SOURCES.items()}
    left = events.where("event_type = 'click'").select("event_id", "user_id", "t")
    return asof_sources(left, sources, "t", ["user_id"], 86400).drop("user_id", "t")


_PAIR = f"WITH {BARS} SELECT instrument, t, close, volume FROM bars"


@query("d04_exact_lookup", duck(f"WITH {BARS} SELECT a.instrument, a.t, b.close AS ahead FROM bars AS a LEFT JOIN bars AS b ON b.instrument = a.instrument AND b.t = a.t + 7200"))
def exact_lookup(spark, sf_dir):
    bars = run(spark, sf_dir, _PAIR)
    return bars.select("instrument", "t").join(bars.select("instrument", (F.col("t") - 7200).alias("t"), F.col("close").alias("ahead")), ["instrument", "t"], "left")


@query("d05_grid_alignment", duck(f"""WITH {BARS}, e AS (SELECT min(t) AS a, max(t) AS b FROM bars), g AS (SELECT unnest(generate_series(a, b, 3600)) AS t FROM e)
  SELECT g.t, c.close AS clicks, v.volume AS views FROM g LEFT JOIN (SELECT * FROM bars WHERE instrument = 'click') AS c ON c.t = g.t LEFT JOIN (SELECT * FROM bars WHERE instrument = 'view') AS v ON v.t = g.t"""))
def grid_alignment(spark, sf_dir):
    """Two series on one grid without holes."""
    bars = run(spark, sf_dir, _PAIR)
    grid = bars.agg(F.min("t").alias("a"), F.max("t").alias("b")).select(F.explode(F.expr("sequence(a, b, 3600L)")).alias("t"))
    side = lambda kind, column, name: bars.where(F.col("instrument") == kind).select("t", F.col(column).alias(name))
    return grid.join(side("click", "close", "clicks"), "t", "left").join(side("view", "volume", "views"), "t", "left")


@query("d07_count_asof", duck("WITH e AS (SELECT event_id, user_id, event_type, @epoch(ts) AS t FROM {events}) SELECT l.event_id, count(r.event_id) AS n FROM e AS l LEFT JOIN e AS r ON r.user_id = l.user_id AND r.event_type = 'view' AND r.t <= l.t WHERE l.event_type = 'click' GROUP BY l.event_id"))
def count_asof(spark, sf_dir):
    """How many of one kind are known by the time of another."""
    events = run(spark, sf_dir, "SELECT event_id, user_id, event_type, @epoch(ts) AS t FROM {events} WHERE event_type IN ('click', 'view')")
    seen = F.sum(F.when(F.col("event_type") == "view", 1).otherwise(0)).over(W.partitionBy("user_id").orderBy("t").rangeBetween(W.unboundedPreceding, 0))
    return events.select("event_id", "event_type", seen.alias("n")).where("event_type = 'click'").select("event_id", "n")


@query("d13_ready", duck("SELECT user_id, CAST(bool_or(event_type = 'click') AND bool_or(event_type = 'view') AND bool_or(event_type = 'purchase') AS INTEGER) AS ready FROM {events} GROUP BY user_id"))
def ready(spark, sf_dir):
    kinds = F.collect_set("event_type")
    return run(spark, sf_dir, "SELECT user_id, event_type FROM {events}").groupBy("user_id").agg(F.forall(F.array(*map(F.lit, ("click", "view", "purchase"))), lambda k: F.array_contains(kinds, k)).cast("int").alias("ready"))


@query("d18_missing_days", duck("WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM {orders} WHERE o_orderkey % 5 = 0), g AS (SELECT CAST(unnest(generate_series((SELECT min(d) FROM d), (SELECT max(d) FROM d), INTERVAL 1 DAY)) AS DATE) AS d) SELECT CAST(d - DATE '1970-01-01' AS BIGINT) AS day FROM g WHERE d NOT IN (SELECT d FROM d)"))
def missing_days(spark, sf_dir):
    days = run(spark, sf_dir, "SELECT DISTINCT unix_date(CAST(o_orderdate AS DATE)) AS day FROM {orders} WHERE o_orderkey % 5 = 0")
    grid = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return grid.join(days, "day", "left_anti").select(F.col("day").cast("long").alias("day"))


@query("a05_known_time", duck("SELECT event_id, @epoch(ts) * 1000 + CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 300000 END AS known_ms FROM {events}"))
def known_time(spark, sf_dir):
    """Some sources stamp a period's end, when it is known; others its start."""
    return run(spark, sf_dir, "SELECT event_id, event_type, @epoch(ts) * 1000 AS ms FROM {events}").select("event_id", known_ms("ms", "event_type", ("click", "view"), 300_000).alias("known_ms"))


dual("a06_funding_gaps", "WITH e AS (SELECT user_id, @epoch(ts) AS t FROM {events}), d AS (SELECT DISTINCT user_id, t FROM e), g AS (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM d) SELECT user_id, t, gap FROM g WHERE gap > 32400")


@query("a13_fill_gaps", duck(f"""WITH {BARS}, have AS (SELECT instrument, t, close, 1 AS first FROM bars WHERE t / 3600 % 7 <> 2), more AS (SELECT instrument, t, close * 2 AS close FROM bars)
  SELECT instrument, t, close, 'kept' AS origin FROM have UNION ALL SELECT m.instrument, m.t, m.close, 'filled' FROM more AS m LEFT JOIN have AS h ON h.instrument = m.instrument AND h.t = m.t WHERE h.t IS NULL"""))
def fill_gaps(spark, sf_dir):
    bars = run(spark, sf_dir, _PAIR).drop("volume")
    return fill(bars.where("t DIV 3600 % 7 <> 2"), bars.withColumn("close", F.col("close") * 2), ["instrument", "t"])


_TWO = f"""SELECT event_type AS instrument, CAST(floor(t / %d) AS BIGINT) * %d AS t, min_by(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, max_by(value, (ts, event_id)) AS close
  FROM (SELECT *, @epoch(ts) AS t FROM {{events}}) AS e GROUP BY event_type, CAST(floor(t / %d) AS BIGINT) * %d"""
_COARSE, _FINE = (f"SELECT * FROM ({_TWO % (k, k, k, k)}) AS z WHERE {hole}" for k, hole in ((18_000, "t / 18000 <> 90 OR instrument <> 'click'"), (3600, "t / 3600 % 17 <> 4")))


@query("a14_fill_bars", duck(f"""WITH c AS ({_COARSE.replace("t / 18000", "t // 18000")}), f AS ({_FINE.replace("t / 3600", "t // 3600").replace("floor(t // 3600)", "floor(t / 3600)")}), n AS (SELECT *, t - min(t) OVER (PARTITION BY instrument) - 18000 * (row_number() OVER (PARTITION BY instrument ORDER BY t) - 1) AS off FROM c),
  k AS (SELECT *, (SELECT count(*) FROM f WHERE f.instrument = n.instrument AND f.t >= n.t AND f.t < n.t + 18000) AS fine FROM n WHERE off = 0)
  SELECT instrument, t, t + 18000 AS end, open, high, low, close FROM k WHERE fine < 5 UNION ALL SELECT f.instrument, f.t, f.t + 3600, f.open, f.high, f.low, f.close FROM f JOIN k ON k.instrument = f.instrument AND f.t >= k.t AND f.t < k.t + 18000 AND fine = 5"""))
def fill_bars_of(spark, sf_dir):
    """Five-hour bars, by their hours where all five are there, up to each instrument's first hole."""
    coarse, fine = run(spark, sf_dir, _COARSE.replace("t / 18000 <>", "t DIV 18000 <>")), run(spark, sf_dir, _FINE.replace("t / 3600 %", "t DIV 3600 %"))
    return fill_bars(coarse, fine, "instrument", 18_000, 3600)


# --- positioning: each kind of event is an endpoint, hours are bars, users are dealt over four series

_HOUR, _CUTOVER, _PRICE = 3_600_000, 1_705_492_800_000, 5000
_POSITIONS = """SELECT event_id AS seq, event_type, user_id % 4 AS series, CAST(floor(@epoch(ts) / 3600) AS BIGINT) * 3600000 + CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END AS ms,
  CASE WHEN event_id % 11 = 0 THEN -1 ELSE CAST(floor(value) AS BIGINT) + 1 END AS v, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 1000 END AS p, 5000 + 55 * (event_id % 5) AS rate FROM {events}"""
_GRID = "SELECT series, open_time_ms, CAST(CASE WHEN open_time_ms / 3600000 % 10 = 0 THEN NULL ELSE 5000 END AS DOUBLE) AS price FROM (SELECT DISTINCT user_id % 4 AS series, CAST(floor(@epoch(ts) / 3600) AS BIGINT) * 3600000 AS open_time_ms FROM {events}) AS g"


def _said(kind: str, **values: str) -> str:
    """The last record of each bar of one endpoint."""
    columns = ", ".join(f"{v} AS {c}" for c, v in values.items())
    return f"(SELECT series, ms, {columns} FROM e WHERE event_type = '{kind}' QUALIFY row_number() OVER (PARTITION BY series, ms ORDER BY seq DESC) = 1)"


def _nearest(table: str, columns: list[str], age: str) -> str:
    """For each bar the row of table that is nearest before it, three bars at most."""
    return f"""SELECT g.series, g.open_time_ms, (g.open_time_ms - s.open_time_ms) // {_HOUR} AS {age}, {", ".join(f"s.{c}" for c in columns)} FROM g JOIN {table} AS s
      ON s.series = g.series AND s.open_time_ms BETWEEN g.open_time_ms - {3 * _HOUR} AND g.open_time_ms QUALIFY row_number() OVER (PARTITION BY g.series, g.open_time_ms ORDER BY s.open_time_ms DESC) = 1"""


_LATER = ", ".join(f"(SELECT z.{c} FROM zeroed AS z WHERE z.series = w.series AND z.{c} IS NOT NULL AND z.open_time_ms BETWEEN w.open_time_ms - {3 * _HOUR} AND w.open_time_ms ORDER BY z.open_time_ms DESC LIMIT 1) AS prem_{c}" for c in PREMIUM)


@query("a15_positioning_table", duck(f"""WITH g AS ({_GRID.replace("/ 3600000 %", "// 3600000 %")}), e AS ({_POSITIONS}),
  j AS (SELECT * FROM {_said("click", oi="CAST(v AS DOUBLE)", oi_usd="CAST(v * rate AS DOUBLE)")} AS a FULL JOIN {_said("view", top_acct_ls="CAST(v AS DOUBLE)")} AS b USING (series, ms)
        FULL JOIN {_said("purchase", top_pos_ls="CAST(v AS DOUBLE)")} AS c USING (series, ms) FULL JOIN {_said("signup", acct_ls="CAST(v AS DOUBLE)")} AS d USING (series, ms)),
  o AS (SELECT j.*, CASE WHEN ms < {_CUTOVER} THEN ms - {_HOUR} ELSE ms END AS open_time_ms FROM j),
  owned AS (SELECT o.* FROM o SEMI JOIN g USING (series, open_time_ms) QUALIFY row_number() OVER (PARTITION BY o.series, o.open_time_ms ORDER BY ms DESC) = 1),
  m AS ({_nearest("owned", list(MEASURES), "m_age_bars")}),
  real AS (SELECT r.* FROM (SELECT series, ms AS open_time_ms, * EXCLUDE (series, ms) FROM {_said("error", **{c: f"CAST(CASE WHEN seq % {k + 4} = 0 THEN 0 ELSE p + {k} * sign(p) END AS DOUBLE)" for k, c in enumerate(PREMIUM)})} AS x) AS r SEMI JOIN g USING (series, open_time_ms)),
  w AS ({_nearest("real", list(PREMIUM), "p_age_bars")}), zeroed AS (SELECT series, open_time_ms, {", ".join(f"nullif({c}, 0) AS {c}" for c in PREMIUM)} FROM w),
  p AS (SELECT w.series, w.open_time_ms, p_age_bars, 1.0 AS prem_samples, {_LATER} FROM w)
  SELECT *, CAST(oi IS NOT NULL AS INTEGER) AS m_ok, CAST(prem_close IS NOT NULL AS INTEGER) AS p_ok, CAST(top_pos_ls IS NOT NULL AS INTEGER) AS top_ok, CAST(acct_ls IS NOT NULL AS INTEGER) AS acct_ok FROM (
    SELECT g.series, g.open_time_ms, CASE WHEN oi > 0 THEN oi END AS oi, CASE WHEN oi_usd > 0 AND NOT coalesce(oi > 0 AND abs(oi_usd / (oi * price) - 1) > 0.02, false) THEN oi_usd END AS oi_usd,
      {", ".join(f"CASE WHEN {c} > 0 THEN {c} END AS {c}" for c in MEASURES[2:])}, {", ".join(f"prem_{c}" for c in PREMIUM)}, prem_samples, m_age_bars, p_age_bars
    FROM g LEFT JOIN m USING (series, open_time_ms) LEFT JOIN p USING (series, open_time_ms)) AS t"""))
def positioning_table(spark, sf_dir):
    """Replies of four endpoints as JSON objects and premium bars as JSON arrays, on the bars that each series has."""
    rows = run(spark, sf_dir, _POSITIONS)
    endpoint = F.create_map(*[F.lit(x) for pair in (("click", "oi"), ("view", "top_acct"), ("purchase", "top_pos"), ("signup", "acct")) for x in pair])[F.col("event_type")]
    text = F.col("v").cast("string")
    raw = F.when(endpoint == "oi", F.to_json(F.struct(F.col("ms").alias("timestamp"), text.alias("sumOpenInterest"), (F.col("v") * F.col("rate")).alias("sumOpenInterestValue")))).otherwise(F.to_json(F.struct(F.col("ms").alias("timestamp"), text.alias("longShortRatio"))))
    measures = reply_measures(rows.select("series", endpoint.alias("endpoint"), raw.alias("raw"), "seq"), "series")
    prices = [F.when(F.col("seq") % (k + 4) == 0, 0).otherwise(F.col("p") + k * F.signum("p")).cast("long").cast("string") for k in range(4)]
    premium = reply_premium(rows.where("event_type = 'error'").select("series", F.to_json(F.array(F.col("ms").cast("string"), *prices)).alias("raw"), "seq"), "series")
    return positioning(measures, premium, run(spark, sf_dir, _GRID.replace("open_time_ms / 3600000 %", "open_time_ms DIV 3600000 %")), "series", _HOUR, _CUTOVER)


# --- envelopes of all kinds of events; some by their number with a fault of each sort

_WIRE = """SELECT event_id, event_type, s, floor(value) + 2 AS v, event_id % 9 + 1 AS d, event_id % 10 AS bad, CASE WHEN event_id % 10 = 7 THEN 'test' ELSE 'live' END AS mode, CASE WHEN event_id % 10 = 8 THEN s - 3600000 ELSE s + 7200000 END AS received_at_ms
  FROM (SELECT event_id, event_type, value, CAST(floor(@epoch(ts) / 3600) AS BIGINT) * 3600000 AS s FROM {events}) AS e"""
_KINDS = {"click": "candle", "view": "premium", "purchase": "ratio", "signup": "taker", "error": "funding"}


@query("c01_envelopes", duck(f"""WITH w AS (SELECT * REPLACE (CAST(v AS BIGINT) AS v) FROM ({_WIRE})), k AS (SELECT *,
    CASE event_type {" ".join(f"WHEN '{e}' THEN '{k}'" for e, k in _KINDS.items())} END AS kind, CASE event_type WHEN 'purchase' THEN s WHEN 'error' THEN s - 3600000 ELSE s END AS period_start_ms,
    CASE event_type
      WHEN 'click' THEN printf('@"close":"%d","high":"%d","low":"%d","open":"%d.5","quote_volume":"9","taker_buy_base":"4","taker_buy_quote":"2.25","trade_count":3,"volume":"5"~', v + 1, v + 2, CASE WHEN bad = 1 THEN v + 1 ELSE v - 1 END, v)
      WHEN 'view' THEN printf('@"close":"0","high":"%s","low":"-0.0%d","open":"0.0%d","source_timestamp_ms":%d~', CASE WHEN bad = 3 THEN '0.1' ELSE '0.099' END, d, d, s)
      WHEN 'purchase' THEN printf('@"longAccount":"0.%d","longShortRatio":"%d","shortAccount":"%s","source_timestamp_ms":%d~', d, v, CASE WHEN bad = 4 THEN '1.5' ELSE printf('0.%d', 10 - d) END, s + 3600000)
      WHEN 'signup' THEN printf('@"buySellRatio":"1","buyVol":"%d","sellVol":"%d","source_timestamp_ms":%d~', v, CASE WHEN bad = 5 THEN -v ELSE v END, s)
      ELSE printf('@"fundingRate":"-0.0%d","markPrice":"%d","source_timestamp_ms":%d~', CASE WHEN bad = 6 THEN 7 ELSE d % 4 + 1 END, CASE WHEN event_id % 2 = 0 THEN 0 ELSE v END, s + 4) END AS made FROM w),
  j AS (SELECT *, replace(replace(made, '@', chr(123)), '~', chr(125)) AS data FROM k)
  SELECT event_id, kind, period_start_ms, period_start_ms + 3600000 AS period_end_ms, data, sha256('["venue:pair","' || kind || '","1h",' || period_start_ms || ',' || data || ']') AS id,
    CASE WHEN bad = 2 AND kind = 'candle' THEN 'close' WHEN bad = 7 OR received_at_ms < period_start_ms + 3600000 THEN 'envelope'
      WHEN (kind, bad) IN (('candle', 1), ('premium', 3), ('ratio', 4), ('taker', 5), ('funding', 6)) THEN 'value' END AS issue FROM j"""))
def envelopes_of_all_kinds(spark, sf_dir):
    """Bars as JSON arrays, measures as JSON objects, of an hour each."""
    rows = run(spark, sf_dir, _WIRE).withColumn("v", F.col("v").cast("long"))
    v, d, bad = F.col("v"), F.col("d"), F.col("bad")
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    end = F.col("s") + F.when(bad == 2, 3_600_000).otherwise(3_599_999)
    hour = F.col("s").cast("string")
    candle = [hour, text(v, ".50"), text(v + 2), text(F.when(bad == 1, v + 1).otherwise(v - 1), ".00"), text(v + 1), F.lit("5"), end.cast("string"), F.lit("9.0"), F.lit("3"), F.lit("4"), F.lit("2.250")]
    premium = [hour, text("0.0", d, "0"), F.when(bad == 3, "0.1").otherwise("0.099"), text("-0.0", d), F.lit("0.00"), F.lit("0"), text(F.col("s") + 3_599_999)]
    objects = {
        "ratio": {"timestamp": F.col("s") + 3_600_000, "longShortRatio": text(v), "longAccount": text("0.", d), "shortAccount": F.when(bad == 4, "1.5").otherwise(text("0.", 10 - d))},
        "taker": {"timestamp": F.col("s"), "buySellRatio": F.lit("1.0"), "buyVol": text(v), "sellVol": text(F.when(bad == 5, -v).otherwise(v))},
        "funding": {"fundingTime": F.col("s") + 4, "fundingRate": text("-0.0", F.when(bad == 6, 7).otherwise(d % 4 + 1), "00"), "markPrice": F.when(F.col("event_id") % 2 == 1, text(v))},
    }
    kind = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])[F.col("event_type")]
    raw = F.when(kind == "candle", F.to_json(F.array(*candle))).when(kind == "premium", F.to_json(F.array(*premium)))
    for name, fields in objects.items():
        raw = raw.when(kind == name, F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])))
    sent = rows.select("event_id", kind.alias("kind"), F.lit("1h").alias("timeframe"), raw.alias("raw"), F.lit("rest").alias("source"), "mode", "received_at_ms")
    made = enveloped(sent.withColumnRenamed("event_id", "number"), "venue:pair", F.lit(_NOW))
    return made.select(F.col("number").alias("event_id"), "kind", "period_start_ms", "period_end_ms", "data", F.col("event_id").alias("id"), "issue")
