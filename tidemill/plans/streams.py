"""Streaming queries (B02, J08, K01 to K03, K06, K08, K09, K11): each drains the event stream once and returns what its sink holds.

A stream emits a window when the watermark has passed its end; the windows after the last watermark stay open and are in no
result. All files of a table are one batch, however many they are and in whatever order, so none of their rows is late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemill.operators.simulate import Rules
from tidemill.plans.dual import duck, run
from tidemill.plans.service import _ARRIVALS
from tidemill.plans.trading import _NUMBERED, _SIGNALS, _simulation_sql
from tidemill.registry import SQL, query
from tidemill.sources.files import stream_table
from tidemill.streaming.book import Terms, live_book
from tidemill.streaming.executor import execute
from tidemill.streaming import timers
from tidemill.streaming.sinks import drain, drain_idempotent, drain_routes, table_in_order

LATENESS = "1 hour"
CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def _events(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None) -> DataFrame:
    return stream_table(spark, sf_dir, "events", files_per_batch).withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs an instant


@query(
    "k02_event_time_bars",
    f"""SELECT event_type, CAST(floor(epoch(date_trunc('hour', ts))) AS BIGINT) AS t, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
        last(value ORDER BY ts, event_id) AS close, count(*) AS ticks
        FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= {CLOSED} GROUP BY event_type, date_trunc('hour', ts)""",
)
def event_time_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each event type by event time; only closed bars."""
    order = F.struct("ts", "event_id")
    bars = _events(spark, sf_dir).withWatermark("ts", LATENESS).groupBy(F.window("ts", "1 hour"), "event_type").agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count(F.lit(1)).alias("ticks"),
    )
    return drain(bars.select("event_type", F.unix_timestamp("window.start").alias("t"), "open", "high", "low", "close", "ticks"), "bars")


@query(
    "k08_session_groups",
    f"""WITH e AS (SELECT event_type, event_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e)
        SELECT event_type, CAST(epoch_us(min(ts)) AS BIGINT) AS first, CAST(epoch_us(max(ts)) AS BIGINT) AS last, count(*) AS n
        FROM s GROUP BY event_type, session HAVING max(ts) + INTERVAL 10 MINUTE <= {CLOSED}""",
)
def session_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases of one kind no more than ten minutes after another belong together; only closed groups."""
    groups = _events(spark, sf_dir).withWatermark("ts", LATENESS).groupBy(F.session_window("ts", "10 minutes"), "event_type")
    found = groups.agg(F.min("ts").alias("low"), F.max("ts").alias("high"), F.count(F.lit(1)).alias("n"))
    return drain(found.select("event_type", F.unix_micros("low").alias("first"), F.unix_micros("high").alias("last"), "n"), "sessions")


@query("k06_first_accepted_stream", "SELECT DISTINCT user_id, event_type FROM events")
def first_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation of each key is accepted. State has a row for each key and never expires, so a key is accepted once
    whatever the time between its rows."""
    events = _events(spark, sf_dir).select("user_id", "event_type")
    return drain(events.dropDuplicates(["user_id", "event_type"]), "accepted")


@query(
    "k01_idempotent_batches",
    """SELECT event_id, CASE WHEN value > 0 AND value < 400 THEN 'observation' ELSE 'issue' END AS route FROM events""",
)
def idempotent_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid rows go to the observations and all others, nulls too, to the issues; a batch run twice counts once."""
    valid = F.coalesce((F.col("value") > 0) & (F.col("value") < 400), F.lit(False))
    routes = {"observation": lambda rows: rows.where(valid).select("event_id"), "issue": lambda rows: rows.where(~valid).select("event_id")}
    tables = drain_idempotent(_events(spark, sf_dir, files_per_batch=1), "batches", routes)
    return tables["observation"].withColumn("route", F.lit("observation")).unionByName(tables["issue"].withColumn("route", F.lit("issue")))


_EXECUTOR = Rules(hold=9)
_BOOK_BARS = f"""WITH {_NUMBERED} SELECT instrument, i, open, high, low, close, CASE WHEN close > open THEN 1 ELSE -1 END AS side, 0.2 + t / 3600 % 6 / 10.0 AS b FROM x"""


@query("j08_live_executor", f"SELECT instrument, id, entry_at, entry, exit_at, exit, kind FROM ({_simulation_sql(_EXECUTOR)}) WHERE kind <> 'CUT'")
def live_executor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades closed by a stream of bars, in batches of a few days each: the same as those of the batch simulator."""
    bars = run(spark, sf_dir, _BOOK_BARS)
    place = table_in_order(bars, "i", 200, "bars")
    stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(place)
    closed = drain(execute(stream, _EXECUTOR), "trades")
    return closed.withColumn("entry", F.round("entry", 6)).withColumn("exit", F.round("exit", 6))


def _book_sql(terms: Terms) -> str:
    """The same by whole trades: each signal's trade on its own, then admission and the account by recursion over them."""
    end = 1 << 40
    return f"""WITH RECURSIVE {duck(_NUMBERED)}, trade AS ({_simulation_sql(terms.rules, digits=12)}),
      h AS (SELECT s.instrument, s.id, s.start - 1 AS signal, row_number() OVER (PARTITION BY s.instrument ORDER BY s.start) AS k, CASE WHEN kind <> 'CUT' THEN exit_at ELSE {end} END AS leave FROM ({_SIGNALS}) AS s LEFT JOIN trade USING (instrument, id)),
      a AS (SELECT instrument, id, k, 'ok' AS why, [coalesce(leave, {end})] AS held, signal AS entered FROM h WHERE k = 1 UNION ALL
        SELECT instrument, id, k, why, CASE WHEN why = 'ok' THEN list_append(held, leave) ELSE held END, CASE WHEN why = 'ok' THEN signal ELSE entered END FROM (
          SELECT *, CASE WHEN len(held) >= {terms.cap} THEN 'max_positions' WHEN signal - entered < {terms.gap} THEN 'min_gap' ELSE 'ok' END AS why FROM (
            SELECT h.instrument, h.id, h.k, h.signal, coalesce(h.leave, {end}) AS leave, a.entered, list_filter(a.held, lambda x: x >= h.signal) AS held FROM a JOIN h ON h.instrument = a.instrument AND h.k = a.k + 1) AS u) AS v),
      d AS (SELECT trade.*, CASE WHEN kind = 'CUT' THEN {end} ELSE exit_at END AS leave, CASE WHEN entry_at = exit_at THEN 1 ELSE 0 END AS late FROM a JOIN trade USING (instrument, id) WHERE why = 'ok'),
      n AS (SELECT d.instrument, d.id, count(o.id) AS n FROM d LEFT JOIN d AS o ON o.instrument = d.instrument AND o.kind <> 'CUT' AND (o.leave, o.late, o.id) < (d.entry_at, 1, d.id) GROUP BY d.instrument, d.id),
      c AS (SELECT d.instrument, d.id, r_net, n, row_number() OVER (PARTITION BY d.instrument ORDER BY leave, late, d.id) AS k FROM d JOIN n USING (instrument, id) WHERE kind <> 'CUT'),
      v AS (SELECT instrument, id, k, [{terms.equity}, {terms.equity} * (1 + {terms.share} * r_net)] AS v FROM c WHERE k = 1 UNION ALL
        SELECT c.instrument, c.id, c.k, list_append(v.v, v.v[c.k] + {terms.share} * v.v[c.n + 1] * c.r_net) FROM v JOIN c ON c.instrument = v.instrument AND c.k = v.k + 1),
      whole AS (SELECT instrument, max_by(v, k) AS v FROM v GROUP BY instrument)
      SELECT instrument, id, 'skipped' AS event, id // 10 AS at, why AS kind, NULL AS price, NULL AS maker, NULL AS r, NULL AS r_net, NULL AS equity FROM a WHERE why <> 'ok'
      UNION ALL SELECT instrument, id, 'filled', entry_at, NULL, round(entry, 6), maker, NULL, NULL, round(coalesce(whole.v[n + 1], {terms.equity}), 6) FROM d JOIN n USING (instrument, id) LEFT JOIN whole USING (instrument)
      UNION ALL SELECT instrument, id, 'closed', exit_at, kind, round(exit, 6), maker, round(r, 6), round(d.r_net, 6), round(v.v[len(v.v)], 6) FROM d JOIN v USING (instrument, id)"""


def _live_book(name: str, terms: Terms) -> None:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = run(spark, sf_dir, _BOOK_BARS)
        stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(table_in_order(bars, "i", 200, "bars"))
        with timers.timer_store(spark):
            events = drain(live_book(stream, terms), "book")
        return events.select("instrument", "id", "event", "at", "kind", "maker", *[F.round(c, 6).alias(c) for c in ("price", "r", "r_net", "equity")])

    query(name, _book_sql(terms))(build)


_live_book("j08_live_book", Terms(Rules(hold=9, maker=0.0002, taker=0.0005), cap=3, gap=2))
_live_book("j08_live_pullback", Terms(Rules(tp=1.2, hold=9, pullback=0.3, wait=3, through=0.0001, maker=0.0002, taker=0.0005), cap=4, gap=1))


#: Seconds of time that a file of a timed stream holds.
FILE = 700_000


def _in_order(spark: SparkSession, rows: DataFrame, time: str, name: str) -> DataFrame:
    """rows as a stream of files in order of time, and after them one row without a key, by which all timers are over."""
    last = rows.agg((F.max(time) + 10 * FILE).alias(time)).select(*[F.col(time) if c == time else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])
    place = table_in_order(rows.unionByName(last), time, FILE, name)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(place)


@query("k03_readiness_stream", SQL["k03_readiness"])
def readiness_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same decisions as k03_readiness, by timers: what never arrives is missing after six hours of silence."""
    arrivals = run(spark, sf_dir, _ARRIVALS.replace("t / 3600", "t DIV 3600")).selectExpr("hour + 3600 AS end", "kind", "known")
    with timers.timer_store(spark):
        found = drain(timers.readiness(_in_order(spark, arrivals, "known", "arrivals"), 5), "readiness")
    return found.select((F.col("end") - 3600).alias("hour"), "state", "decided")


LIMIT = 1500


@query("k09_silence_alerts", duck(f"""WITH e AS (SELECT event_type AS key, @epoch(ts) AS t, event_id FROM {{events}}), g AS (SELECT key, t, lag(t) OVER w AS before, lead(t) OVER w AS after FROM e WINDOW w AS (PARTITION BY key ORDER BY t, event_id))
  SELECT key, t + {LIMIT} AS t, 'silent' AS edge FROM g WHERE after IS NULL OR after - t > {LIMIT} UNION ALL SELECT key, t, 'back' FROM g WHERE t - before > {LIMIT}"""))
def silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alert when a source has been silent for 25 minutes, and its end, each once."""
    beats = run(spark, sf_dir, "SELECT event_type AS key, @epoch(ts) AS t FROM {events}")
    with timers.timer_store(spark):
        return drain(timers.silence_alerts(_in_order(spark, beats, "t", "beats"), LIMIT), "silence")


@query("k11_pending_stream", SQL["k11_pending_cancelled"])
def pending_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as k11_pending_cancelled, by timers: an order that no bar comes for is cancelled by the clock."""
    rows = run(spark, sf_dir, "SELECT user_id AS key, @epoch(ts) AS t, CASE WHEN event_type = 'purchase' THEN event_id END AS id FROM {events} WHERE event_type IN ('purchase', 'view')")
    with timers.timer_store(spark):
        return drain(timers.pending_orders(_in_order(spark, rows, "t", "orders")), "pending").withColumnRenamed("id", "event_id")


@query("b02_revisions_stream", duck("""WITH o AS (SELECT concat(user_id % 100, '/', event_type) AS key, event_id AS id, round(value / 50) AS value, @epoch(ts) AS t FROM {events}),
  n AS (SELECT *, row_number() OVER w AS k, first_value(value) OVER w AS had FROM o WINDOW w AS (PARTITION BY key ORDER BY t, id))
  SELECT key, id, value, CASE WHEN k = 1 THEN 'accepted' ELSE 'revision' END AS route FROM n WHERE k = 1 OR value <> had"""))
def revisions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first observation of a key is accepted and stays; later ones that say something else are its revisions. Both come from
    one state and one batch."""
    rows = run(spark, sf_dir, "SELECT concat(user_id % 100, '/', event_type) AS key, @epoch(ts) AS t, event_id AS id, round(value / 50) AS value FROM {events}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(table_in_order(rows, "t", FILE, "observations"))
    with timers.timer_store(spark):
        return drain_routes(timers.first_accepted(stream), "revisions")
