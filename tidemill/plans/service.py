"""Writers, outbox, readiness and upkeep."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from tidemill.functions import validation as v
from tidemill.operators import books, folds
from tidemill.operators.joins import asof_join
from tidemill.plans.dual import BARS, duck, dual, run
from tidemill.plans.reports import CURVE, TRADES
from tidemill.registry import query
from tidemill.streaming.sinks import write_months
from tidemill.streaming.tables import insert_new, publish, upsert

_EVENTS = "SELECT event_id, user_id, event_type, @epoch(ts) AS t, value FROM {events}"


@query("b01_insert_returning", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS inserted_by FROM events")
def insert_returning(spark, sf_dir):
    """Three deliveries, the second of which repeats most of the first and the third all: each row is inserted once."""
    events = run(spark, sf_dir, _EVENTS)
    deliveries = [events.where("event_id % 3 <> 0"), events.where("event_id % 5 <> 1 OR event_id % 3 = 0").unionByName(events.where("event_id % 3 = 0")), events]
    out = events.limit(0).withColumn("inserted_by", F.lit(0))
    for k, batch in enumerate(deliveries, 1):
        out = out.unionByName(insert_new(out, batch, ["event_id"], ["t"]).withColumn("inserted_by", F.lit(k)))
    return out.select("event_id", "inserted_by")


@query("b03_outbox", "SELECT CASE WHEN event_type = 'purchase' THEN 'open:' ELSE 'note:' END || CAST(user_id AS VARCHAR) AS dedup_key, min(event_id) AS event_id FROM events GROUP BY 1")
def outbox(spark, sf_dir):
    """A message of each key, however often it is asked for."""
    events = run(spark, sf_dir, _EVENTS).withColumn("dedup_key", F.concat(F.when(F.col("event_type") == "purchase", "open:").otherwise("note:"), F.col("user_id").cast("string")))
    first = insert_new(events.limit(0), events, ["dedup_key"], ["event_id"])
    again = insert_new(first, events, ["dedup_key"], [F.desc("event_id")])
    return first.unionByName(again).select("dedup_key", "event_id")


@query("b04_publish", "SELECT event_id, CASE WHEN k <= 100 THEN 1 WHEN k <= 200 THEN 2 END AS run FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k FROM events WHERE value > 30) WHERE k <= 200")
def publish_oldest(spark, sf_dir):
    """Two runs of a publisher, each of the hundred oldest that are not sent."""
    box = run(spark, sf_dir, "SELECT event_id, CAST(NULL AS INT) AS run FROM {events} WHERE value > 30")
    for k in (1, 2):
        _, box = publish(box, "event_id", "run", 100, F.lit(k))
    return box.where("run IS NOT NULL")


@query("b06_heartbeats", "SELECT user_id, max(floor(epoch(ts)))::BIGINT AS t, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY user_id")
def heartbeats(spark, sf_dir):
    """The last sign of each service, whatever order signs come in."""
    events = run(spark, sf_dir, "SELECT user_id, @epoch(ts) AS t, ts, event_id, event_type AS state FROM {events}")
    newest = F.struct("ts", "event_id")
    table = upsert(events.limit(0), events.where("event_id % 2 = 0"), ["user_id"], newest)
    return upsert(table, events.where("event_id % 2 = 1"), ["user_id"], newest).select("user_id", "t", "state")


dual("b07_offsets", "SELECT event_type AS topic, user_id % 4 AS part, max(event_id) AS last_offset, count(*) AS n FROM {events} GROUP BY event_type, user_id % 4")


@query("b09_month_files", duck("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, CAST(bit_xor(CAST(o_orderkey AS BIGINT)) AS BIGINT) AS checksum FROM {orders} GROUP BY 1 UNION ALL SELECT 'total', count(*), min(o_orderkey), max(o_orderkey), CAST(bit_xor(CAST(o_orderkey AS BIGINT)) AS BIGINT) FROM {orders}"))
def month_files(spark, sf_dir):
    """CSV files by month, and a manifest of what was read back from them, with a total."""
    orders = run(spark, sf_dir, "SELECT o_orderkey, o_orderdate, o_totalprice FROM {orders}")
    place = write_months(orders, "o_orderdate", ["o_orderdate", "o_orderkey"], "months")
    files = spark.read.option("header", True).schema("o_orderkey long, o_orderdate string, o_totalprice double, month string").csv(place)
    return files.rollup("month").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"), F.bit_xor("o_orderkey").alias("checksum")).withColumn("month", F.coalesce("month", F.lit("total")))


@query("b10_export", duck(f"WITH {TRADES} SELECT y, count(*) AS n, round(sum(r), 3) AS r FROM trades GROUP BY y"))
def export(spark, sf_dir):
    """Trades as JSON lines by month, and the yearly report of what was read back."""
    trades = run(spark, sf_dir, f"WITH {TRADES} SELECT id, d, y, r FROM trades")
    place = write_months(trades, "d", ["d", "id"], "export", "json")
    back = spark.read.schema("id long, y int, r double").json(place)
    return back.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("r"), 3).alias("r"))


dual("b11_status", "SELECT 'events' AS what, count(*) AS n FROM {events} UNION ALL SELECT 'orders', count(*) FROM {orders} UNION ALL SELECT 'open', count(*) FROM {orders} WHERE o_orderstatus = 'O' UNION ALL SELECT 'documents', count(*) FROM {documents}")


@query("b13_messages", """SELECT event_id, event_type || ':' || CAST(user_id AS VARCHAR) AS key, sha256('{"kind":"' || event_type || '","t":' || CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) || ',"user":' || CAST(user_id AS VARCHAR) || '}') AS h FROM events""")
def messages(spark, sf_dir):
    """Key and canonical value of each message."""
    value = v.canonical(user=v.number(F.col("user_id")), kind=v.quoted(F.col("event_type")), t=v.number(F.col("t")))
    return run(spark, sf_dir, _EVENTS).select("event_id", F.concat_ws(":", "event_type", "user_id").alias("key"), F.sha2(value, 256).alias("h"))


@query("c01_envelope_build", duck("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'array' ELSE 'object' END AS made_from, @epoch(ts) * 1000 AS period_start_ms, @epoch(ts) * 1000 + 300000 AS period_end_ms, CAST(floor(value) AS BIGINT) AS open, CAST(floor(value) AS BIGINT) + 1 AS high FROM {events}"))
def envelope_build(spark, sf_dir):
    """Fields of an event by place or by name, whichever its source gives."""
    rows = run(spark, sf_dir, "SELECT event_id, @epoch(ts) * 1000 AS t, CAST(floor(value) AS BIGINT) AS o FROM {events}")
    text = [F.col("t").cast("string"), F.col("o").cast("string"), (F.col("o") + 1).cast("string")]
    raw = rows.select("event_id", F.when(F.col("event_id") % 2 == 0, F.to_json(F.array(*text))).otherwise(F.to_json(F.struct("t", text[1].alias("o"), (F.col("o") + 1).alias("h")))).alias("raw"))
    field = lambda k, name: F.coalesce(F.get_json_object("raw", f"$[{k}]"), F.get_json_object("raw", f"$.{name}")).try_cast("long")
    start = field(0, "t")
    return raw.select("event_id", F.when(F.col("raw").startswith("["), "array").otherwise("object").alias("made_from"), start.alias("period_start_ms"), (start + 300_000).alias("period_end_ms"), field(1, "o").alias("open"), field(2, "h").alias("high"))


dual("c09_projections", "SELECT event_id, round(value / 490.02 * 10000, 4) AS bps, round(ln(1 + value), 6) AS logged, round(least(greatest(value - 50, -20.0), 20.0), 6) AS clipped FROM {events}")

# --- readiness, catch-up and upkeep

#: When each kind's hour became known: two minutes after it ended, a kind in nine an hour late, one in thirteen never.
_ARRIVALS = f"WITH {BARS} SELECT t AS hour, instrument AS kind, t + 3600 + CASE WHEN (t / 3600 + ticks) % 9 = 0 THEN 3600 ELSE 120 END AS known FROM bars WHERE (t / 3600 + ticks) % 13 <> 0"


@query("k03_readiness", duck(f"""WITH a AS ({_ARRIVALS.replace("t / 3600", "t // 3600")}), h AS (SELECT DISTINCT hour FROM a), g AS (SELECT h.hour, count(DISTINCT kind) AS kinds, count(DISTINCT kind) FILTER (WHERE known <= h.hour + 4200) AS soon, max(known) AS last FROM h JOIN a USING (hour) GROUP BY h.hour)
  SELECT hour, CASE WHEN soon = 5 THEN 'ready' WHEN kinds = 5 THEN 'late' ELSE 'missing' END AS state, CASE WHEN soon = 5 THEN last WHEN kinds = 5 THEN hour + 4200 ELSE hour + 25200 END AS decided FROM g"""))
def readiness(spark, sf_dir):
    """An hour is decided when all five kinds are there; ten minutes after its end with what is there, if the rest comes later;
    after six hours it is recorded as missing."""
    a = run(spark, sf_dir, _ARRIVALS.replace("t / 3600", "t DIV 3600"))
    g = a.groupBy("hour").agg(F.count_distinct("kind").alias("kinds"), F.count_distinct(F.when(F.col("known") <= F.col("hour") + 4200, F.col("kind"))).alias("soon"), F.max("known").alias("last"))
    state = F.when(F.col("soon") == 5, "ready").when(F.col("kinds") == 5, "late").otherwise("missing")
    return g.select("hour", state.alias("state"), F.when(state == "ready", F.col("last")).when(state == "late", F.col("hour") + 4200).otherwise(F.col("hour") + 25200).alias("decided"))


@query("k04_catch_up", duck(f"""WITH {BARS}, h AS (SELECT DISTINCT t FROM bars), m AS (SELECT max(t) AS now FROM h), d AS (SELECT t FROM h WHERE t // 3600 % 5 <> 2)
  SELECT h.t, row_number() OVER (ORDER BY h.t) AS place FROM h, m WHERE h.t > now - 48 * 3600 AND h.t NOT IN (SELECT t FROM d)"""))
def catch_up(spark, sf_dir):
    """Hours of the last two days without a result, oldest first; a window of two days' hours."""
    hours = run(spark, sf_dir, f"WITH {BARS} SELECT DISTINCT t FROM bars")
    done = hours.where("t DIV 3600 % 5 <> 2")
    recent = hours.crossJoin(F.broadcast(hours.agg(F.max("t").alias("now")))).where("t > now - 48 * 3600")
    return recent.join(done, "t", "left_anti").select("t", F.row_number().over(W.orderBy("t")).cast("long").alias("place"))


_REQUESTS = "SELECT event_id AS id, event_type AS book, @epoch(ts) AS signal, @epoch(ts) + event_id % 4 * 300 AS asked, @epoch(ts) + CAST(floor(value) AS BIGINT) * 300 AS leave FROM {events}"


@query("k05_late_entries", duck(f"""WITH RECURSIVE r AS (SELECT *, asked - signal > 600 AS late FROM ({_REQUESTS}) AS z), h AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY signal, id) AS i FROM r WHERE NOT late),
  s AS (SELECT book, id, i, 'admitted' AS why, [leave] AS held, signal AS last FROM h WHERE i = 1 UNION ALL
    SELECT book, id, i, why, CASE WHEN why = 'admitted' THEN list_append(held, leave) ELSE held END, CASE WHEN why = 'admitted' THEN signal ELSE last END FROM (
      SELECT *, CASE WHEN len(held) >= 2 THEN 'refused' WHEN signal - last < 1800 THEN 'refused' ELSE 'admitted' END AS why FROM (
        SELECT h.book, h.id, h.i, h.leave, h.signal, s.last, list_filter(s.held, lambda x: x >= h.signal) AS held FROM s JOIN h ON h.book = s.book AND h.i = s.i + 1) AS a) AS b)
  SELECT id, why FROM s UNION ALL SELECT id, 'late' FROM r WHERE late"""))
def late_entries(spark, sf_dir):
    """A request over ten minutes after its signal is late, before the cap and the gap are asked; it takes no place in the book."""
    requests = run(spark, sf_dir, _REQUESTS)
    late = F.col("asked") - F.col("signal") > 600
    judged = books.admit(requests.where(~late), "book", "signal", "leave", 2, 1800, 604800)
    return judged.select("id", F.when(F.col("admitted"), "admitted").otherwise("refused").alias("why")).unionByName(requests.where(late).select("id", F.lit("late").alias("why")))


@query("k07_windows_touched", duck(f"""WITH {BARS}, n AS (SELECT instrument, t, row_number() OVER (PARTITION BY instrument ORDER BY t) AS i FROM bars)
  SELECT DISTINCT n.instrument, n.t FROM n JOIN n AS new ON new.instrument = n.instrument AND new.t // 3600 % 50 = 0 AND n.i BETWEEN new.i AND new.i + 3"""))
def windows_touched(spark, sf_dir):
    """Windows of four bars that a batch of new bars is in; all others stand as they were."""
    over = W.partitionBy("instrument").orderBy("t").rowsBetween(-3, 0)
    bars = run(spark, sf_dir, f"WITH {BARS} SELECT instrument, t, t DIV 3600 % 50 = 0 AS new FROM bars")
    return bars.withColumn("touched", F.max("new").over(over)).where("touched").select("instrument", "t")


dual("k09_alert_edges", "WITH e AS (SELECT user_id, event_id, @epoch(ts) AS t, value > 100 AS bad FROM {events}), s AS (SELECT *, lag(bad) OVER (PARTITION BY user_id ORDER BY t, event_id) AS before FROM e) SELECT event_id, CASE WHEN bad THEN 'alert' ELSE 'clear' END AS edge FROM s WHERE (before IS NULL AND bad) OR before <> bad")


@query("k10_daily_digest", duck("SELECT event_type, CAST(CAST(ts + INTERVAL 7 HOUR AS DATE) - DATE '1970-01-01' AS BIGINT) AS day, min(event_id) AS first, count(*) AS n FROM {events} GROUP BY ALL"))
def daily_digest(spark, sf_dir):
    """One digest a local date, seven hours ahead of UTC."""
    events = run(spark, sf_dir, "SELECT event_type, event_id, ts FROM {events}")
    day = F.unix_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Ho_Chi_Minh").cast("date")).cast("long")
    return events.groupBy("event_type", day.alias("day")).agg(F.min("event_id").alias("first"), F.count(F.lit(1)).alias("n"))


@query("k11_pending_cancelled", duck("WITH e AS (SELECT event_id, user_id, event_type, @epoch(ts) AS t FROM {events}) SELECT p.event_id, coalesce(min(c.t) - p.t, 3600) AS waited, CASE WHEN min(c.t) IS NULL THEN 'CANCELLED' ELSE 'OPEN' END AS status FROM e AS p LEFT JOIN e AS c ON c.user_id = p.user_id AND c.event_type = 'view' AND c.t >= p.t AND c.t <= p.t + 3600 WHERE p.event_type = 'purchase' GROUP BY p.event_id, p.t"))
def pending_cancelled(spark, sf_dir):
    """An order that sees no bar for an hour is cancelled."""
    events = run(spark, sf_dir, "SELECT event_id, user_id, event_type, @epoch(ts) AS t FROM {events}")
    bars = events.where("event_type = 'view'").select("user_id", "t", F.col("t").alias("seen"))
    found = asof_join(events.where("event_type = 'purchase'").select("event_id", "user_id", "t"), bars, "t", ["user_id"], ["seen"], "forward", width=86400)
    soon = F.when(F.col("asof_seen") <= F.col("t") + 3600, F.col("asof_seen"))
    return found.select("event_id", F.coalesce(soon - F.col("t"), F.lit(3600)).alias("waited"), F.when(soon.isNull(), "CANCELLED").otherwise("OPEN").alias("status"))


@query("k12_immutable", "SELECT event_type, user_id % 50 AS slot, min(event_id) AS kept, count(*) - 1 AS refused FROM events GROUP BY ALL")
def immutable(spark, sf_dir):
    """What is written of a key stays; all later writes are refused and counted."""
    rows = run(spark, sf_dir, "SELECT event_type, user_id % 50 AS slot, event_id FROM {events}")
    kept = insert_new(rows.limit(0), rows, ["event_type", "slot"], ["event_id"])
    refused = rows.join(kept, ["event_type", "slot", "event_id"], "left_anti").groupBy("event_type", "slot").agg(F.count(F.lit(1)).alias("refused"))
    return kept.withColumnRenamed("event_id", "kept").join(refused, ["event_type", "slot"], "left").na.fill(0, ["refused"]).select("event_type", "slot", "kept", "refused")


dual("o10_scored_or_missing", f"WITH {BARS}, s AS (SELECT DISTINCT user_id % 3 AS x, @epoch(h) AS t FROM (SELECT user_id, date_trunc('hour', ts) AS h FROM {{events}}) AS e) SELECT s.t, s.x, round(max(b.close), 6) AS close FROM s LEFT JOIN bars AS b ON b.t = s.t + 3600 AND b.instrument = 'click' GROUP BY s.t, s.x")


@query("o24_account_curve", duck(f"""WITH {TRADES}, {CURVE}, k AS (SELECT *, row_number() OVER (ORDER BY d, id) AS i FROM peaks), s AS (SELECT *, max(CASE WHEN r > 0 THEN i ELSE 0 END) OVER (ORDER BY i) AS won FROM k)
  SELECT id, round(total / 100, 6) AS return_pct, round(100 * (peak - total) / (10000 + peak), 6) AS drawdown_pct, i - won AS streak FROM s"""))
def account_curve(spark, sf_dir):
    """Return, drawdown from the peak and losses in a row after each trade."""
    trades = run(spark, sf_dir, f"WITH {TRADES} SELECT id, d, r FROM trades")
    day = F.unix_date(F.col("d").cast("date"))
    curve = folds.running(trades, [], day, ["d", "id"], {"total": F.col("r"), "i": F.lit(1)})
    curve = folds.running(curve, [], day, ["d", "id"], maxes={"peak": F.col("total"), "won": F.when(F.col("r") > 0, F.col("i")).otherwise(0)})
    peak = F.greatest("peak", F.lit(0.0))
    return curve.select("id", F.round(F.col("total") / 100, 6).alias("return_pct"), F.round(100 * (peak - F.col("total")) / (10000 + peak), 6).alias("drawdown_pct"), (F.col("i") - F.col("won")).alias("streak"))


dual("o25_yearly_product", f"WITH {TRADES}, m AS (SELECT year(d) AS y, month(d) AS mo, sum(r) / 10000 AS ret FROM trades GROUP BY year(d), month(d)) SELECT y, round(exp(sum(ln(1 + ret))) - 1, 8) AS ret, count(*) AS months FROM m GROUP BY y")
dual("o28_funding_rows", "SELECT event_id, @epoch(ts) * 1000 AS funding_time_ms, round(value / 100000, 8) AS funding_rate FROM {events} WHERE event_type = 'view'")
dual("o29_open_or_recent", "WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderdate, (SELECT max(o_orderdate) FROM {orders}) AS now FROM {orders}) SELECT o_orderkey FROM o WHERE o_orderstatus <> 'P' AND (o_orderstatus = 'O' OR o_orderdate >= now - INTERVAL 30 DAY)")
dual("o30_missing_hours", f"WITH {BARS}, h AS (SELECT DISTINCT t FROM bars), c AS (SELECT t FROM bars WHERE instrument = 'purchase') SELECT h.t, 'no_data' AS skip_reason FROM h LEFT JOIN c ON c.t = h.t WHERE c.t IS NULL")
dual("o26_iso_times", "SELECT event_id, CAST(@epoch(ts) AS BIGINT) AS s, round(value, 4) AS v FROM {events} WHERE event_type = 'signup'")


@query("o33_message_text", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'LONG' ELSE 'SHORT' END || ' #' || CAST(o_orderkey AS VARCHAR) || ' ' || CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'skipped' END AS text FROM orders")
def message_text(spark, sf_dir):
    status = F.create_map(*[F.lit(x) for pair in (("O", "open"), ("F", "closed"), ("P", "skipped")) for x in pair])
    rows = run(spark, sf_dir, "SELECT o_orderkey, o_orderstatus FROM {orders}")
    return rows.select("o_orderkey", F.format_string("%s #%d %s", F.when(F.col("o_orderkey") % 2 == 0, "LONG").otherwise("SHORT"), "o_orderkey", status[F.col("o_orderstatus")]).alias("text"))


@query("o34_feeds", duck("WITH e AS (SELECT event_id, user_id, event_type, @epoch(ts) AS t FROM {events}) SELECT a.event_id, min(b.event_id) AS reply_to FROM e AS a LEFT JOIN e AS b ON b.user_id = a.user_id AND b.event_type = 'purchase' AND b.t <= a.t WHERE a.event_type = 'click' AND a.t >= (SELECT max(t) FROM e) - 86400 GROUP BY a.event_id"))
def feeds(spark, sf_dir):
    """The message that a recent one replies to, the first of its user's so far: a running minimum, counted by days."""
    rows = run(spark, sf_dir, "SELECT event_id, user_id, event_type, @epoch(ts) AS t FROM {events} WHERE event_type IN ('click', 'purchase')").withColumn("_late", F.col("event_type") == "click")
    seen = folds.running(rows, ["user_id"], F.floor(F.col("t") / 86400), ["t", "_late", "event_id"], maxes={"_least": F.when(~F.col("_late"), -F.col("event_id"))})
    now = run(spark, sf_dir, "SELECT max(@epoch(ts)) AS now FROM {events}")
    return seen.where("_late").crossJoin(F.broadcast(now)).where("t >= now - 86400").select("event_id", (-F.col("_least")).alias("reply_to"))


@query("o40_append_new", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'kept' ELSE 'appended' END AS state FROM events")
def append_new(spark, sf_dir):
    events = run(spark, sf_dir, "SELECT event_id FROM {events}")
    have = events.where("event_id % 4 = 0")
    return have.withColumn("state", F.lit("kept")).unionByName(insert_new(have, events, ["event_id"], ["event_id"]).withColumn("state", F.lit("appended")))
