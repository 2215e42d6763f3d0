"""Dashboard panels, status counts and period reports as queries (E02 to E24, N01 to N18, O-series reports)."""

from tidemill.plans.dual import BARS, SERIES, dual

dual("e02_count_min_max", "SELECT event_type, count(*) AS n, min(t) AS first, max(t) AS last FROM (SELECT event_type, @epoch(ts) AS t FROM {events}) AS e GROUP BY event_type")
dual("e03_count_filter", "SELECT count(*) FILTER (WHERE value > 100) AS high, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) AS n FROM {events}")
dual("e04_sum_by_status", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_orderstatus, o_orderpriority")
dual(
    "e05_yearly_shares",
    """SELECT year(o_orderdate) AS y, count(*) AS n, round(avg(o_totalprice), 6) AS mean_price,
       round(CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) / greatest(count(*), 1), 6) AS filled,
       round(CAST(count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 100000) AS DOUBLE) / greatest(count(*) FILTER (WHERE o_orderstatus = 'F'), 1), 6) AS large_filled
       FROM {orders} GROUP BY year(o_orderdate)""",
)
#: Orders as closed trades: r is a result in units of risk, made from the price.
TRADES = """trades AS (
  SELECT o_orderkey AS id, o_custkey AS book, o_orderdate AS d, date_trunc('quarter', o_orderdate) AS q, year(o_orderdate) AS y, o_orderstatus AS kind,
         (CAST(CAST(floor(o_totalprice) AS BIGINT) % 2400 AS DOUBLE) - 1130) / 1000 AS r FROM {orders})"""
CURVE = """curve AS (SELECT *, sum(r) OVER (ORDER BY d, id ROWS UNBOUNDED PRECEDING) AS total FROM trades),
peaks AS (SELECT *, greatest(max(total) OVER (ORDER BY d, id ROWS UNBOUNDED PRECEDING), 0) AS peak FROM curve)"""
dual("e07_by_period", f"WITH {TRADES} SELECT y, quarter(d) AS quarter, count(*) AS n, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(sum(r), 4) AS sum_r FROM trades GROUP BY y, quarter(d)")
dual(
    "e08_period_returns",
    f"""WITH {TRADES}, daily AS (SELECT d, y, sum(r) AS r FROM trades GROUP BY d, y),
    equity AS (SELECT d, y, exp(sum(ln(1 + r / 10000)) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING)) AS e FROM daily),
    start AS (SELECT *, coalesce(lag(e, 1) OVER (ORDER BY d), 1.0) AS s FROM equity)
    SELECT y, round(max_by(e, d) / min_by(s, d) - 1, 8) AS ret FROM start GROUP BY y""",
)
dual("e10_account_summary", f"WITH {TRADES} SELECT count(*) AS n, count(*) FILTER (WHERE r > 0) AS wins, count(*) FILTER (WHERE r <= 0) AS losses, round(avg(CASE WHEN r > 0 THEN r END), 6) AS avg_win, round(avg(CASE WHEN r <= 0 THEN r END), 6) AS avg_loss, max(r) AS best, min(r) AS worst, count(*) FILTER (WHERE kind = 'O') AS n_o, count(*) FILTER (WHERE kind = 'F') AS n_f, count(*) FILTER (WHERE kind = 'P') AS n_p FROM trades")
dual(
    "e11_seed_table",
    f"""WITH {TRADES}, seeds AS (SELECT id % 5 AS seed, avg(r) AS m, count(*) AS n FROM trades GROUP BY id % 5)
    SELECT CAST(seed AS VARCHAR(20)) AS label, round(m, 6) AS mean_r FROM seeds UNION ALL SELECT 'mean', round(avg(m), 6) FROM seeds
    UNION ALL SELECT 'std', round(stddev_samp(m), 6) FROM seeds UNION ALL SELECT 'min', round(min(m), 6) FROM seeds""",
)
dual("e12_ensemble_mean", "SELECT user_id, @epoch(d) AS day, round(avg(value), 6) AS p, count(*) AS seeds FROM (SELECT *, date_trunc('day', ts) AS d FROM {events}) AS e GROUP BY user_id, d, @epoch(d)")
SCORED = "scored AS (SELECT l.doc_id, l.quality AS y, l.toxic, d.n_chars AS score, d.lang, CAST(1 / (1 + exp(-(ln(1 + d.n_chars) - 7))) AS DOUBLE) AS p FROM {labels} AS l JOIN {documents} AS d ON l.doc_id = d.doc_id)"
RANKED = "ranked AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk, count(*) OVER () AS n FROM scored)"
AUC = "round((sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 6)"
dual("e14_log_loss", f"WITH {SCORED} SELECT lang, round(avg(-(y * ln(greatest(p, 1e-7)) + (1 - y) * ln(greatest(1 - p, 1e-7)))), 6) AS log_loss, count(*) AS n FROM scored GROUP BY lang")
dual("e15_pivot", "SELECT quarter(o_orderdate) AS quarter, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS o, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS f, round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 2) AS p FROM {orders} GROUP BY quarter(o_orderdate)")
dual(
    "e17_quintiles",
    f"""WITH {SCORED}, edges AS (SELECT @quantile(score, 0.2) AS a, @quantile(score, 0.4) AS b, @quantile(score, 0.6) AS c, @quantile(score, 0.8) AS d FROM scored),
    binned AS (SELECT CASE WHEN score <= a THEN 1 WHEN score <= b THEN 2 WHEN score <= c THEN 3 WHEN score <= d THEN 4 ELSE 5 END AS bin, s.* FROM scored AS s CROSS JOIN edges)
    SELECT bin, count(*) AS n, round(avg(CAST(y AS DOUBLE)), 6) AS rate, round(avg(CAST(toxic AS DOUBLE)), 6) AS toxic_rate FROM binned GROUP BY bin""",
)
dual("e18_fixed_bins", "SELECT CASE WHEN value <= 10 THEN '(0,10]' WHEN value <= 50 THEN '(10,50]' WHEN value <= 200 THEN '(50,200]' ELSE '(200,)' END AS bin, count(*) AS n, round(avg(value), 6) AS mean FROM {events} GROUP BY CASE WHEN value <= 10 THEN '(0,10]' WHEN value <= 50 THEN '(10,50]' WHEN value <= 200 THEN '(50,200]' ELSE '(200,)' END")
dual("e19_rollup_total", "SELECT coalesce(o_orderstatus, 'total') AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY ROLLUP (o_orderstatus)")
dual("e20_bucket_counts", "SELECT event_type, @epoch(d) AS day, count(*) AS n FROM (SELECT *, date_trunc('day', ts) AS d FROM {events}) AS e GROUP BY event_type, d, @epoch(d)")
dual("e21_freshness", "WITH ev AS (SELECT event_type, @epoch(ts) AS t FROM {events}) SELECT event_type, m - max(t) AS lag_s, count(*) FILTER (WHERE t >= m - 86400) AS last_day FROM ev CROSS JOIN (SELECT max(t) AS m FROM ev) AS x GROUP BY event_type, m")
dual("e22_oldest_age", "WITH ev AS (SELECT user_id, @epoch(ts) AS t FROM {events}), last AS (SELECT user_id, max(t) AS t FROM ev GROUP BY user_id) SELECT coalesce(max((SELECT max(t) FROM ev) - t), 0) AS oldest FROM last")
dual("e23_value_counts", "SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, round(avg(CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0.0 END), 6) AS long_share FROM {documents} GROUP BY lang")
dual("e24_hour_histogram", "SELECT hour(ts) AS h, count(*) AS n FROM {events} GROUP BY hour(ts)")
dual("e38_decay_weights", "SELECT o_orderkey, round(greatest(power(0.5, ((@epoch(last) - @epoch(o_orderdate)) / 86400) / 540.0), 0.2), 8) AS w FROM {orders} CROSS JOIN (SELECT max(o_orderdate) AS last FROM {orders}) AS x")
dual("e42_calibration_share", f"WITH {SCORED}, q AS (SELECT @quantile(p, 0.8) AS thr FROM scored WHERE doc_id % 2 = 0) SELECT round(thr, 9) AS thr, count(*) FILTER (WHERE p >= thr) AS above, count(*) AS n FROM scored CROSS JOIN q WHERE doc_id % 2 = 1 GROUP BY thr")
dual("f22_latest_per_source", "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM {events}) AS e WHERE k = 1")
dual("g02_order_limit", "SELECT event_id, value FROM {events} ORDER BY value DESC, event_id LIMIT 48")
dual("g05_last_rows", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
dual("h01_union_all", "SELECT 'c' AS part, c_nationkey AS nation, count(*) AS n FROM {customer} GROUP BY c_nationkey UNION ALL SELECT 's', s_nationkey, count(*) FROM {supplier} GROUP BY s_nationkey")
dual("h02_grid_difference", f"WITH {BARS}, grid AS (SELECT i.instrument, h.t FROM (SELECT DISTINCT instrument FROM bars) AS i CROSS JOIN (SELECT DISTINCT t FROM bars) AS h) SELECT instrument, t FROM grid EXCEPT SELECT instrument, t FROM bars")
dual("h03_set_operations", "SELECT c_nationkey AS k, 'both' AS part FROM (SELECT c_nationkey FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}) AS a UNION ALL SELECT c_nationkey, 'left' FROM (SELECT c_nationkey FROM {customer} EXCEPT SELECT s_nationkey FROM {supplier}) AS b")
dual("h04_jaccard", "WITH a AS (SELECT DISTINCT user_id FROM {events} WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id FROM {events} WHERE event_type = 'view'), i AS (SELECT count(*) AS n FROM (SELECT user_id FROM a INTERSECT SELECT user_id FROM b) AS x), u AS (SELECT count(*) AS n FROM (SELECT user_id FROM a UNION SELECT user_id FROM b) AS x) SELECT round(CAST(i.n AS DOUBLE) / greatest(u.n, 1), 6) AS jaccard FROM i CROSS JOIN u")
dual("h05_append_keep_last", "WITH u AS (SELECT event_id, value, 0 AS v FROM {events} UNION ALL SELECT event_id, value * 2, 1 FROM {events} WHERE event_id % 3 = 0) SELECT event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY v DESC) AS k FROM u) AS x WHERE k = 1")
# Panels. "Now" is the newest event.
dual("n01_last_hour", "WITH ev AS (SELECT @epoch(ts) AS t FROM {events}) SELECT count(*) AS n FROM ev CROSS JOIN (SELECT max(t) AS now FROM ev) AS x WHERE t >= now - 3600")
dual("n03_good_signals", "WITH ev AS (SELECT @epoch(ts) AS t, CAST(@json(props, 'k') AS BIGINT) AS k FROM {events}) SELECT count(*) FILTER (WHERE k >= 5) AS good, count(*) AS n FROM ev CROSS JOIN (SELECT max(t) AS now FROM ev) AS x WHERE t >= now - 86400")
dual("n04_open_trades", "SELECT count(*) AS n FROM {orders} WHERE o_orderstatus IN ('O', 'P')")
dual("n05_pending", "SELECT count(*) AS n FROM {labels} AS l RIGHT JOIN {documents} AS d ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL")
dual("n07_minute_counts", "SELECT event_type, @epoch(m) AS minute, count(*) AS n FROM (SELECT *, date_trunc('minute', ts) AS m FROM {events}) AS e GROUP BY event_type, m, @epoch(m)")
dual("n08_json_series", "SELECT event_id, CAST(@json(props, 'k') AS BIGINT) AS k FROM {events} WHERE event_type = 'click'")
dual("n09_latest_signals", "SELECT event_id, event_type, round(value, 2) AS v, CAST(@json(props, 'k') AS BIGINT) AS k FROM {events} ORDER BY ts DESC, event_id LIMIT 48")
dual("n10_last_closed", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'long' ELSE 'short' END AS side, o_totalprice FROM {orders} WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
dual("n11_service_health", "WITH ev AS (SELECT user_id, @epoch(ts) AS t FROM {events}) SELECT user_id, now - max(t) AS age, CASE WHEN now - max(t) > 3600 THEN 'stale' ELSE 'ok' END AS state FROM ev CROSS JOIN (SELECT max(t) AS now FROM ev) AS x GROUP BY user_id, now")
dual("n12_backlog", "SELECT event_type, count(*) AS n, min(event_id) AS oldest FROM {events} WHERE value > 50 GROUP BY event_type")
dual("n13_issues", "SELECT event_id, value FROM {events} WHERE value > 200 ORDER BY ts DESC, event_id LIMIT 50")
dual("n17_summary_total", f"WITH {TRADES} SELECT kind, count(*) AS n, round(sum(r), 3) AS r FROM trades GROUP BY kind UNION ALL SELECT 'total', count(*), round(sum(r), 3) FROM trades")
dual(
    "entry_hourly_report",
    f"""WITH {SERIES}, r AS (SELECT *, ln(close / lag(close) OVER (ORDER BY t)) AS ret FROM series),
    c AS (SELECT *, sum(coalesce(ret, 0)) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS total FROM r)
    SELECT t, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 4) AS volume, ticks, round(ret, 8) AS ret,
           round(max(total) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) - total, 6) AS drawdown FROM c""",
)
