"""Positioning from replies and from files, envelopes of every kind, by rows stated by hand."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemill.sources import envelopes as env, positioning as pos

STEP, START = pos.STEP_MS, pos.CUTOVER_MS + 100 * pos.STEP_MS


def test_owner(spark):
    rows = spark.createDataFrame([(pos.CUTOVER_MS + d * STEP,) for d in (-1, 0, 1)], "t long")
    assert [r[0] for r in rows.select(pos.owner_ms(F.col("t"))).collect()] == [pos.CUTOVER_MS + d * STEP for d in (-2, 0, 1)]


def test_replies_and_files_agree(spark):
    """A bar without a record, then five; a premium of zero; replies without a time, of another endpoint, twice, and not JSON."""
    times = [START + k * STEP for k in range(16) if k not in (4, 8, 9, 10, 11, 12)]
    replies = [(None, "oi", "{}", 0), ("x", "other", json.dumps({"timestamp": START}), 0), ("x", "oi", "no", 0), ("x", "acct", json.dumps({"timestamp": times[0], "longShortRatio": "9"}), -1)]
    for k, t in enumerate(times):
        replies.append(("x", "oi", json.dumps({"timestamp": t, "sumOpenInterest": str(1000 + k), "sumOpenInterestValue": "0"}), k))
        replies += [("x", e, json.dumps({"timestamp": t, "longShortRatio": "1.1"}), k) for e in ("top_acct", "top_pos", "acct")]
    measures = pos.reply_measures(spark.createDataFrame(replies, "x string, endpoint string, raw string, seq long"), "x")
    files = spark.createDataFrame([("x", str(t // 1000), str(1000 + k), "0", "1.1", "1.1", "1.1") for k, t in enumerate(times)], ["x", "s", *pos.FILE_FIELDS.values()])
    files = pos.file_measures(files.withColumn("create_time", F.date_format(F.to_utc_timestamp(F.timestamp_seconds(F.col("s").cast("long")), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")), "x")
    assert sorted(map(tuple, measures.collect()), key=str) == sorted(map(tuple, files.collect()), key=str)
    premium = pos.reply_premium(spark.createDataFrame([("x", json.dumps([START + k * STEP, "0.1", "0.2", "0.0", "0" if k == 7 else str(k)]), k) for k in range(16)], "x string, raw string, seq long"), "x")
    grid = spark.createDataFrame([("x", START + k * STEP, 1.0) for k in range(16)], "x string, open_time_ms long, price double")
    rows = sorted(pos.positioning(measures, premium, grid, "x").collect(), key=lambda r: r.open_time_ms)
    assert [r.oi for r in rows] == [1000, 1001, 1002, 1003, 1003, 1004, 1005, 1006, 1006, 1006, 1006, None, None, 1007, 1008, 1009]
    assert [r.m_age_bars for r in rows] == [0, 0, 0, 0, 1, 0, 0, 0, 1, 2, 3, None, None, 0, 0, 0]
    assert [r.m_ok for r in rows] == [int(r.acct_ls == 1.1) for r in rows] and {r.oi_usd for r in rows} == {None} == {r.prem_low for r in rows}
    assert [r.prem_close for r in rows][5:9] == [5.0, 6.0, 6.0, 8.0] and [r.prem_close for r in rows][0] is None


BAR = [0, "1.50", "2", "1.0", "1.2e0", "3", 299_999, "4.500", 7, "0.0", "2"]
ROWS = [
    ("candle", "5m", BAR, "live", {"open": "1.5", "high": "2", "low": "1", "close": "1.2", "volume": "3", "quote_volume": "4.5", "trade_count": 7, "taker_buy_base": "0", "taker_buy_quote": "2"}, 0, None),
    ("candle", "5m", [*BAR[:6], 300_000, *BAR[7:]], "live", ..., 0, "close"),
    ("candle", "5m", [0, "3", *BAR[2:]], "live", ..., 0, "value"),
    ("candle", "5m", [1, *BAR[1:6], 300_000, *BAR[7:]], "live", ..., 1, "envelope"),
    ("candle", "5m", [0, "x", *BAR[2:]], "live", None, 0, "unreadable"),
    ("candle", "7m", BAR, "live", ..., None, "unknown"),
    ("other", "5m", BAR, "live", None, None, "unknown"),
    ("premium", "5m", [300_000, "-0.0001", "0.0000002", "-0.0002", "0", "0", 599_999], "backfill", {"open": "-0.0001", "high": "0.0000002", "low": "-0.0002", "close": "0", "source_timestamp_ms": 300_000}, 300_000, None),
    ("premium", "5m", [300_000, "0.1", "0.1", "0", "0", "0", 599_999], "backfill", ..., 300_000, "value"),
    ("ratio", "5m", {"timestamp": 600_000, "longShortRatio": "1.5", "longAccount": "0.6", "shortAccount": "0.4"}, "recovery", {"longShortRatio": "1.5", "longAccount": "0.6", "shortAccount": "0.4", "source_timestamp_ms": 600_000}, 300_000, None),
    ("top_ratio", "5m", {"timestamp": 600_000, "longShortRatio": "1.5", "longAccount": "0.6", "shortAccount": "0.398"}, "live", ..., 300_000, "value"),
    ("taker", "5m", {"timestamp": 600_000, "buySellRatio": "1", "buyVol": "-2", "sellVol": "2"}, "live", ..., 600_000, "value"),
    ("oi", "5m", {"timestamp": 600_000, "sumOpenInterest": 12, "sumOpenInterestValue": "100"}, "test", ..., 300_000, "envelope"),
    ("funding", "1h", {"fundingTime": 7_200_004, "fundingRate": "-0.0100", "markPrice": ""}, "live", {"fundingRate": "-0.01", "markPrice": "0", "source_timestamp_ms": 7_200_004}, 3_600_000, None),
    ("funding", "1h", {"fundingTime": 7_200_004, "fundingRate": "0.05"}, "live", ..., 3_600_000, "value"),
    ("funding", "1h", {"fundingTime": None, "fundingRate": "0.05"}, "live", None, None, "unreadable"),
    (None, None, None, None, None, None, "unknown"),
]


def test_envelopes(spark):
    rows = spark.createDataFrame([(k, kind, tf, None if raw is None else json.dumps(raw), "s", mode, 10_000_000, "clash") for k, (kind, tf, raw, mode, *_) in enumerate(ROWS)], "k long, kind string, timeframe string, raw string, source string, mode string, received_at_ms long, data string")
    found = env.envelopes(rows, "venue:pair", F.lit(10_000_000)).orderBy("k").collect()
    for r, (kind, tf, _, _, data, start, issue) in zip(found, ROWS, strict=True):
        assert (r.issue, r.period_start_ms if issue != "unknown" else None) == (issue, start if issue != "unknown" else None), r
        if isinstance(data, dict):
            assert json.loads(r.data) == data
            text = json.dumps(["venue:pair", kind, tf, start, data], sort_keys=True, separators=(",", ":"))
            assert r.event_id == hashlib.sha256(text.encode()).hexdigest()
        elif data is None:
            assert r.data is None and r.event_id is None


@pytest.mark.parametrize("text, plain", [("1e-7", "0.0000001"), ("-0.0", "0"), ("100", "100"), ("1.0e3", "1000"), ("inf", None), ("NaN", None), ("", None), ("1" * 30, None)])
def test_number_text(spark, text, plain):
    assert spark.createDataFrame([(text,)], "t string").select(env.number_text(F.col("t"))).first()[0] == plain
