"""Envelopes of market events: one contract for bars given as JSON arrays and measures given as JSON objects, with what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemill.functions.validation import envelope_valid, holds

# The fields of each kind, in their places or by name; kinds stamped with the end of their period; the limits of premiums,
# shares and rates.
CANDLE = {"open": 1, "high": 2, "low": 3, "close": 4, "volume": 5, "quote_volume": 7, "taker_buy_base": 9, "taker_buy_quote": 10}
TRADES, CLOSED = 8, 6
PREMIUM = {"open": 1, "high": 2, "low": 3, "close": 4}
SHARES = ("longShortRatio", "longAccount", "shortAccount")
MEASURES = {
    "ratio": SHARES, "top_ratio": SHARES, "top_acct_ratio": SHARES, "taker": ("buySellRatio", "buyVol", "sellVol"),
    "oi": ("sumOpenInterest", "sumOpenInterestValue"), "funding": ("fundingRate", "markPrice"),
}
STAMPED_AT_END = ("ratio", "top_ratio", "top_acct_ratio", "oi")
STEPS = {"1m": 60_000, "5m": 300_000, "15m": 900_000, "30m": 1_800_000, "1h": 3_600_000, "4h": 14_400_000, "1d": 86_400_000}
WHOLE = ("source_timestamp_ms", "trade_count")
PREMIUM_LIMIT, SHARE_SLACK, RATE_LIMIT = 0.1, 0.001, 0.05

#: Columns that an envelope adds.
MADE = ("schema_version", "instrument", "period_start_ms", "period_end_ms", "data", "event_id", "issue")


def number_text(text: Column) -> Column:
    """A number in plain digits without trailing zeros, null if it is none or has more than 20 digits before or 18 after the point."""
    exact = text.cast("string").try_cast("decimal(38,18)")
    same = exact.try_cast("double") == text.cast("string").try_cast("double")
    plain = F.regexp_replace(exact.cast("string"), r"\.?0+$", "")
    return F.when(exact == 0, "0").when(same, plain)


def _members(kind: str) -> dict[str, Column]:
    """What data says of the kind, as text, by sorted names."""
    bar, named, stamp = F.col("_bar"), F.col("_object"), F.col("_stamp").cast("string")
    if kind in ("candle", "premium"):
        cells = {c: F.get(bar, F.lit(k)) for c, k in (CANDLE if kind == "candle" else PREMIUM).items()}
        cells |= {"trade_count": F.get(bar, F.lit(TRADES)).try_cast("long").cast("string")} if kind == "candle" else {"source_timestamp_ms": stamp}
    else:
        cells = {c: F.try_element_at(named, F.lit(c)) for c in MEASURES[kind]} | {"source_timestamp_ms": stamp}
    if kind == "funding":
        cells["markPrice"] = F.when(F.coalesce(cells["markPrice"], F.lit("")) == "", "0").otherwise(cells["markPrice"])
    return dict(sorted(cells.items()))


def _sound(kind: str) -> Column:
    """The kind's own predicate."""
    value = {c: F.get("_numbers", F.lit(k)).cast("double") for k, c in enumerate(_members(kind))}
    if kind in ("candle", "premium"):
        o, h, lo, c = (value[k] for k in ("open", "high", "low", "close"))
        if kind == "premium":
            return holds(*[F.abs(x) < PREMIUM_LIMIT for x in (o, h, lo, c)], lo <= h)
        return holds(F.least(o, h, lo, c) > 0, value["volume"] >= 0, lo <= F.least(o, c), h >= F.greatest(o, c))
    if kind == "funding":
        return holds(F.abs(value["fundingRate"]) < RATE_LIMIT, value["markPrice"] >= 0)
    positive = [value[c] >= 0 for c in MEASURES[kind]]
    if MEASURES[kind] != SHARES:
        return holds(*positive)
    long, short = value["longAccount"], value["shortAccount"]
    return holds(*positive, long <= 1, short <= 1, F.abs(long + short - 1) <= SHARE_SLACK)


def _by_kind(of) -> Column:
    out = None
    for kind in ("candle", "premium", *MEASURES):
        out = (F.when if out is None else out.when)(F.col("kind") == kind, of(kind))
    return out


def envelopes(rows: DataFrame, instrument: str, now: Column, schema: int = 1) -> DataFrame:
    """rows (kind, timeframe, raw, source, mode, received_at_ms, ...), with schema_version, event_id, instrument, period_start_ms,
    period_end_ms, data and issue.

    raw is a JSON array of a bar or a JSON object of a measure; data is JSON of its numbers, as text in plain digits, with sorted
    keys. event_id is the hash of instrument, kind, timeframe, start and data, so that it is the same by whatever source and at
    whatever time an event comes. issue is null or the first of: unknown (kind or timeframe), unreadable (a number or time that is
    none), close (a bar that does not end a step on), envelope (mode, alignment, receipt), value (the kind's predicate). An
    unreadable row has no data and no id. Columns of rows with one of those names, or of the helpers below, are lost.

    raw is parsed once and its numbers are made an array, so that what is generated for a row stays small.
    """
    step = F.create_map(*[F.lit(x) for pair in STEPS.items() for x in pair])[F.col("timeframe")]
    given = [c for c in rows.columns if c not in (*MADE, "_bar", "_object", "_stamp", "_numbers")]
    is_bar = F.col("kind").isin("candle", "premium")
    rows = rows.select(*given, F.when(is_bar, F.from_json("raw", "array<string>")).alias("_bar"), F.when(~is_bar, F.from_json("raw", "map<string,string>")).alias("_object"))
    stamp = F.when(is_bar, F.get("_bar", F.lit(0))).otherwise(F.try_element_at("_object", F.when(F.col("kind") == "funding", "fundingTime").otherwise("timestamp")))
    rows = rows.withColumn("_stamp", stamp.try_cast("long"))
    rows = rows.withColumn("_numbers", F.transform(_by_kind(lambda kind: F.array(*_members(kind).values())), number_text))
    step = F.create_map(*[F.lit(x) for pair in STEPS.items() for x in pair])[F.col("timeframe")]
    start = F.when(F.col("kind") == "funding", F.col("_stamp") - F.pmod("_stamp", step) - step).when(F.col("kind").isin(*STAMPED_AT_END), F.col("_stamp") - step).otherwise(F.col("_stamp"))

    def member(name, number):
        mark = F.when(name.isin(*WHOLE), "").otherwise('"')
        return F.concat(F.lit('"'), name, F.lit('":'), mark, number, mark)

    names = _by_kind(lambda kind: F.array(*map(F.lit, _members(kind))))
    data = F.concat(F.lit("{"), F.array_join(F.zip_with(names, "_numbers", member), ","), F.lit("}"))
    data = F.when(~F.exists("_numbers", lambda x: x.isNull()), data)
    made = rows.select(*given, "_bar", "_numbers", F.lit(schema).alias("schema_version"), F.lit(instrument).alias("instrument"), start.alias("period_start_ms"), (start + step).alias("period_end_ms"), data.alias("data"))
    identity = F.concat(F.lit(f'["{instrument}","'), "kind", F.lit('","'), "timeframe", F.lit('",'), F.col("period_start_ms").cast("string"), F.lit(","), "data", F.lit("]"))
    closes = F.get("_bar", F.lit(CLOSED)).try_cast("long") + 1 == F.col("period_end_ms")
    issue = (
        F.when(F.coalesce(~F.col("kind").isin("candle", "premium", *MEASURES), F.lit(True)) | step.isNull(), "unknown")
        .when(F.col("data").isNull() | F.col("period_start_ms").isNull(), "unreadable")
        .when(is_bar & ~holds(closes), "close")
        .when(~envelope_valid(step, now, schema), "envelope")
        .when(~_by_kind(_sound), "value")
    )
    return made.select(*given, *MADE[:-2], F.sha2(identity, 256).alias("event_id"), issue.alias("issue"))
