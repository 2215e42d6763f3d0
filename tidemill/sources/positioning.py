"""Positioning of a market on a grid of bars: replies of four endpoints and premium bars, or their files, made one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The fields of each endpoint and of the files; the time (2024-03-04) up to which a measure is stamped with the end of
# its bar, and from which on with its start; three bars of carrying; two percent between open interest and its value.
ENDPOINTS = {
    "oi": {"oi": "sumOpenInterest", "oi_usd": "sumOpenInterestValue"}, "top_acct": {"top_acct_ls": "longShortRatio"},
    "top_pos": {"top_pos_ls": "longShortRatio"}, "acct": {"acct_ls": "longShortRatio"},
}
FILE_FIELDS = {
    "oi": "sum_open_interest", "oi_usd": "sum_open_interest_value", "top_acct_ls": "count_toptrader_long_short_ratio",
    "top_pos_ls": "sum_toptrader_long_short_ratio", "acct_ls": "count_long_short_ratio",
}
MEASURES = tuple(FILE_FIELDS)
PREMIUM = ("open", "high", "low", "close")
STEP_MS, CUTOVER_MS, CARRY, SLACK = 300_000, 1_709_510_400_000, 3, 0.02


def _number(text: Column) -> Column:
    return text.cast("string").try_cast("double")


def reply_measures(replies: DataFrame, by: str, shift_ms: int = 0) -> DataFrame:
    """(by, create_ms, measures) of replies (by, endpoint, raw, seq), raw being a JSON object: a row for each time any endpoint has,
    null where one lacks it; of an endpoint's repeated times the last by seq. All endpoints go through one aggregate, so there
    is one shuffle and not a full join a source. Replies without a time, and of other endpoints, are left out; text that is no number is null."""
    known = replies.where(F.col("endpoint").isin(*ENDPOINTS)).withColumn("create_ms", F.get_json_object("raw", "$.timestamp").try_cast("long") + shift_ms)
    last = []
    for name, fields in ENDPOINTS.items():
        said = F.struct(*[_number(F.get_json_object("raw", f"$.{field}")).alias(c) for c, field in fields.items()])
        last.append(F.max_by(said, F.when(F.col("endpoint") == name, F.col("seq"))).alias(f"_{name}"))
    rows = known.where("create_ms IS NOT NULL").groupBy(by, "create_ms").agg(*last)
    return rows.select(by, "create_ms", *[F.col(f"_{name}.{c}").alias(c) for name, fields in ENDPOINTS.items() for c in fields])


def file_measures(rows: DataFrame, by: str) -> DataFrame:
    """The same of a file's rows (by, create_time, its fields); create_time is UTC text."""
    at = F.unix_millis(F.to_timestamp(F.concat(F.col("create_time"), F.lit(" UTC")), "yyyy-MM-dd HH:mm:ss VV"))
    return rows.select(by, at.alias("create_ms"), *[_number(F.col(field)).alias(c) for c, field in FILE_FIELDS.items()])


def reply_premium(replies: DataFrame, by: str) -> DataFrame:
    """(by, open_ms, open, high, low, close, count, seq) of replies (by, raw, seq), raw being a JSON array. It has no count: 1."""
    place = lambda k: F.get_json_object("raw", f"$[{k}]")
    rows = replies.select(by, place(0).try_cast("long").alias("open_ms"), *[_number(place(k)).alias(c) for k, c in enumerate(PREMIUM, 1)], F.lit(1.0).alias("count"), "seq")
    return rows.where("open_ms IS NOT NULL")


def owner_ms(created: Column, step_ms: int = STEP_MS, cutover_ms: int = CUTOVER_MS) -> Column:
    """The start of the bar that a measure created at this time is of."""
    return F.when(created < cutover_ms, created - step_ms).otherwise(created)


def _spread(rows: DataFrame, time: str, age: str, step_ms: int, limit: int) -> DataFrame:
    """Each row at its own time and at the limit bars after it. What a bar carries is then an aggregate by its time, without order."""
    return rows.withColumn(age, F.explode(F.sequence(F.lit(0), F.lit(limit)))).withColumn(time, F.col(time) + F.col(age) * step_ms)


def positioning(measures: DataFrame, premium: DataFrame, grid: DataFrame, by: str, step_ms: int = STEP_MS, cutover_ms: int = CUTOVER_MS, limit: int = CARRY) -> DataFrame:
    """A row for each row of grid (by, open_time_ms, price): measures (by, create_ms, ...) and premium (by, open_ms, open, high, low,
    close, count, seq) as they were known at its close.

    A bar without a record has the whole last record of up to limit bars before it, and its age in m_age_bars or p_age_bars. Then
    measures that are not positive are null, and the value of open interest where it differs from open interest times price by
    over 2 % (with a price). A premium of exactly zero is a missing sample: the last other value that up to limit bars before
    have, carried ones too. Flags say which groups are there. Records off the grid count for nothing; of those of one bar the
    last by create_ms, or by seq. Bars are told apart by time, so a hole in the grid ages what is carried over it.
    """
    bars = grid.where(F.col(by).isNotNull() & F.col("open_time_ms").isNotNull()).dropDuplicates([by, "open_time_ms"])
    on_grid = bars.select(by, "open_time_ms")
    owned = measures.withColumn("open_time_ms", owner_ms(F.col("create_ms"), step_ms, cutover_ms))
    owned = owned.groupBy(by, "open_time_ms").agg(F.max_by(F.struct(*MEASURES), "create_ms").alias("m")).join(on_grid, [by, "open_time_ms"], "left_semi")
    carried = _spread(owned, "open_time_ms", "_age", step_ms, limit).groupBy(by, "open_time_ms").agg(F.min_by("m", "_age").alias("m"), F.min("_age").alias("m_age_bars"))

    said = F.struct(*PREMIUM, F.col("count").alias("samples"))
    real = premium.groupBy(by, F.col("open_ms").alias("open_time_ms")).agg(F.max_by(said, "seq").alias("p")).join(on_grid, [by, "open_time_ms"], "left_semi")
    whole = _spread(real, "open_time_ms", "_age", step_ms, limit).groupBy(by, "open_time_ms").agg(F.min_by("p", "_age").alias("p"), F.min("_age").alias("p_age_bars"))
    whole = whole.join(on_grid, [by, "open_time_ms"], "left_semi").select(by, "open_time_ms", "p_age_bars", F.col("p.samples").alias("samples"), *[F.nullif(F.col(f"p.{c}"), F.lit(0.0)).alias(c) for c in PREMIUM])
    own = lambda c: F.max(F.when(F.col("_back") == 0, F.col(c)))
    near = _spread(whole, "open_time_ms", "_back", step_ms, limit).groupBy(by, "open_time_ms").agg(
        own("p_age_bars").alias("p_age_bars"), own("samples").alias("prem_samples"), *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_back"))).alias(f"prem_{c}") for c in PREMIUM],
    )
    table = bars.join(carried, [by, "open_time_ms"], "left").join(near.where("p_age_bars IS NOT NULL"), [by, "open_time_ms"], "left")
    good = {c: F.when(F.col(f"m.{c}") > 0, F.col(f"m.{c}")) for c in MEASURES}
    off = F.abs(good["oi_usd"] / (good["oi"] * F.col("price")) - 1) > SLACK
    good["oi_usd"] = F.when(~F.coalesce(off, F.lit(False)), good["oi_usd"])
    table = table.select(by, "open_time_ms", *[v.alias(c) for c, v in good.items()], *[f"prem_{c}" for c in PREMIUM], "prem_samples", "m_age_bars", "p_age_bars")
    flags = {"m_ok": "oi", "p_ok": "prem_close", "top_ok": "top_pos_ls", "acct_ok": "acct_ls"}
    return table.select("*", *[F.col(c).isNotNull().cast("int").alias(f) for f, c in flags.items()])
