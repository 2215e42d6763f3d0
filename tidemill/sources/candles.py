"""Candle files and tables of any layout, made one: names, types, order, gaps, and a second source for what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: Other names of a column, in order of preference; all in lower case.
NAMES = {
    "open_time_ms": ("open_time_ms", "open_time", "timestamp", "ts", "time"), "volume": ("volume", "vol"),
    "taker_base": ("taker_base", "taker_buy_base_asset_volume", "taker_buy_volume", "taker_buy_base"), "taker_quote": ("taker_quote", "taker_buy_quote_asset_volume", "taker_buy_quote_volume"),
}
PRICES = ("open", "high", "low", "close")


def prepare(rows: DataFrame, by: str, step_ms: int, tie: str | None = None) -> DataFrame:
    """rows with one name for each column, numbers as such, one row a time (the first by tie) and after_gap.

    A value that no other name of its column has either is null; text that is no number too. Rows without a time, or with a price
    that is null or not positive, are dropped. Prices that are not there at all are no fault here.
    """
    have = {c.lower(): c for c in rows.columns}
    for name, others in NAMES.items():
        found = [have[o] for o in others if o in have]
        if found:
            kind = "long" if name == "open_time_ms" else "double"
            rows = rows.withColumn(f"_{name}", F.coalesce(*[F.expr(f"try_cast(`{c}` AS {kind})") for c in found])).drop(*found).withColumnRenamed(f"_{name}", name)
    prices = [c for c in PRICES if c in rows.columns]
    for c in prices:
        rows = rows.withColumn(c, F.expr(f"try_cast(`{c}` AS double)"))
    rows = rows.where(F.col("open_time_ms").isNotNull())
    for c in prices:
        rows = rows.where(F.col(c) > 0)
    order = [F.col(tie)] if tie else [F.col(c) for c in prices]
    rows = rows.withColumn("_k", F.row_number().over(W.partitionBy(by, "open_time_ms").orderBy(*order))).where("_k = 1").drop("_k")
    gap = F.col("open_time_ms") - F.lag("open_time_ms").over(W.partitionBy(by).orderBy("open_time_ms")) > step_ms
    return rows.withColumn("after_gap", gap)


def read_candles(spark: SparkSession, path: str, series: str, step_ms: int) -> DataFrame:
    """CSV files with a header, in any of the layouts above; columns that must be there and are not are an error."""
    rows = spark.read.option("header", True).csv(path)
    have = {c.lower() for c in rows.columns}
    lacking = [c for c in (*PRICES, "volume", "open_time_ms") if not have & set(NAMES.get(c, (c,)))]
    if lacking:
        raise ValueError(f"{path} has no column for {', '.join(lacking)}")
    return prepare(rows.withColumn("series", F.lit(series)), "series", step_ms)


def known_ms(stamp: str, kind: str, stamped_at_end: tuple[str, ...], step_ms: int) -> Column:
    return F.when(F.col(kind).isin(*stamped_at_end), F.col(stamp)).otherwise(F.col(stamp) + step_ms)


def fill(have: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """have, and those rows of other whose keys it lacks; origin says which."""
    return have.withColumn("origin", F.lit("kept")).unionByName(other.join(have.select(keys), keys, "left_anti").withColumn("origin", F.lit("filled")))


def fill_bars(coarse: DataFrame, fine: DataFrame, by: str, step: int, fine_step: int, start: int | None = None) -> DataFrame:
    """(by, t, end, open, high, low, close): the bars that trades are filled on. A closed coarse bar is replaced by its fine ones where
    all of them are there; the bars of a key stop before its first hole.

    start is the first coarse bar's time, by default each key's own first; a key without a bar there has none. The hole is the
    least time whose predecessor is missing, found by a join, not by going through the bars. Bars with a null key or time are
    left out; of repeated ones any.
    """
    prices = ["open", "high", "low", "close"]
    clean = lambda bars: bars.select(by, "t", *prices).dropna(subset=[by, "t"]).dropDuplicates([by, "t"])
    five, one = clean(coarse), clean(fine)
    if start is not None:
        five = five.where(F.col("t") >= start)
    before = five.select(by, (F.col("t") + step).alias("t"), F.lit(1).alias("_before"))
    linked = five.join(before, [by, "t"], "left")
    bounds = linked.groupBy(by).agg(F.min("t").alias("_first"))
    bounds = bounds if start is None else bounds.where(F.col("_first") == start)
    holes = linked.where("_before IS NULL").join(bounds, by).where("t > _first").groupBy(by).agg(F.min("t").alias("_hole"))
    live = five.join(bounds, by).join(holes, by, "left").where("_hole IS NULL OR t < _hole").drop("_first", "_hole")
    whole = one.withColumn("_five", F.col("t") - F.pmod("t", F.lit(step)))
    full = whole.groupBy(by, F.col("_five").alias("t")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == step // fine_step).drop("_n")
    kept = live.join(full, [by, "t"], "left_anti").withColumn("end", F.col("t") + step)
    split = whole.join(live.select(by, F.col("t").alias("_five")).join(full.withColumnRenamed("t", "_five"), [by, "_five"]), [by, "_five"]).withColumn("end", F.col("t") + fine_step)
    columns = [by, "t", "end", *prices]
    return kept.select(columns).unionByName(split.select(columns))
