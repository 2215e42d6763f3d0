"""Trades against bars, set-based: fills and exits are the least bar that meets a condition, found by a binned range join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tidemill.functions.ieee import ln, over
from tidemill.operators.joins import range_join


@dataclass(frozen=True)
class Rules:
    """Exits at tp and sl times b (as log distances) from the entry, at most hold bars; with pullback, a limit order that far
    back from the open for wait bars, beyond which price must go by the share through; fees as shares of the price."""

    tp: float = 1.0
    sl: float = 1.0
    hold: int = 9
    pullback: float | None = None
    wait: int = 3
    through: float = 0.0
    maker: float = 0.0
    taker: float = 0.0

    def __post_init__(self):
        if min(self.tp, self.sl) <= 0 or self.hold < 1 or self.wait < 1 or min(self.through, self.maker, self.taker) < 0 or (self.pullback is not None and self.pullback < 0):
            raise ValueError("distances, bars and fees must be positive")


def simulate(bars: DataFrame, trades: DataFrame, by: str, rules: Rules) -> DataFrame:
    """(by, id, entry_at, entry, maker, exit_at, exit, kind, r, r_net) of trades (by, id, start, side, b) on bars (by, i, open,
    high, low, close), i counting up without a hole.

    Entry: at the open of bar start; with a pull-back, at the open of the first of wait bars that opens at the limit or better,
    or at the limit within the first bar that trades through it, else at the open of the bar after them. Exit: the first bar
    that reaches the stop, at its price or at an open already beyond it; else the one that reaches the target, but not within
    the bar of a limit fill, as the order within a bar is unknown; of both in one bar the stop. Else the close of the last bar
    held (TIMEOUT), or of the last there is (CUT). r is in units of the stop's distance; r_net has the fees taken off. Trades
    without an entry bar, or with nulls, have no row.
    """
    side, b = F.col("side"), F.col("b")
    ahead = lambda price, level: F.when(side > 0, F.col(price) <= level).otherwise(F.col(price) >= level)  # noqa: E731  as bad for the trade as level
    first = bars.select(by, F.col("i").alias("start"), F.col("open").alias("_open"))
    good = trades.select(by, "id", "start", "side", "b").dropna().join(first, [by, "start"])
    market = lambda at: bars.select(by, F.col("i").alias(at), F.col("open").alias("_market"))
    if rules.pullback is None:
        filled = good.select("*", F.col("start").alias("entry_at"), F.col("_open").alias("entry"), F.lit(False).alias("maker"), F.lit(False).alias("_within"))
    else:
        limit = F.col("_open") * F.exp(-side * rules.pullback * b)
        asked = good.withColumn("_limit", limit).withColumn("_until", F.col("start") + rules.wait)
        near = range_join(bars.select(by, "i", "open", "high", "low"), asked, "i", "start", "_until", [by], rules.wait)
        at_open = ahead("open", F.col("_limit"))
        inside = F.when(side > 0, F.col("low") <= F.col("_limit") * (1 - rules.through)).otherwise(F.col("high") >= F.col("_limit") * (1 + rules.through))
        hit = F.min(F.when(at_open | inside, F.struct("i", F.when(at_open, F.col("open")).otherwise(F.col("_limit")).alias("price"), (~at_open).alias("within")))).alias("_hit")
        asked = asked.join(near.groupBy(by, "id").agg(hit), [by, "id"], "left").join(market("_until"), [by, "_until"], "left")
        filled = asked.select(*good.columns, F.coalesce("_hit.i", "_until").alias("entry_at"), F.coalesce("_hit.price", "_market").alias("entry"), F.col("_hit").isNotNull().alias("maker"), F.coalesce("_hit.within", F.lit(False)).alias("_within"))
        filled = filled.where("entry IS NOT NULL")
    filled = filled.withColumn("_tp", F.col("entry") * F.exp(side * rules.tp * b)).withColumn("_sl", F.col("entry") * F.exp(-side * rules.sl * b)).withColumn("_end", F.col("entry_at") + rules.hold)
    seen = range_join(bars, filled.drop("_open", "start"), "i", "entry_at", "_end", [by], rules.hold)
    stop = F.when(side > 0, F.col("low") <= F.col("_sl")).otherwise(F.col("high") >= F.col("_sl"))
    target = F.when(side > 0, F.col("high") >= F.col("_tp")).otherwise(F.col("low") <= F.col("_tp")) & ~(F.col("_within") & (F.col("i") == F.col("entry_at")))
    gap = F.when(side > 0, F.least("open", "_sl")).otherwise(F.greatest("open", "_sl"))
    keys = [by, "id", "side", "b", "entry_at", "entry", "maker", "_tp"]
    found = seen.groupBy(*keys).agg(
        F.min(F.when(stop, F.struct("i", gap.alias("price")))).alias("_s"), F.min(F.when(target, F.col("i"))).alias("_t"),
        F.max(F.struct("i", "close")).alias("_last"), F.count(F.lit(1)).alias("_n"),
    )
    stopped = F.col("_s").isNotNull() & (F.col("_t").isNull() | (F.col("_s.i") <= F.col("_t")))
    kind = F.when(stopped, "SL").when(F.col("_t").isNotNull(), "TP").when(F.col("_n") < rules.hold, "CUT").otherwise("TIMEOUT")
    out = found.select(
        by, "id", "side", "b", "entry_at", "entry", "maker", kind.alias("kind"),
        F.when(stopped, F.col("_s.i")).otherwise(F.coalesce("_t", "_last.i")).alias("exit_at"),
        F.when(stopped, F.col("_s.price")).when(F.col("_t").isNotNull(), F.col("_tp")).otherwise(F.col("_last.close")).alias("exit"),
    )
    out = out.withColumn("r", F.col("side") * ln(over(F.col("exit"), F.col("entry"))) / (rules.sl * F.col("b")))
    fee = F.when(F.col("maker"), rules.maker).otherwise(rules.taker) + rules.taker
    return out.withColumn("r_net", F.col("r") - fee / (rules.sl * F.col("b"))).drop("side", "b")
