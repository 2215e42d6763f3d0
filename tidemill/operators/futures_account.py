"""A futures account with isolated margin: whether a trade is liquidated depends on its size, its size on what the trades before made.

Outcomes are found for all trades at once for assumed sizes, admission and account value follow from outcomes, and sizes from the
value. That is repeated until no size changes. Each trade depends on earlier ones only, so what agrees with itself is the account
that one would get trade by trade; each round settles at least the first trade that was wrong, and few depend on their size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemill.functions import futures
from tidemill.operators import books
from tidemill.operators.joins import range_join
from tidemill.operators.simulate import Rules
from tidemill.streaming.sinks import settled


@dataclass(frozen=True)
class Account:
    """capital at the start; margin, a trade's share of the value at its entry; leverage; the most trades at once and the least
    bars between their signals."""

    capital: float = 100_000.0
    margin: float = 0.01
    leverage: float = 50.0
    cap: int = 3
    gap: int = 1

    def __post_init__(self):
        if min(self.capital, self.margin, self.leverage) <= 0 or self.cap < 1 or self.gap < 0:
            raise ValueError("capital, margin, leverage and cap must be positive")


def paths(bars: DataFrame, trades: DataFrame, funding: DataFrame, by: str, rules: Rules) -> DataFrame:
    """The bars that each trade is open in, entered at the open of its start, with the funding paid up to each for a unit of
    notional (negative: paid), including what is settled at the bar's own place."""
    rates = funding.groupBy("i").agg(F.sum("rate").alias("_rate"))
    first = bars.select(by, F.col("i").alias("start"), F.col("open").alias("entry"))
    good = trades.select(by, "id", "start", "side", "b").dropna().join(first, [by, "start"]).withColumn("_until", F.col("start") + rules.hold)
    seen = range_join(bars.select(by, "i", "open", "high", "low", "close"), good, "i", "start", "_until", [by], rules.hold).drop("_until")
    paid = F.when(F.col("i") > F.col("start"), -F.col("side") * F.col("open") / F.col("entry") * F.coalesce("_rate", F.lit(0.0))).otherwise(0.0)
    so_far = F.sum("_paid").over(W.partitionBy(by, "id").orderBy("i"))  # as many rows as bars held
    return seen.join(rates, "i", "left").withColumn("_paid", paid).withColumn("paid", so_far).drop("_rate", "_paid")


def outcomes(path: DataFrame, sizes: DataFrame, by: str, rules: Rules, account: Account) -> DataFrame:
    """(by, id, start, side, b, entry, notional, exit_at, exit, kind, paid, gain) of each trade of sizes (by, id, notional). gain is the
    net result for a unit of notional.

    A bar's stop is the stop price or the liquidation price, whichever comes first on the way; the latter moves with the margin,
    which funding changes. The first bar that reaches it ends the trade (SL at its open if that is beyond; LIQ loses the margin
    that is left); else the first that reaches the target, at a maker's fee; else the last (TIMEOUT), or none (OPEN).
    """
    side, entry, n = F.col("side"), F.col("entry"), F.col("notional")
    rows = path.join(sizes, [by, "id"])
    tier = futures.tier(n)
    gone = entry * (1 - side * (1 / account.leverage + F.col("paid") + tier["amount"] / n)) / (1 - side * tier["rate"])
    stop, target = entry * F.exp(-side * rules.sl * F.col("b")), entry * F.exp(side * rules.tp * F.col("b"))
    rows = rows.withColumn("_gone", gone).withColumn("_stop", stop).withColumn("_target", target)
    liquid = F.when(side > 0, F.col("_gone") >= F.col("_stop")).otherwise(F.col("_gone") <= F.col("_stop"))
    level = F.when(liquid, F.col("_gone")).otherwise(F.col("_stop"))
    hit = F.when(side > 0, F.col("low") <= level).otherwise(F.col("high") >= level)
    won = F.when(side > 0, F.col("high") >= F.col("_target")).otherwise(F.col("low") <= F.col("_target"))
    price = F.when(liquid, F.col("_gone")).when(side > 0, F.least("open", "_stop")).otherwise(F.greatest("open", "_stop"))
    event = F.when(hit, F.struct("i", F.lit(0).alias("k"), price.alias("x"), F.when(liquid, "LIQ").otherwise("SL").alias("kind"), "paid")).when(won, F.struct("i", F.lit(1).alias("k"), F.col("_target").alias("x"), F.lit("TP").alias("kind"), "paid"))
    last = F.struct("i", F.lit(2).alias("k"), F.col("close").alias("x"), F.lit("TIMEOUT").alias("kind"), "paid")
    found = rows.groupBy(by, "id", "start", "side", "b", "entry", "notional").agg(F.min(event).alias("_e"), F.max(last).alias("_l"), F.count(F.lit(1)).alias("_n"))
    found = found.withColumn("_x", F.coalesce("_e", F.when(F.col("_n") == rules.hold, F.col("_l"))))
    found = found.select(by, "id", "start", "side", "b", "entry", "notional", F.col("_x.i").alias("exit_at"), F.col("_x.x").alias("exit"), F.coalesce("_x.kind", F.lit("OPEN")).alias("kind"), F.col("_x.paid").alias("paid"))
    moved = F.col("side") * (F.col("exit") / F.col("entry") - 1)
    fee = F.col("exit") / F.col("entry") * F.when(F.col("kind") == "TP", rules.maker).otherwise(rules.taker)
    gain = F.when(F.col("kind") == "LIQ", F.lit(-1 / account.leverage)).otherwise(moved - fee + F.col("paid")) - rules.taker
    return found.withColumn("gain", gain)


def isolated_account(bars: DataFrame, trades: DataFrame, funding: DataFrame, by: str, rules: Rules, account: Account, chunk: int) -> DataFrame:
    """outcomes() of the admitted trades with base, the value at entry, net, equity_after, leverage_ok (the tier allows it) and buffer_pct:
    the share of the value left if all open trades and this one hit their stops, maintenance taken off.

    bars (by, i, open, high, low, close), i counting up; trades (by, id, start, side, b), ids unique; funding (i, rate), paid at
    the start of bar i by trades entered before. A trade counts as open from its start to its exit's bar; it enters after the
    exits of bars before. Trades still open when the bars end are left out, as are those with nulls.
    """
    path = settled(paths(bars, trades, funding, by, rules), "paths")
    fraction = account.margin * account.leverage
    sizes = settled(path.select(by, "id").distinct().withColumn("notional", F.lit(account.capital * fraction)), "sizes")
    while True:
        done = settled(outcomes(path, sizes, by, rules, account).where("kind <> 'OPEN'"), "outcomes")
        taken = books.admit(done, by, "start", "exit_at", account.cap, account.gap, chunk).where("admitted").select(by, "id")
        # an exit's bar is over when the next begins
        held = done.join(taken, [by, "id"]).withColumn("_gone", F.col("exit_at") + 1)
        value = settled(books.equity(held, by, "start", "_gone", "gain", fraction, chunk, account.capital), "value")
        new = value.select(by, "id", (F.col("base") * fraction).alias("_new"))
        # a size is wrong if its outcome may differ: sizes of trades that are not admitted do not matter
        differ = settled(sizes.join(new, [by, "id"]).where(F.abs(F.col("_new") - F.col("notional")) > 1e-9 * F.col("_new")).select(by, "id", "_new"), "differ")
        if differ.isEmpty():
            break
        sizes = settled(sizes.join(differ, [by, "id"], "left").select(by, "id", F.coalesce("_new", "notional").alias("notional")), "sizes")
    out = held.drop("_gone").join(value, [by, "id"])
    risk = F.col("notional") * (F.abs(1 - F.exp(-F.col("side") * rules.sl * F.col("b"))) + futures.tier(F.col("notional"))["rate"])
    spans = out.select(by, F.col("id").alias("other"), F.col("start").alias("since"), (F.col("exit_at") + 1).alias("until"), risk.alias("risk"))
    open_ = range_join(out.select(by, "id", "start"), spans, "start", "since", "until", [by], rules.hold).groupBy(by, "id").agg(F.sum(F.when((F.col("since") < F.col("start")) | (F.col("other") <= F.col("id")), F.col("risk"))).alias("_risk"))
    out = out.join(open_, [by, "id"])
    return out.select(
        by, "id", "start", "side", "entry", "notional", "exit_at", "exit", "kind", "base", (F.col("notional") * F.col("gain")).alias("net"), (F.col("notional") * F.col("paid")).alias("funding"), "equity_after",
        (futures.tier(F.col("notional"))["leverage"] >= account.leverage).alias("leverage_ok"), (100 * (F.col("base") - F.col("_risk")) / F.col("base")).alias("buffer_pct"),
    )
