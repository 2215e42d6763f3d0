"""Margin of futures positions as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Maintenance tiers, fixed values: notional up to, rate, amount taken off, greatest leverage.
TIERS = (
    (50_000, 0.004, 0.0, 125), (600_000, 0.005, 50.0, 100), (3_000_000, 0.0065, 950.0, 75),
    (12_000_000, 0.01, 11_450.0, 50), (70_000_000, 0.02, 131_450.0, 25), (100_000_000, 0.025, 481_450.0, 20),
)


def tier(notional: Column, tiers=TIERS) -> Column:
    """(rate, amount, leverage) of the first tier that holds a notional; of the last for larger ones."""
    row = lambda t: F.struct(F.lit(float(t[1])).alias("rate"), F.lit(float(t[2])).alias("amount"), F.lit(int(t[3])).alias("leverage"))
    out = F.when(notional <= tiers[0][0], row(tiers[0]))
    for t in tiers[1:-1]:
        out = out.when(notional <= t[0], row(t))
    return out.otherwise(row(tiers[-1]))


def liquidation(side: Column, entry: Column, qty: Column, margin: Column, tiers=TIERS) -> Column:
    """The price at which an isolated position's margin no longer covers its maintenance, fees left out."""
    t = tier(qty * entry, tiers)
    return (qty * entry - side * (margin + t["amount"])) / (qty * (1 - side * t["rate"]))
