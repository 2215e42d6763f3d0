"""Many exit and entry rules for the same trades in one pass: each trade meets its bars once, whatever the number of rules."""

from __future__ import annotations

from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemill.operators.joins import range_join
from tidemill.operators.simulate import Rules


def first_at_least(rising: np.ndarray, level: np.ndarray) -> np.ndarray:
    """For each row of values that never fall, the first place whose value is at least the row's level (the width, if none is);
    by halving, for all rows at once."""
    low, high = np.zeros(len(rising), np.int64), np.full(len(rising), rising.shape[1])
    rows = np.arange(len(rising))
    while (low < high).any():
        middle = np.minimum((low + high) // 2, rising.shape[1] - 1)
        ok = (rising[rows, middle] >= level) & (low < high)
        high, low = np.where(ok, middle, high), np.where(~ok & (low < high), middle + 1, low)
    return low


class Paths:
    """The bars of some trades from their start on, a row each, padded with NaN to one width."""

    def __init__(self, side: np.ndarray, b: np.ndarray, counts: np.ndarray, columns: list[np.ndarray], width: int):
        self.side, self.b, self.n, self.width = side.astype(float), b, counts, width
        inside = np.arange(width) < counts[:, None]
        self.open, self.high, self.low, self.close = (np.full((len(side), width), np.nan) for _ in range(4))
        for padded, flat in zip((self.open, self.high, self.low, self.close), columns):
            padded[inside] = flat

    def fills(self, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place of the entry bar, price, maker, filled within the bar); place = width where there is no entry."""
        rows = np.arange(len(self.n))
        if rules.pullback is None:
            none = np.zeros(len(rows), bool)
            return np.zeros(len(rows), np.int64), self.open[:, 0], none, none
        limit = self.open[:, 0] * np.exp(-self.side * rules.pullback * self.b)
        wait, long = slice(0, min(rules.wait, self.width)), self.side[:, None] > 0
        at_open = np.where(long, self.open[:, wait] <= limit[:, None], self.open[:, wait] >= limit[:, None])
        inside = np.where(long, self.low[:, wait] <= limit[:, None] * (1 - rules.through), self.high[:, wait] >= limit[:, None] * (1 + rules.through))
        hit = at_open | inside
        maker, k = hit.any(axis=1), hit.argmax(axis=1)
        later = np.where(rules.wait < self.n, rules.wait, self.width)
        place = np.where(maker, k, later)
        seen = self.open[rows, np.minimum(place, self.width - 1)]
        within = maker & ~at_open[rows, k]
        return place, np.where(within, limit, seen), maker, within

    def exits(self, fill: tuple, cells: list[Rules]):
        """For each of some rules with one way of entry: (rows, entry place, price, maker, exit place, exit price, kind)."""
        place, price, maker, within = fill
        rows = np.flatnonzero(place < self.n)
        place, price, maker, within, side, b = place[rows], price[rows], maker[rows], within[rows], self.side[rows], self.b[rows]
        hold = max(c.hold for c in cells)
        at = place[:, None] + np.arange(hold)
        inside = at < self.n[rows][:, None]
        at = np.minimum(at, self.width - 1)
        high, low = self.high[rows[:, None], at], self.low[rows[:, None], at]
        long = side[:, None] > 0
        along, against = np.where(long, high, -low), np.where(long, -low, high)  # how far the price went each way
        along, against = np.where(inside, along, -np.inf), np.where(inside, against, -np.inf)
        along[within, 0] = -np.inf  # within the bar of a limit fill the order is unknown
        along, against = np.maximum.accumulate(along, axis=1), np.maximum.accumulate(against, axis=1)
        have = inside.sum(axis=1)
        for rules in cells:
            target, stop = price * np.exp(side * rules.tp * b), price * np.exp(-side * rules.sl * b)
            t, s, n = first_at_least(along, side * target), first_at_least(against, -side * stop), np.minimum(have, rules.hold)
            stopped = (s < n) & (s <= t)
            reached = ~stopped & (t < n)
            k = np.where(stopped, s, np.where(reached, t, n - 1))
            first, last = (x[rows, np.minimum(place + k, self.width - 1)] for x in (self.open, self.close))
            gone = np.where(side > 0, np.minimum(first, stop), np.maximum(first, stop))
            kind = np.select([stopped, reached, n < rules.hold], ["SL", "TP", "CUT"], "TIMEOUT")
            yield rules, rows, place, price, maker, place + k, np.where(stopped, gone, np.where(reached, target, last)), kind


def simulate_grid(bars: DataFrame, trades: DataFrame, by: str, cells: list[Rules]) -> DataFrame:
    """What simulate() gives for each of the rules, with `cell`, their place in the list: (cell, by, id, entry_at, entry, maker,
    exit_at, exit, kind, r, r_net). Trades and bars as there.

    One range join for all rules, as wide as the longest of them; of each trade's bars the running extremes are kept from its
    entry on, on which each rule's target and stop are found by halving.
    """
    span = max(c.hold + (c.wait if c.pullback is not None else 0) for c in cells)
    wanted = trades.select(by, "id", F.col("start").cast("long").alias("start"), F.col("side").cast("int").alias("side"), F.col("b").cast("double").alias("b")).dropna().withColumn("_until", F.col("start") + span)
    seen = range_join(bars.select(by, "i", "open", "high", "low", "close"), wanted, "i", "start", "_until", [by], span)
    paths = seen.groupBy(by, "id", "start", "side", "b").agg(F.sort_array(F.collect_list(F.struct("i", "open", "high", "low", "close"))).alias("_bars"))
    paths = paths.where(F.col("_bars")[0]["i"] == F.col("start"))
    lists = paths.select(by, "id", "start", "side", "b", *[F.col(f"_bars.{c}").cast("array<double>").alias(c) for c in ("open", "high", "low", "close")])
    numbered = list(enumerate(cells))
    groups: dict[tuple, list] = {}
    for k, c in numbered:
        groups.setdefault((c.pullback, c.wait if c.pullback is not None else 0, c.through), []).append(k)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                columns = {n: part.column(n) for n in part.schema.names}
                counts = columns["open"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                first, side, b = (columns[c].to_numpy(zero_copy_only=False) for c in ("start", "side", "b"))
                own = Paths(side, b, counts, [columns[c].flatten().to_numpy(zero_copy_only=False) for c in ("open", "high", "low", "close")], span)
                for members in groups.values():
                    place = {id(cells[k]): k for k in members}
                    for rules, rows, entry, price, maker, out, exit_price, kind in own.exits(own.fills(cells[members[0]]), [cells[k] for k in members]):
                        r = side[rows] * np.log(exit_price / price) / (rules.sl * b[rows])
                        net = r - (np.where(maker, rules.maker, rules.taker) + rules.taker) / (rules.sl * b[rows])
                        take = pa.array(rows)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(rows), place[id(rules)], np.int32)), columns[by].take(take), columns["id"].take(take), pa.array(first[rows] + entry), pa.array(price), pa.array(maker),
                            pa.array(first[rows] + out), pa.array(exit_price), pa.array(kind.astype(object), pa.string()), pa.array(r), pa.array(net),
                        ], names=["cell", by, "id", "entry_at", "entry", "maker", "exit_at", "exit", "kind", "r", "r_net"])

    kinds = dict(lists.dtypes)
    return lists.mapInArrow(run, f"cell int, {by} {kinds[by]}, id {kinds['id']}, entry_at long, entry double, maker boolean, exit_at long, exit double, kind string, r double, r_net double")


def cell_table(cells: list[Rules]) -> list[tuple]:
    """(cell, rules by name) as rows, to be joined with what simulate_grid() gives."""
    return [(k, asdict(c)) for k, c in enumerate(cells)]
